"""License notices by diagonal voting.

Every run of three words of every document is joined with the places of that run in the templates. A hit votes for the
diagonal (place in the document less place in the template). Votes are counted by diagonal, diagonals that lie close
together are merged, and what has enough votes is a span, which the words themselves then confirm or refute.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import license_texts as fixed
from .common import LOWER, Runs, chunks, forget, signed, texts, word_symbols, words, written

#: Words of a run that is looked up.
GRAM = 3
#: Share of a wording's words that stand in order in a confirmed span; words of a phrase all do.
SHARE = 0.8
#: Runs in one row, so that a very long document is several rows.
PIECE = 1 << 14
#: Runs of all templates up to which they are broadcast, some 16 MB; more are joined as Spark sees fit.
BROADCAST_RUNS = 1 << 18

#: Word bytes are small letters, digits and all above ASCII, once A-Z are made small.
OUTSIDE = np.array([b < 0x80 and not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A) for b in range(256)])


@dataclass(frozen=True)
class Template:
    """A phrase counts word for word; a wording where at least SHARE of its words stand in order. Both of GRAM words at least."""

    label: str
    text: str
    phrase: bool = True
    base: bool = False


TEMPLATES = [
    *[Template(label, text, base=True) for label, text in fixed.BASE_PHRASES],
    *[Template(label, text) for label, text in fixed.NOTICES],
    *[Template(label, text, phrase=False) for label, text in fixed.WORDINGS],
]


def license_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of texts with A-Z made small; number of each text's first word."""
    small = LOWER[data] if len(data) else data
    begins, ends, first = words(small, at, OUTSIDE)
    return word_symbols(small, begins, ends), first


def template_words(template: Template) -> np.ndarray:
    raw = np.frombuffer(template.text.encode(), np.uint8)
    symbols = license_words(raw, np.array([0, len(raw)]))[0]
    if len(symbols) < GRAM:
        raise ValueError(f"a template has at least {GRAM} words: {template.text!r}")
    return symbols


def gap(template: Template, n_words: int) -> int:
    """Diagonals of a wording at most that far apart are merged: so many words may be put in or left out at once."""
    return 0 if template.phrase else max(1, n_words // 8)


def votes_needed(template: Template, n_words: int) -> int:
    """A changed word takes away GRAM runs at most, and 1 - SHARE of the words may be changed."""
    return n_words - GRAM + 1 if template.phrase else max(1, n_words - GRAM + 1 - int(GRAM * (1 - SHARE) * n_words))


def in_order(span: np.ndarray, template: np.ndarray) -> int:
    """Length of the longest common subsequence, by one bit for each word of the template."""
    places: dict[int, int] = {}
    for i, word in enumerate(template.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(template)) - 1
    row = full
    for word in span.tolist():
        hit = row & places.get(word, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return len(template) - row.bit_count()


def confirmed(symbols: np.ndarray, template: np.ndarray, phrase: bool, low: int, high: int) -> tuple[float, int, int]:
    """Share of the template's words that stand in a span around diagonals low to high, where it begins and how long it is.

    A wording is looked for in windows of 3/2 of its length, one every quarter of it; the best, of equals the first, counts.
    """
    n = len(template)
    if phrase:
        same = bool(low >= 0 and np.array_equal(symbols[low:low + n], template))
        return float(same), low, n
    step, width = max(1, n // 4), n + n // 2
    begin, end = max(0, low - step), min(len(symbols), high + n + step)
    best = 0.0, begin, 0
    for at in range(begin, max(begin + 1, end - width + step), step):
        share = in_order(symbols[at:min(at + width, end)], template) / n
        if share > best[0]:
            best = share, at, min(at + width, end) - at
    return best


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, key, start, hashes): the hashes of all runs of GRAM words, from word `start` on, PIECE in a row at most."""

    def rolling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for low, high, data, at in chunks(batch.column(2)):
                symbols, first = license_words(data, at)
                grams = Runs(symbols).every(GRAM)
                many = np.maximum(np.diff(first) - GRAM + 1, 0)
                pieces = -(-many // PIECE)
                of = np.repeat(np.arange(high - low), pieces)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
                size = np.minimum(many[of] - start, PIECE)
                offsets = np.concatenate(([0], np.cumsum(size)))
                take = np.repeat(first[of] + start - offsets[:-1], size) + np.arange(offsets[-1])
                hashes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(signed(grams[take])))
                rows = pa.array(low + of)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start), hashes], ["doc_id", "key", "start", "hashes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(rolling, f"doc_id {kind}, key int, start long, hashes array<bigint>")


def spans(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """(doc_id, key, template, low, high): merged diagonals with enough votes for a template."""
    spark = docs.sparkSession
    parsed = [template_words(t) for t in templates]
    rows = [(int(h), i, at) for i, symbols in enumerate(parsed) for at, h in enumerate(signed(Runs(symbols).every(GRAM)))]
    places = spark.createDataFrame(rows, "hash long, template int, at long")
    places = F.broadcast(places) if len(rows) <= BROADCAST_RUNS else places
    hits = runs(docs).select("doc_id", "key", "start", F.posexplode("hashes").alias("i", "hash")).join(places, "hash")
    place = F.col("start") + F.col("i")
    # rows that are repeated vote once
    votes = hits.groupBy("doc_id", "key", "template", (place - F.col("at")).alias("diagonal")).agg(F.count_distinct(place).alias("votes"))

    def of_template(numbers: list[int]):
        return F.get(F.array(*map(F.lit, numbers)), F.col("template"))

    far = of_template([gap(t, len(s)) for t, s in zip(templates, parsed)])
    order = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > far).cast("int"), F.lit(1))
    merged = votes.withColumn("new", new).withColumn("cluster", F.sum("new").over(order)).groupBy("doc_id", "key", "template", "cluster").agg(
        F.sum("votes").alias("votes"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high")
    )
    needed = of_template([votes_needed(t, len(s)) for t, s in zip(templates, parsed)])
    return merged.filter(F.col("votes") >= needed).select("doc_id", "key", "template", "low", "high")


def license_spans(docs: DataFrame, templates: list[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, template, label, begin, n_words, share) of all confirmed spans; `template` is its number in the list.

    Words are small letters, digits and letters beyond ASCII, once A-Z are made small. A phrase counts at every place,
    overlapping ones too, with share 1. A wording counts where at least SHARE of its words stand in order within 3/2 of
    its length; copies of it that lie closer than an eighth of it may be one span. `key` is the hash of the text: rows of
    equal id and text are one document, rows of equal id and other text are not. A null text has no span, a null id is an
    id of its own, other columns are not read, an empty table gives no row. The text is read twice; of texts, only those with a span have to be
    shuffled (Spark filters the others by a Bloom filter where that pays). The templates are a parameter and small.
    """
    rows = texts(docs, id_col, text_col)
    found = written(spans(rows, templates), "license-spans")
    lists = found.groupBy("doc_id", "key").agg(F.collect_list(F.struct("template", "low", "high")).alias("spans"))
    parsed = [(template_words(t), t.phrase) for t in templates]
    labels = np.array([t.label for t in templates], object)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            column = batch.column(3)
            for low, _, data, at in chunks(batch.column(2)):
                symbols, first = license_words(data, at)
                of, template, share, begin, n_words = [], [], [], [], []
                for i in range(len(at) - 1):
                    mine, edges = symbols[first[i]:first[i + 1]], column.offsets[low + i:low + i + 2].to_pylist()
                    candidates = column.values.slice(edges[0], edges[1] - edges[0])
                    numbers, lows, highs = (candidates.field(c).to_numpy() for c in range(3))
                    for t, a, b in sorted(zip(numbers.tolist(), lows.tolist(), highs.tolist())):
                        alike, place, n = confirmed(mine, *parsed[t], a, b)
                        if alike >= (1.0 if parsed[t][1] else SHARE):
                            of.append(low + i)
                            template.append(t)
                            share.append(alike)
                            begin.append(place)
                            n_words.append(n)
                rows = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array(template, pa.int32()), pa.array(labels[template].tolist(), pa.string()),
                    pa.array(begin, pa.int64()), pa.array(n_words, pa.int64()), pa.array(share, pa.float64()),
                ], ["doc_id", "key", "template", "label", "begin", "n_words", "share"])

    # rows that are repeated are one document
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.key") == F.col("s.key"))
    both = rows.alias("d").join(lists.alias("s"), same).select("d.doc_id", "d.key", "d.text", "s.spans")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(confirm, f"doc_id {kind}, key int, template int, label string, begin long, n_words long, share double").distinct()


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_words) of rows (doc_id, key, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            counts = []
            for _, _, data, at in chunks(batch.column(2)):
                counts.append(np.diff(words(LOWER[data] if len(data) else data, at, OUTSIDE)[2]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int64())], ["doc_id", "key", "n_words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(count, f"doc_id {kind}, key int, n_words long")


def license_labels(docs: DataFrame, templates: list[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document, a repeated row each.

    n_base, first_word and last_word: how many places base phrases have, and the smallest and largest word (from 0) at
    which one begins; null where there is none. base_labels, labels: the labels of base phrases and of all spans, distinct,
    sorted, joined by commas; empty if none. score: the largest share of a span, 0 if none. See `license_spans`.
    """
    rows = texts(docs, id_col, text_col)
    base = F.get(F.array(*[F.lit(t.base) for t in templates]), F.col("template"))
    per_doc = license_spans(docs, templates, id_col, text_col).groupBy("doc_id", "key").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("begin"))).alias("first_word"), F.max(F.when(base, F.col("begin"))).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_labels"), F.collect_set("label").alias("labels"), F.max("share").alias("score"),
    )
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.key") == F.col("s.key"))
    joined = word_counts(rows).alias("d").join(per_doc.alias("s"), same, "left")

    def listed(name: str):
        return F.coalesce(F.array_join(F.array_sort(name), ","), F.lit("")).alias(name)

    return joined.select(
        "d.doc_id", "d.n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        listed("base_labels"), listed("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
