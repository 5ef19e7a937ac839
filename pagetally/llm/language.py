"""Language identification as a mixture: the share of each language in a document, by expectation maximisation.

Each language is a distribution over hashed letter trigrams. A document's trigrams are drawn from a mixture of them; the
shares are fitted by expectation maximisation, and the languages that stay are those of the best penalised likelihood.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, mixed, small_batches, string_bytes

#: Hashed trigrams.
BUCKETS = 1 << 15
#: Labelled documents that the model is fitted on, at most about; all of them where there are fewer.
TRAIN_DOCS = 20_000
#: Rounds of expectation maximisation over all languages, and over each smaller set.
ROUNDS, ROUNDS_LESS = 12, 6
#: A trigram overlaps its neighbours by two letters, so it counts as a third of an observation.
EVIDENCE = 1 / 3
#: The language of a text that has none.
UNKNOWN = "und"
#: Text that is looked at together, in bytes.
TOGETHER = 1 << 18

_LETTER = re.compile(r"[^\W\d_]")
#: Letters A-Z made small, other ASCII characters a space, bytes of other letters kept.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all texts one after another, and where each text's begin. Case and what is no letter don't count."""
    # a text stands between spaces; trigrams with a letter in their middle count
    folded = [b" " + t.lower().encode().translate(_FOLD) + b" " for t in texts]
    data = np.frombuffer(b"".join(folded), np.uint8)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in folded], out=at[1:])
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    a, b, c = data[:-2], data[1:-1], data[2:]
    code = a.astype(np.uint64) << np.uint64(16) | b.astype(np.uint64) << np.uint64(8) | c
    space = data == 32
    good = ~space[1:-1]
    ends = at[1:-1]
    # none across the border of two texts
    for back in (1, 2):
        border = ends - back
        good[border[(border >= 0) & (border < len(good))]] = False
    where = np.flatnonzero(good)
    return (mixed(code[where]) & np.uint64(BUCKETS - 1)).astype(np.int64), np.searchsorted(where, at)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: Probability of each bucket (rows) in each language (columns), smoothed.
    probability: np.ndarray


def equal_part(counts: list[int], most: int) -> int:
    """How many of each so that all together are about `most`, where a count that is less leaves its rest to the others."""
    part = most
    for i, n in enumerate(sorted(counts)):
        part = max(1, most // (len(counts) - i))
        if n > part:
            break
        most -= n
    return part


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Trigram counts of the rows with a language, or of about `train_docs` of them, chosen by hash of the id.

    Languages with fewer rows than an equal part of `train_docs` are learned from all of them, the others share the rest
    equally, so that a rare language is never lost.

    The model has BUCKETS numbers for each language, so its size depends on the languages alone.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    # a row for each language comes to the driver
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    most = equal_part(list(counts.values()), train_docs)
    if any(n > most for n in counts.values()):
        share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 40, (most << 40) // n))])
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                found, _ = trigrams([text.as_py()])
                name = lang.as_py()
                if name not in sums:
                    sums[name] = np.zeros(BUCKETS, np.int64)
                sums[name] += np.bincount(found, minlength=BUCKETS)
        for name, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([counts.tobytes()])], ["lang", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, counts in zip(batch.column(0), batch.column(1)):
                found = np.frombuffer(counts.as_py(), np.int64)
                sums[name.as_py()] = sums[name.as_py()] + found if name.as_py() in sums else found
        for name, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([counts.tobytes()])], ["lang", "counts"])

    parts = rows.select("text", "lang").mapInArrow(count, "lang string, counts binary")
    # few rows for each language come to the driver, however many tasks counted
    summed = parts.repartition(8, F.spark_partition_id() % 8, "lang").mapInArrow(add, "lang string, counts binary")
    totals: dict[str, np.ndarray] = {}
    for r in summed.collect():
        totals[r["lang"]] = totals.get(r["lang"], 0) + np.frombuffer(r["counts"], np.int64).astype(np.float64)
    names = tuple(sorted(totals))
    if not names:
        return Model((), np.zeros((BUCKETS, 0), np.float32))
    counts = np.stack([totals[x] for x in names], 1)
    smooth = 0.5
    probability = (counts + smooth) / (counts.sum(0) + smooth * BUCKETS)
    return Model(names, probability.astype(np.float32))


def shares(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages (rows: texts), and how many trigrams each text has. Without any, all shares are 0."""
    k = len(model.languages)
    found, at = trigrams(texts)
    n = np.diff(at)
    result = np.zeros((len(texts), k))
    has = np.flatnonzero(n)
    if not k or not len(has):
        return result, n
    # distinct trigrams of each text and their counts
    doc = np.repeat(np.arange(len(texts)), n)
    both, counts = np.unique(doc * BUCKETS + found, return_counts=True)
    doc, bucket = both // BUCKETS, both % BUCKETS
    starts = np.searchsorted(doc, has)
    p, c = model.probability[bucket], counts.astype(np.float32)
    slim = np.searchsorted(has, doc)
    total = n[has].astype(np.float32)[:, None]

    def step(pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weighted = p * pi[slim]
        mass = weighted.sum(1)
        likelihood = np.add.reduceat(c * np.log(mass), starts)
        return np.add.reduceat(weighted * (c / mass)[:, None], starts, axis=0) / total, likelihood

    pi = np.full((len(has), k), 1 / k, np.float32)
    for _ in range(ROUNDS):
        pi, _ = step(pi)
    order = np.argsort(-pi, 1, kind="stable")
    # each more language costs half the logarithm of the evidence
    cost = 0.5 * np.log(np.maximum(2.0, total[:, 0] * EVIDENCE))
    best, best_score = None, None
    # texts whose last larger set was better; of the others none larger is tried, whatever stands beside them
    going = np.ones(len(has), bool)
    floor = np.float32(1e-9)
    for size in range(1, k + 1):
        kept = np.zeros_like(pi)
        np.put_along_axis(kept, order[:, :size], np.maximum(np.take_along_axis(pi, order[:, :size], 1), floor), 1)
        kept /= kept.sum(1, keepdims=True)
        if size > 1:
            for _ in range(ROUNDS_LESS):
                kept, _ = step(kept)
        _, likelihood = step(kept)
        score = likelihood * EVIDENCE - cost * (size - 1)
        if best is None:
            best, best_score = kept, score
        else:
            better = going & (score > best_score)
            if not better.any():
                # larger sets only add languages of smaller shares
                break
            going = better
            best = np.where(better[:, None], kept, best)
            best_score = np.where(better, score, best_score)
    result[has] = best
    return result, n


def judged(model: Model, column: pa.Array) -> Iterator[tuple[str, float, list[str], list[float]]]:
    """Language, its share, all languages and their shares of each text of a column without nulls."""
    _, at = string_bytes(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + TOGETHER, "right")) - 1)
        texts = column.slice(first, last - first).to_pylist()
        for text, row, many in zip(texts, *shares(model, texts)):
            if not many or not row.any() or not _LETTER.search(text):
                yield UNKNOWN, 0.0, [], []
                continue
            order = [i for i in np.argsort(-row, kind="stable") if row[i] > 0]
            yield model.languages[order[0]], min(1.0, float(row[order[0]])), [model.languages[i] for i in order], [float(row[i]) for i in order]
        first = last


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, languages, proportions of every document; `languages` have the best penalised likelihood.

    lang_pred has the largest share, which is the score. A null text, or one without a letter, is `und` with score 0, as
    is every text where nothing was learned; letters that no trigram can be made of give `und` too. Repeated rows are
    read each and null ids stay null. Only id and text are read. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            preds, scores, sets, parts = zip(*judged(shared.value, batch.column(1))) if len(batch) else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))],
                ["doc_id", "lang_pred", "score", "languages", "proportions"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, languages array<string>, proportions array<double>")


def identified(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """The rows of docs, all columns, whose language is known with at least that share; null texts are not among them.

    With `lang_col` a null there becomes the language that was found; what is stated stays. Ids are not looked at, repeated
    rows are judged alike, other columns of any name are passed on. An empty table gives no row.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)
    filled = None if lang_col is None else docs.columns.index(lang_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = [(lang, score) for lang, score, _, _ in judged(shared.value, batch.column(place).fill_null(""))]
            good = pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_())
            if filled is not None:
                langs = batch.column(filled)
                batch = batch.set_column(filled, batch.schema.field(filled), pc.coalesce(langs, pa.array([lang for lang, _ in found], langs.type)))
            yield batch.filter(good)

    return docs.mapInArrow(keep, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the documents, by checksum of the id; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Fit on the documents that are not held out, then identify every document; see `fit` and `identify`."""
    model = fit(docs.filter(~held_out(id_col)), id_col, text_col, lang_col, train_docs)
    return identify(docs, model, id_col, text_col).withColumn("held_out", held_out("doc_id"))
