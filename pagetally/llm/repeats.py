"""Passages that repeat across documents, by seed and extend over words.

Seeds are winnowed anchors: every window of `length` words holds one, at a place that its words decide. Documents meet
on equal anchors. A match is extended both ways over the windows around the anchor: first all of them at once (equal
runs of windows fall together in a class, so a group of copies is one class, and only its first document goes on), then
window by window between the different classes of an anchor. What results are the maximal repeats of at least `length`
words. No pair of documents is ever listed.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Runs, chunks, forget, signed, small_batches, texts, unused, word_symbols, words, written
from .winnow import spans

#: Words of a removed passage, and of an anchor.
LENGTH, GRAM = 50, 8


def _kind(df: DataFrame, column: str = "doc_id") -> str:
    return df.schema[column].dataType.simpleString()


def find_seeds(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, run, doc_id, key, begin, n): windows begin, ..., begin + n - 1 (in words) have this anchor; run hashes all their words."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for first, last, data, at in chunks(batch.column(2)):
                begins, ends, starts = words(data, at)
                runs = Runs(word_symbols(data, begins, ends))
                begin, n, _, anchor = spans(runs, starts, length, gram)
                run = runs.hashes(begin, begin + n - 1 + length)
                doc = np.searchsorted(starts, begin, "right") - 1
                # a text without words begins where the next one does
                take = pa.array(first + doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(anchor)), pa.array(signed(run)), batch.column(0).take(take), batch.column(1).take(take),
                     pa.array((begin - starts[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["anchor", "run", "doc_id", "key", "begin", "n"],
                )

    return rows.mapInArrow(find, f"anchor long, run long, doc_id {_kind(rows)}, key int, begin int, n int")


def open_windows(rows: DataFrame, length: int) -> DataFrame:
    """Of rows (doc_id, key, text, opened: array of (anchor, run, begin, n)): a row (anchor, run, place, window, doc_id) for each window."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            lists = batch.column(2)
            for first, last, data, at in chunks(batch.column(1)):
                begins, ends, starts = words(data, at)
                runs = Runs(word_symbols(data, begins, ends))
                part = lists.slice(first, last - first)
                flat = part.flatten()
                anchor, run, begin, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                doc = np.repeat(np.arange(last - first), np.diff(np.asarray(part.offsets)))
                which = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                where = starts[doc][which] + begin[which] + place
                window = runs.hashes(where, where + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[which]), pa.array(run[which]), pa.array(place.astype(np.int32)), pa.array(signed(window)), batch.column(0).take(pa.array(first + doc[which]))],
                    ["anchor", "run", "place", "window", "doc_id"],
                )

    return rows.select("doc_id", "text", "opened").mapInArrow(find, f"anchor long, run long, place int, window long, doc_id {_kind(rows)}")


def repeats(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, key, passages: array of (begin, end)) in words: what a document with a smaller id has as well.

    `rows`: doc_id, key, text, as `common.texts` gives them. A passage's windows all begin in such a document too;
    passages may overlap. Documents without a passage, and rows with a null id, are not returned.
    """
    small_batches(rows.sparkSession)
    seeds = written(find_seeds(rows.filter("doc_id is not null"), length, gram), "seeds")
    # anchors of a single document end here
    # small tables are written before they are joined: Spark can then split a hot anchor among tasks
    met = written(seeds.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor"), "met")
    seeds = written(seeds.join(met, "anchor", "left_semi"), "met-seeds")

    # equal runs are one class, and its first occurrence stands for it
    classes = seeds.groupBy("anchor", "run").agg(F.min(F.struct("doc_id", "key", "begin", "n")).alias("first"), F.max("doc_id").alias("last_id"))
    classes = written(classes.select("anchor", "run", "first.*", "last_id"), "classes")
    several = written(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("anchor"), "several")
    opened = (
        classes.join(several, "anchor", "left_semi")
        .groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "run", "begin", "n")).alias("opened"))
    )
    # the lists of a document are smaller than its text
    windows = written(open_windows(rows.join(opened.hint("shuffle_hash"), ["doc_id", "key"]), length), "windows")
    firsts = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor", "window", F.col("a").alias("first_id"))
    firsts = written(firsts, "firsts")
    repeated = (
        windows.join(firsts, ["anchor", "window"]).filter("first_id < doc_id")
        .groupBy("anchor", "run").agg(F.collect_set("place").alias("places"))
    )
    # in the first document of a class only windows of other classes count, in later ones all
    judged = classes.join(repeated, ["anchor", "run"], "left").filter("places is not null or last_id > doc_id").select("anchor", "run", F.col("doc_id").alias("first_id"), "places")
    judged = written(judged, "judged")
    found = seeds.join(judged, ["anchor", "run"]).select(
        "doc_id", "key",
        F.when(F.col("doc_id") > F.col("first_id"), F.array(F.struct(F.col("begin").alias("begin"), (F.col("begin") + F.col("n") + (length - 1)).alias("end"))))
        .otherwise(F.transform(F.coalesce("places", F.array().cast("array<int>")), lambda p: F.struct((F.col("begin") + p).alias("begin"), (F.col("begin") + p + length).alias("end"))))
        .alias("passages"),
    )
    return (
        found.filter(F.size("passages") > 0).groupBy("doc_id", "key")
        .agg(F.flatten(F.collect_list("passages")).alias("passages"))
    )


def covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n words (or bytes) some passage covers."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def with_passages(texts: pa.Array, passages: pa.Array) -> Iterator[tuple[str | None, np.ndarray, np.ndarray]]:
    """Each text with the begins and ends of its passages, which may be null."""
    at = np.asarray(passages.offsets) - passages.offsets[0].as_py() if len(passages) else np.zeros(1, np.int64)
    both = passages.flatten()
    # a null list has no part in the flat values, and equal offsets
    begin, end = (both.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    for i, text in enumerate(texts):
        yield text.as_py(), begin[at[i]:at[i + 1]], end[at[i]:at[i + 1]]


def runs_of(out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of True begin and end."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], out, [False]))))
    return edges[::2], edges[1::2]


def as_spans(runs: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """A column of arrays of (begin, end)."""
    ends = np.cumsum([0, *(len(a) for a, _ in runs)]).astype(np.int32)
    begin, end = (np.concatenate([x[i] for x in runs] or [np.zeros(0)]).astype(np.int64) for i in (0, 1))
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], ["begin", "end"]))


def without(text: str, begin: np.ndarray, end: np.ndarray) -> tuple[str, np.ndarray]:
    """The words that no passage covers, joined by one space, and which go."""
    every = text.encode().split()
    out = covered(begin, end, len(every))
    return b" ".join([w for w, gone in zip(every, out.tolist()) if not gone]).decode(), out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, passages and kept of every document: what stays when repeated passages go.

    A word goes if a window of `length` words of its document that covers it begins in a document with a smaller id,
    too; all windows are judged on the input. `kept` is the input text where nothing goes, else the words that stay,
    joined by one space. `passages` are the removed runs of words, (begin, end). A null text stays null and has no
    words; rows with a null id lose nothing and take nothing from others. Repeated rows (same id, same text) are one
    document and come back each; a document repeating itself keeps both. Columns of other names are not read. An
    empty table gives no row.
    """
    rows = texts(docs, id_col, text_col)
    found = repeats(rows, length, gram)
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.hash(F.coalesce("text", F.lit(""))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            total, gone, runs, kept = [], [], [], []
            for text, begin, end in with_passages(batch.column(1), batch.column(2)):
                if len(begin):
                    text, out = without(text, begin, end)
                else:
                    out = np.zeros(len((text or "").encode().split()), bool)
                total.append(len(out)), gone.append(int(out.sum())), runs.append(runs_of(out)), kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                 as_spans(runs), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "passages", "kept"],
            )

    both = whole.join(found.hint("shuffle_hash"), ["doc_id", "key"], "left").select("doc_id", "text", "passages")
    return both.mapInArrow(cut, f"doc_id {_kind(whole)}, n_words long, n_removed long, passages array<struct<begin:long,end:long>>, kept string")


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with the text that `remove_repeats` keeps; documents of which nothing stays are left out.

    Null texts, empty texts and rows with a null id stay as they are, repeated rows stay each, other columns of any name
    are passed on. An empty table gives no row.
    """
    key, found_id, found_key, passages = unused(docs, "key", "found_id", "found_key", "passages")
    found = repeats(texts(docs, id_col, text_col), length, gram).select(F.col("doc_id").alias(found_id), F.col("key").alias(found_key), F.col("passages").alias(passages))
    place, columns = docs.columns.index(text_col), docs.columns
    both = docs.withColumn(key, F.hash(F.coalesce(F.col(text_col), F.lit("")))).join(
        found.hint("shuffle_hash"), (F.col(id_col) == F.col(found_id)) & (F.col(key) == F.col(found_key)), "left"
    ).select(*columns, passages)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            made, good = [], []
            for text, begin, end in with_passages(batch.column(place), batch.column(len(columns))):
                if len(begin):
                    text, _ = without(text, begin, end)
                made.append(text)
                good.append(not len(begin) or bool(text))
            arrays = batch.columns[:len(columns)]
            arrays[place] = pa.array(made, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, columns).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(cut, docs.schema)


def kept_digest(removed: DataFrame) -> DataFrame:
    """kept_sha256 in place of kept: of the words that stay, joined by one space."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [hashlib.sha256(b" ".join((x or "").encode().split())).hexdigest() for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(made, pa.string())], ["doc_id", "n_words", "n_removed", "passages", "kept_sha256"])

    return removed.mapInArrow(digest, f"doc_id {_kind(removed)}, n_words long, n_removed long, passages array<struct<begin:long,end:long>>, kept_sha256 string")
