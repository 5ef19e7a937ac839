"""Byte passages that occur more than once, over a logarithmic family of suffix arrays.

Documents come in batches. A batch gets the array of its sampled suffixes, each once with its count; it is joined by
merging with the arrays that are there already, one for each level, for suffixes that begin alike; then arrays of equal
size merge, so that after any number of batches there are few levels, each twice the one below. An array holds only
hashes and counts; where a suffix that was met stands is looked up once, after the last batch. Suffixes are sampled by content, so that
every string of `length` bytes holds a sampled one at a place that its bytes decide; they are told
apart by the hash of their first `gram` bytes. Suffixes that begin alike are then extended both ways.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Runs, byte_symbols, chunks, groups, signed, texts, written
from .repeats import as_spans, covered, runs_of, with_passages
from .winnow import spans

#: Bytes of a repeated string, bytes by which suffixes meet, and batches that the documents of a table are taken in.
LENGTH, GRAM, BATCHES = 200, 24, 4
#: Different surroundings of a suffix that are compared in one task; with more of them, window by window through Spark.
TOGETHER = 4096


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def sampled(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(suffix, run, doc_id, key, begin, n): strings of `length` bytes from begin on, n in a row, hold this suffix; run hashes all their bytes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, at in chunks(batch.column(2)):
                runs = Runs(byte_symbols(data))
                begin, n, _, suffix = spans(runs, at, length, gram)
                run = runs.hashes(begin, begin + n - 1 + length)
                doc = np.searchsorted(at, begin, "right") - 1
                take = pa.array(first + doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(suffix)), pa.array(signed(run)), batch.column(0).take(take), batch.column(1).take(take),
                     pa.array((begin - at[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["suffix", "run", "doc_id", "key", "begin", "n"],
                )

    return rows.mapInArrow(find, f"suffix long, run long, doc_id {_kind(rows)}, key int, begin int, n int")


class Family:
    """Arrays of suffixes with their counts, one for each level that is filled: level i holds 2**i batches."""

    def __init__(self):
        self.entries: list[DataFrame] = []
        self.levels: dict[int, DataFrame] = {}
        self.met: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """Take in a batch (suffix, run, doc_id, key, begin, n): meet its own suffixes and every level's, then merge."""
        # as they come: by suffix, all of a hot one would go to one task
        entries = written(batch, "suffixes")
        self.entries.append(entries)
        # the array of a level needs no more than the suffixes
        array = written(entries.groupBy("suffix").agg(F.count(F.lit(1)).alias("many")), "array")
        self.met.append(array.filter("many > 1").select("suffix"))
        for level in self.levels.values():
            self.met.append(array.join(level.hint("merge"), "suffix", "left_semi").select("suffix"))
        size = 0
        while size in self.levels:
            array = written(array.union(self.levels.pop(size)).groupBy("suffix").agg(F.sum("many").alias("many")), "array")
            size += 1
        self.levels[size] = array

    def meeting(self) -> DataFrame:
        """The entries of all suffixes that occur more than once."""
        # written before it is joined: Spark can then split a hot suffix among tasks
        met = written(reduce(DataFrame.union, self.met).distinct(), "met")
        return written(reduce(DataFrame.union, self.entries).join(met, "suffix", "left_semi"), "met-suffixes")


def surroundings(rows: DataFrame, length: int) -> DataFrame:
    """Of rows (text, opened: array of (suffix, run, begin, n, several)): (suffix, run, n, several, bytes), the bytes of each run."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, opened in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = text.as_py().encode()
                for x in opened:
                    found.append((x["suffix"], x["run"], x["n"], x["several"], raw[x["begin"]:x["begin"] + x["n"] - 1 + length]))
            columns = list(zip(*found)) or [()] * 5
            kinds = pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], ["suffix", "run", "n", "several", "bytes"])

    return rows.select("text", "opened").mapInArrow(cut, "suffix long, run long, n int, several long, bytes binary")


def _windows(column: pa.Array, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all strings of `length` bytes in each value, the value's number, and their place in it."""
    _, offsets, raw = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8)[at[0]:at[-1]]
    which = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    where = (at[:-1] - at[0])[which] + place
    return Runs(byte_symbols(data)).hashes(where, where + length), which, place


def extended(around: DataFrame, length: int) -> DataFrame:
    """(suffix, run, places: array of (begin, end)): the strings of each run that another run of its suffix has as well.

    Strings are numbered within their run, and a place stands for those from begin to end, without it.
    """
    schema = "suffix long, run long, places array<struct<begin:int,end:int>>"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            n = table.column(2).to_numpy()
            window, which, place = _windows(table.column(3).combine_chunks(), n, length)
            _, back, counts = np.unique(window, return_inverse=True, return_counts=True)
            again = counts[back] > 1
            if not again.any():
                continue
            where = np.flatnonzero(again)
            new = np.ones(len(where), bool)
            new[1:] = (where[1:] != where[:-1] + 1) | (which[where[1:]] != which[where[:-1]])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(where)) - 1
            begin, end = place[where[head]].astype(np.int32), place[where[tail]].astype(np.int32) + np.int32(1)
            runs, first = np.unique(which[where[head]], return_index=True)
            pairs = pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], ["begin", "end"])
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(head)).astype(np.int32)), pairs)
            take = pa.array(runs)
            yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks().take(take), table.column(1).combine_chunks().take(take), places], ["suffix", "run", "places"])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.slice(low, 1000)
                window, which, place = _windows(part.column(3), part.column(2).to_numpy(), length)
                take = pa.array(which)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(place.astype(np.int32)), pa.array(signed(window))], ["suffix", "run", "place", "window"])

    few = around.filter(F.col("several") <= TOGETHER).select("suffix", "run", "n", "bytes").repartition("suffix").sortWithinPartitions("suffix")
    many = around.filter(F.col("several") > TOGETHER).select("suffix", "run", "n", "bytes").mapInArrow(explode, "suffix long, run long, place int, window long")
    again = many.groupBy("suffix", "window").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("suffix", "window")
    many = many.join(again, ["suffix", "window"]).groupBy("suffix", "run").agg(F.collect_list(F.struct(F.col("place").alias("begin"), (F.col("place") + 1).alias("end"))).alias("places"))
    return few.mapInArrow(compare, schema).union(many)


def repeated_bytes(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """(doc_id, key, passages: array of (begin, end)) in bytes: strings of `length` bytes that also begin anywhere else.

    `rows`: doc_id, key, text, as `common.texts` gives them. Passages may overlap; documents without one are not returned.
    """
    family = Family()
    for i in range(batches):
        family.add(sampled(rows.filter(F.pmod(F.hash("doc_id"), F.lit(batches)) == i), length, gram))
    entries = family.meeting()
    classes = entries.groupBy("suffix", "run").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "key", "begin", "n")).alias("first"))
    classes = written(classes.select("suffix", "run", "times", "first.*"), "classes")
    several = classes.groupBy("suffix").agg(F.count(F.lit(1)).alias("several")).filter("several > 1")
    several = written(several, "several")
    opened = (
        classes.join(several, "suffix").groupBy("doc_id", "key")
        .agg(F.collect_list(F.struct("suffix", "run", "begin", "n", "several")).alias("opened"))
        .select(F.col("doc_id").alias("opened_id"), F.col("key").alias("opened_key"), "opened")
    )
    same = F.col("doc_id").eqNullSafe(F.col("opened_id")) & (F.col("key") == F.col("opened_key"))
    # repeated rows give their surroundings twice, which must not count as another run
    around = written(surroundings(rows.join(opened.hint("shuffle_hash"), same), length).dropDuplicates(["suffix", "run"]), "surroundings")
    marks = written(extended(around, length), "marks")
    judged = classes.join(marks, ["suffix", "run"], "left").filter("places is not null or times > 1").select("suffix", "run", "times", "places")
    judged = written(judged, "judged")
    found = entries.join(judged, ["suffix", "run"]).select(
        "doc_id", "key",
        F.when(F.col("times") > 1, F.array(F.struct(F.col("begin").alias("begin"), (F.col("begin") + F.col("n") + (length - 1)).alias("end"))))
        .otherwise(F.transform("places", lambda p: F.struct((F.col("begin") + p["begin"]).alias("begin"), (F.col("begin") + p["end"] + (length - 1)).alias("end"))))
        .alias("passages"),
    )
    return found.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("passages")).alias("passages"))


def remove_repeated_bytes(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans and kept (bytes) of every document.

    A byte goes if a string of `length` bytes of its document that covers it begins anywhere else, too, in the same or
    another document; all strings are judged on the input, none crosses documents. `spans` are the removed runs of bytes.
    All copies go, the first as well: repeated rows (same id, same text) are copies of each other. A null text is empty;
    a null id takes part like any other. Columns of other names are not read. An empty table gives no row.
    """
    rows = texts(docs, id_col, text_col)
    found = repeated_bytes(rows, length, gram, batches).select(F.col("doc_id").alias("found_id"), F.col("key").alias("found_key"), "passages")
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key"))
    kind = _kind(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, runs, kept = [], [], [], []
            for text, begin, end in with_passages(batch.column(1), batch.column(2)):
                raw = text.encode()
                out = covered(begin, end, len(raw))
                total.append(len(raw)), gone.append(int(out.sum())), runs.append(runs_of(out))
                kept.append(np.frombuffer(raw, np.uint8)[~out].tobytes() if len(begin) else raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                 as_spans(runs), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )

    both = rows.join(found.hint("shuffle_hash"), same, "left").select("doc_id", "text", "passages")
    return both.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept binary")
