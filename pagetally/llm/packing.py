"""Best-fit packing planned on the histogram of lengths.

There are at most `capacity` different lengths, so the plan is made over counts on the driver and stays small at any
number of documents; pieces then take the planned slots by their rank within their length.
"""
from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import REMEMBERED, Splitter
from .common import held, small_batches, written


class Ids(dict):
    """The ids of each piece as little-endian bytes, from the tokenizers library; pieces met before are not asked again."""

    def __init__(self, splitter: Splitter):
        super().__init__()
        self.encode = splitter.tokenizer.encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        made = self[piece] = np.asarray(self.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        return made


def _encoder(path: str) -> tuple[Splitter, Ids]:
    splitter = Splitter(path)
    return splitter, Ids(splitter)


def token_ids(text: str, path: str) -> bytes:
    """As the library encodes the whole text: its split depends on nothing outside a piece once the pieces are known."""
    splitter, ids = held(f"ids of {path}", lambda: _encoder(path))
    parts = [
        np.uint32(special).astype("<u4").tobytes() if special is not None else b"".join(map(ids.__getitem__, splitter.pieces(part)))
        for part, special in splitter.parts(text)
    ]
    return b"".join(parts)


def cut_into_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, part, rank): rank counts the pieces of that length in one task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        last = np.uint32(end_id).astype("<u4").tobytes()
        for batch in batches:
            of, rows = [], ([], [], [], [], [])
            for i, text in enumerate(batch.column(1)):
                ids = token_ids(text.as_py() or "", path) + last
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    # only the first piece may be short
                    length = (n - start) % capacity or capacity
                    of.append(i)
                    row = piece, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), seen[length]
                    for column, value in zip(rows, row):
                        column.append(value)
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            kinds = pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()
            columns = [pa.array(x, kind) for x, kind in zip(rows, kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), *columns, pa.array([part] * len(of), pa.int32())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "part"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, rank long, part int")


@dataclass(frozen=True)
class Slot:
    """Pieces of one length from rank `first`: `per` of them one after another in each sequence from `sequence`."""

    length: int
    first: int
    sequence: int
    offset: int
    per: int


def plan(counts: dict[int, int], capacity: int) -> list[Slot]:
    """Best fit with the longest first, over counts: the same sequences as piece by piece.

    Sequences of equal room are kept as runs of numbers. A length takes runs whole, but for its last, and opens at most
    two, so slots are bounded by the square of `capacity`, whatever the counts are.
    """
    slots: list[Slot] = []
    rooms: list[int] = []  # of runs that still have room, rising
    runs: dict[int, list[tuple[int, int]]] = {}
    opened = 0

    def put(room: int, run: tuple[int, int]) -> None:
        if room <= 0 or run[1] <= 0:
            return
        if room not in runs:
            bisect.insort(rooms, room)
            runs[room] = []
        runs[room].append(run)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not between 1 and {capacity}")
        left, rank = counts[length], 0
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                break
            room = rooms[i]
            first, many = runs[room].pop()
            if not runs[room]:
                del runs[room], rooms[i]
            # best fit gives a sequence all pieces of this length that fit before the next roomier one
            per = room // length
            full = min(many, left // per)
            if full:
                slots.append(Slot(length, rank, first, capacity - room, per))
                put(room - per * length, (first, full))
                rank, left = rank + full * per, left - full * per
            rest = many - full
            if rest and left and left < per:
                slots.append(Slot(length, rank, first + full, capacity - room, left))
                put(room - left * length, (first + full, 1))
                rank, left, full, rest = rank + left, 0, full + 1, rest - 1
            put(room, (first + full, rest))
        per = capacity // length
        full, over = divmod(left, per)
        if full:
            slots.append(Slot(length, rank, opened, 0, per))
            put(capacity - per * length, (opened, full))
            opened, rank = opened + full, rank + full * per
        if over:
            slots.append(Slot(length, rank, opened, 0, over))
            put(capacity - over * length, (opened, 1))
            opened += 1
    return slots


def pack(
    docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and `end_id`; one longer than `capacity` is cut into pieces of that length, the first
    of which may be shorter. A null text is empty and so one id long. Repeated rows and rows with a null id are packed
    each. An empty table gives no row. Columns of other names are not read.

    A length may hold any share of all pieces: ranks are counted in each task of the scan, and only the totals of
    (length, task) are added up, so nothing of a hot length is gathered.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = written(cut_into_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    totals = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = written(totals.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "totals")
    # at most `capacity` rows
    counts = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan(counts, capacity)
    planned = spark.sparkContext.broadcast(
        (np.array([(s.length, s.first) for s in slots], np.int64).reshape(-1, 2), np.array([(s.sequence, s.offset, s.per) for s in slots], np.int64).reshape(-1, 3))
    )
    most = max(counts.values(), default=0) + 1

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places = planned.value
        starts = keys[:, 0] * most + keys[:, 1]
        order = np.argsort(starts, kind="stable")
        starts = starts[order]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = order[np.searchsorted(starts, length * most + rank, "right") - 1]
            step = rank - keys[at, 1]
            sequence = places[at, 0] + step // places[at, 2]
            offset = places[at, 1] + step % places[at, 2] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = pieces.join(totals.select("length", "part", "before"), ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank")
    )
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(placed, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
