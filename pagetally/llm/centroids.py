"""Exact k-means over integer vectors by subvector dictionaries.

Vectors are taken a few thousand at a time. The dimensions of such a group are split in blocks; each block has a
dictionary of its distinct subvectors, and a vector is a code for each block. In a round a group works out the distance
of each dictionary entry to each centroid once; the distance of a vector is the sum of what its codes say. Sums of
clusters are counts of codes times dictionary entries. The encoding loses nothing, so all numbers are exact.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import forget, written

#: Vectors that share dictionaries.
GROUP = 4096
#: Components are below this, so that a squared distance of up to 64 of them fits into 64 bits.
LARGEST = 1 << 27
CENTROIDS, ROUNDS, SCALE, SEED = 8, 10, 1024, 3
#: Bytes of an Arrow batch of encoded groups.
BATCH_BYTES, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
ENCODED = "codes binary, sizes binary, entries binary"


@dataclass
class Encoded:
    """Vectors of a group: `codes` (blocks x vectors, counted over all dictionaries), `sizes` and `entries` of the dictionaries."""

    codes: np.ndarray
    sizes: np.ndarray
    entries: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray) -> Encoded:
        """Dictionaries of blocks of 1, 2, 4, ... dimensions, as long as wider blocks mean less work: entries and codes to look at."""
        columns = [np.unique(column, return_inverse=True) for column in vectors.T]
        entries = [values[:, None] for values, _ in columns]
        codes = [code.astype(np.int64) for _, code in columns]
        while len(codes) > 1 and len(codes) % 2 == 0:
            wider, wider_codes = [], []
            for i in range(0, len(codes), 2):
                pairs, code = np.unique(codes[i] * len(entries[i + 1]) + codes[i + 1], return_inverse=True)
                wider.append(np.hstack([entries[i][pairs // len(entries[i + 1])], entries[i + 1][pairs % len(entries[i + 1])]]))
                wider_codes.append(code.astype(np.int64))
            if sum(e.size for e in wider) + sum(map(len, wider_codes)) >= sum(e.size for e in entries) + sum(map(len, codes)):
                break
            entries, codes = wider, wider_codes
        sizes = np.array([len(e) for e in entries])
        first = np.cumsum(sizes) - sizes
        return cls(np.stack(codes) + first[:, None], sizes, np.concatenate(entries))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return self.codes.astype(np.int32).tobytes(), self.sizes.astype(np.int32).tobytes(), self.entries.astype(np.int32).tobytes()

    @classmethod
    def unpacked(cls, codes: bytes, sizes: bytes, entries: bytes) -> Encoded:
        counts = np.frombuffer(sizes, np.int32).astype(np.int64)
        return cls(
            np.frombuffer(codes, np.int32).reshape(len(counts), -1), counts, np.frombuffer(entries, np.int32).astype(np.int64).reshape(counts.sum(), -1)
        )

    def vectors(self) -> np.ndarray:
        return np.concatenate([self.entries[code] for code in self.codes], axis=1)

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector the nearest centroid, of equals the first, and the squared distance."""
        width = self.entries.shape[1]
        block = np.repeat(np.arange(len(self.sizes)), self.sizes)
        apart = np.empty((len(self.entries), len(centroids)), np.int64)
        for i, centroid in enumerate(centroids):
            difference = self.entries - centroid.reshape(-1, width)[block]
            apart[:, i] = (difference * difference).sum(1)
        total = np.zeros((self.codes.shape[1], len(centroids)), np.int64)
        for code in self.codes:
            total += apart[code]
        best = total.argmin(1)
        return best, total[np.arange(len(best)), best]

    def sums(self, cluster: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each cluster the sum of its vectors and their count."""
        width = self.entries.shape[1]
        total = np.zeros((n, len(self.sizes) * width), np.int64)
        first = 0
        for i, (code, size) in enumerate(zip(self.codes, self.sizes.tolist())):
            counts = np.bincount((code - first) + cluster * size, minlength=n * size).reshape(n, size)
            total[:, i * width:(i + 1) * width] = counts @ self.entries[first:first + size]
            first += size
        return total, np.bincount(cluster, minlength=n)


def kept_vectors(table: DataFrame, dimensions: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows whose vector has exactly that many components, none null, NaN or infinite."""
    vector = F.transform(vector_col, lambda x: x.cast("double"))
    good = (F.size(vector_col) == dimensions) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.select(F.col(id_col).alias("vec_id"), vector.alias("vector")).filter(good)


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    made = np.floor(vectors * float(scale))
    if (np.abs(made) >= LARGEST).any():
        raise ValueError(f"components must be below {LARGEST / scale:.0f}, so that distances fit into 64 bits")
    return made.astype(np.int64)


def encode(rows: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """(vec_ids, codes, sizes, entries): groups of at most GROUP vectors."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for first in range(0, len(batch), GROUP):
                part = batch.slice(first, GROUP)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
                packed = Encoded.of(whole_numbers(values, scale)).packed()
                ids = part.column(0)
                listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([listed, *[pa.array([x], pa.binary()) for x in packed]], ["vec_ids", "codes", "sizes", "entries"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(groups, f"vec_ids array<{kind}>, {ENCODED}")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Encoded]]:
    forget()
    for batch in batches:
        for i in range(len(batch)):
            yield batch.column("vec_ids").slice(i, 1).flatten(), Encoded.unpacked(*[batch.column(c)[i].as_py() for c in ("codes", "sizes", "entries")])


def next_centroids(encoded: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: the floor of the mean of each cluster; an empty cluster keeps its centroid.

    A task gives one row for each cluster it meets, so rows are few; they are added up by cluster in a shuffle, and as
    many rows as there are centroids reach the driver.
    """
    n, width = len(centroids), len(centroids[0])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # in Python's whole numbers between groups: a task may hold any number of them
        total, count = np.zeros((n, width), object), np.zeros(n, object)
        for _, group in _groups(batches):
            cluster, _ = group.nearest(np.array(centroids, np.int64))
            sums, many = group.sums(cluster, n)
            total, count = total + sums.astype(object), count + many.astype(object)
        met = [i for i in range(n) if count[i]]
        rows = [(i, d, total[i, d], count[i]) for i in met for d in range(width)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *[pa.array([int(r[i]) for r in rows], pa.decimal128(38, 0)) for i in (2, 3)]],
            ["cluster", "dimension", "total", "many"],
        )

    parts = encoded.mapInArrow(partial, "cluster int, dimension int, total decimal(38,0), many decimal(38,0)")
    added = parts.groupBy("cluster", "dimension").agg(F.sum("total").alias("total"), F.sum("many").alias("many"))
    made = [list(c) for c in centroids]
    for row in added.collect():
        made[row.cluster][row.dimension] = int(row.total) // int(row.many)
    return made


def assigned(encoded: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    spread = encoded.schema["vec_ids"].dataType.elementType

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, group in _groups(batches):
            cluster, distance = group.nearest(np.array(centroids, np.int64))
            yield pa.RecordBatch.from_arrays([ids.cast(to_arrow_type(spread)), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return encoded.mapInArrow(assign, f"vec_id {spread.simpleString()}, cluster int, distance long")


def first_centroids(rows: DataFrame, n: int, seed: int, scale: int) -> list[list[int]]:
    """The vectors with the least sha256 of seed and id; rows of equal id by their components."""
    lot = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    # n rows reach the driver
    first = rows.orderBy(lot, "vector").limit(n).select("vector").collect()
    return [whole_numbers(np.array(row.vector, float), scale).tolist() for row in first]


def cluster_vectors(
    table: DataFrame, n: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = 64, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept.

    Vectors of another number of components, or with one that is null, NaN or infinite, are left out, as are null vectors.
    A component x counts as floor(scale * x). Centroids begin as the n kept vectors with the least sha256 of
    `seed:id`; of fewer vectors there are fewer centroids, of none the result is empty. Equal vectors may give equal
    centroids: the smaller number then gets all, the other stays as it is. Repeated rows count each, null ids stay null.
    Components of 2**27 / scale or more are refused: their distances don't fit. Other columns are not read. Encoded groups
    are written once and read in each round; only sums of clusters are shuffled.
    """
    spark = table.sparkSession
    rows = kept_vectors(table, dimensions, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(rows, n, seed, scale)
    if not centroids:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    encoded = written(encode(rows, dimensions, scale), "vector-groups")
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        for _ in range(rounds):
            made = next_centroids(encoded, centroids)
            if made == centroids:
                break  # and so would all further rounds
            centroids = made
        placed = written(assigned(encoded, centroids), "vector-clusters")
    finally:
        spark.conf.set(BATCH_SETTING, before)
    # n rows reach the driver
    inertia = {r.cluster: int(r.total) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = F.array(*[F.lit(inertia.get(i, 0)).cast("long") for i in range(len(centroids))])
    return placed.select(
        "vec_id", "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        F.get(F.array(*map(F.lit, digests)), F.col("cluster")).alias("centroid_sha256"),
    )
