"""Helpers of the operators: tables in the shared folder, and texts of Arrow batches as byte arrays."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task looks at together; a longer text is looked at alone.
CHUNK_BYTES = 1 << 18
#: Rows of an Arrow batch, and the setting of Spark; its default of 10,000 whole texts would be large.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"

#: What a Python worker keeps from task to task.
_HELD: dict[str, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session without the setting gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pagetally-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, which outlives lost executors; removed when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from now on, unless the session asks for fewer."""
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def held(name: str, make: Callable[[], object]) -> object:
    """What `make` gives, made once in a Python worker."""
    if name not in _HELD:
        _HELD[name] = make()
    return _HELD[name]


def forget() -> None:
    """Let go of what tasks of other operators left in this Python worker."""
    if _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, key, text; a null text is empty. Rows of equal id and key are the same document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.hash(text).alias("key"), text.alias("text"))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names behind as many underscores as it takes for none to be a column of docs."""
    taken, before = {c.lower() for c in docs.columns}, "_"
    while any(before + n in taken for n in names):
        before += "_"
    return [before + n for n in names]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings and where each begins and ends in them, without a copy."""
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with at most that many bytes (one row at least): first, past the last, bytes, offsets from 0."""
    if not len(column):
        return
    data, at = string_bytes(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        last = min(last, len(column))
        yield first, last, data[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (multiply, shift, exclusive or)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def until(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            factors = np.full(size, self.base, np.uint64)
            factors[0] = 1
            self.up = np.cumprod(factors)
            factors[1:] = self.inverse
            self.down = np.cumprod(factors)
        return self.up, self.down


class Runs:
    """Hashes of any runs of symbols in constant time each: prefix sums of symbol times power of the base.

    `symbols` are well mixed 64-bit numbers. Equal runs have equal hashes wherever they stand.
    """

    powers = Powers(0x9E3779B97F4A7C15)

    def __init__(self, symbols: np.ndarray):
        up, self.down = self.powers.until(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[:len(symbols)], out=self.sums[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin] + np.asarray(end - begin).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        """Of the runs of one length that begin at each symbol, as far as they fit."""
        n = max(0, len(self.sums) - length)
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n] + np.uint64(length))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_SYMBOLS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
#: Bytes with A-Z made small; UTF-8 bytes above 127 stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _BYTE_SYMBOLS[data]


def words(data: np.ndarray, at: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all texts: where each begins and ends, and the number of the first word of each text.

    `outside` says of each byte value whether it stands between words.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~outside[data]
    begin, end = inside.copy(), inside.copy()
    edge = at[(at > 0) & (at < len(data))]
    before = inside[:-1].copy()
    before[edge - 1] = False
    begin[1:] &= ~before
    after = inside[1:].copy()
    after[edge - 1] = False
    end[:-1] &= ~after
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begins, ends, np.searchsorted(begins, at)


def word_symbols(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Runs(byte_symbols(data)).hashes(begins, ends)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in a row that agree in the first column, as one table each; a group may go over several batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(batch)]
        for low, high in zip(edges[:-1], edges[1:]):
            if held and held[0].column(0)[0].as_py() != key[low]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
