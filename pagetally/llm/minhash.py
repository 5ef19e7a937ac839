"""Near duplicates by b-bit MinHash: banded minima make candidates, packed low bits judge them, full sets decide.

Documents of equal shingle sets are one class from the start. Within a band's bucket each document is first compared to
one pivot, the document that shares the most buckets, which joins most of a group of near copies to it. Only where a
bucket still holds several components are its documents compared among each other, in blocks within a task; blocks that lie
within one component are not, nor blocks of sizes too far apart for a link. So no list of all pairs is made, and no link
between different components is missed. A bucket with more than its share of all rows is dealt in parts.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Runs, chunks, forget, groups, mixed, signed, small_batches, texts, unused, word_symbols, words, written
from .components import components

#: Minima, low bits kept of each minimum, and how many pairs at the threshold may share no band at most.
MINIMA, LOW, MISSED = 64, 4, 1e-5
#: An estimate this far below the threshold is ruled out: five deviations of it at the threshold.
MARGIN = 0.23
#: Documents, and shingles, of a block.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 19
#: A bucket with more than this part of all rows of all bands is dealt in parts; there are fewer such buckets than this.
HOT_SHARE = 1024

_SEEDS = mixed(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The different shingles of each text (hashed, rising): `size` words, or all of fewer; none without words."""
    lower = LOWER[data]
    begins, ends, starts = words(lower, at)
    runs = Runs(word_symbols(lower, begins, ends))
    every = runs.every(size)
    made = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= size:
            made.append(np.unique(every[a:b - size + 1]))
        else:
            made.append(runs.hashes(np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64))
    return made


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Of sets that are not empty: MINIMA least hashes each."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    made = np.empty((len(sets), MINIMA), np.uint64)
    for i in range(MINIMA):
        made[:, i] = np.minimum.reduceat((joined ^ _SEEDS[2 * i]) * (_SEEDS[2 * i + 1] | np.uint64(1)), starts)
    # multiplication leaves the low bits poor
    return mixed(made)


def packed(least: np.ndarray) -> np.ndarray:
    """The LOW low bits of each minimum, packed in numbers of 64 bits (rows: documents)."""
    per = 64 // LOW
    low = least & np.uint64((1 << LOW) - 1)
    shifts = np.arange(per, dtype=np.uint64) * np.uint64(LOW)
    return (low.reshape(len(least), -1, per) << shifts).sum(2, dtype=np.uint64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (last axis: numbers): equal minima, less those that are equal by chance."""
    differ = a ^ b
    bits = differ
    for i in range(1, LOW):
        bits = bits | differ >> np.uint64(i)
    ones = np.uint64(int("0" * (LOW - 1) + "1", 2) * (((1 << 64) - 1) // ((1 << LOW) - 1)))
    equal = 1 - np.bitwise_count(bits & ones).sum(-1) / MINIMA
    chance = 1 / (1 << LOW)
    return (equal - chance) / (1 - chance)


def estimate_column(a: Column, b: Column) -> Column:
    """The same of two array columns."""
    ones = ((1 << 64) - 1) // ((1 << LOW) - 1)
    ones -= 1 << 64 if ones >= 1 << 63 else 0

    def unequal(x: Column) -> Column:
        spread = reduce(lambda bits, i: bits.bitwiseOR(F.shiftrightunsigned(x, i)), range(1, LOW), x)
        return F.bit_count(spread.bitwiseAND(F.lit(ones))).cast("double")

    parts = F.zip_with(a, b, lambda x, y: unequal(x.bitwiseXOR(y)))
    equal = 1 - F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / MINIMA
    chance = 1 / (1 << LOW)
    return (equal - chance) / (1 - chance)


def missed(percent: int, width: int) -> float:
    """The share of pairs of that similarity that agree in no band of `width` minima."""
    return (1 - (percent / 100) ** width) ** (MINIMA // width)


def band_width(percent: int) -> int:
    """Minima in a band: as many, and so as few chance meetings, as MISSED allows; 4 at 85 percent, 3 at 80."""
    return next((w for w in range(8, 1, -1) if missed(percent, w) <= MISSED), 1)


def sketches(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, key, n, set_a, set_b, bands, signature): set_a and set_b tell sets apart, bands hash the minima in groups."""
    width = band_width(percent)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for first, last, data, at in chunks(batch.column(2)):
                sets = shingle_sets(data, at, size)
                n = np.array([len(s) for s in sets])
                has = np.flatnonzero(n)
                ids = np.zeros((len(sets), 2), np.uint64)
                bands = np.zeros((len(sets), MINIMA // width), np.uint64)
                signature = np.zeros((len(sets), MINIMA * LOW // 64), np.uint64)
                if len(has):
                    full = [sets[i] for i in has]
                    joined, starts = np.concatenate(full), np.cumsum([0, *map(len, full[:-1])])
                    for i in range(2):
                        ids[has, i] = np.add.reduceat(mixed(joined + _SEEDS[i]), starts)
                    least = minima(full)
                    signature[has] = packed(least)
                    grouped = least[:, :MINIMA // width * width].reshape(len(has), -1, width)
                    hashed = np.zeros(grouped.shape[:2], np.uint64)
                    for i in range(width):
                        hashed = mixed(hashed + grouped[:, :, i])
                    bands[has] = hashed
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(n, pa.int64()),
                     pa.array(signed(ids[:, 0].copy())), pa.array(signed(ids[:, 1].copy())), lists(bands), lists(signature)],
                    ["doc_id", "key", "n", "set_a", "set_b", "bands", "signature"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(sketch, f"doc_id {kind}, key int, n long, set_a long, set_b long, bands array<long>, signature array<long>")


def lists(table: np.ndarray) -> pa.ListArray:
    width = table.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * width), pa.array(signed(table.ravel().copy())))


def full_sets(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, key, shingles) of rows (doc_id, key, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for first, last, data, at in chunks(batch.column(2)):
                sets = shingle_sets(data, at, size)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate(sets))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), made], ["doc_id", "key", "shingles"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(make, f"doc_id {kind}, key int, shingles array<long>")


def compared(a: list[np.ndarray], b: list[np.ndarray], wanted: np.ndarray, percent: int) -> np.ndarray:
    """Which wanted pairs of a set of a and one of b have 100 * common >= percent * union, by exact counts."""
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    rows, columns = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
    left, right = np.concatenate([a[i] for i in rows]), np.concatenate([b[j] for j in columns])
    common = np.zeros((len(rows), len(columns)), np.float32)
    shared = np.intersect1d(left, right)
    if len(shared):
        def places(joined: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(shared, joined), len(shared) - 1)
            good = shared[at] == joined
            return np.repeat(np.arange(len(sizes)), sizes)[good], at[good]

        (row, x), (column, y) = places(left, n[rows]), places(right, m[columns])
        # shingles in slices, so that the tables stay small
        step = 4096
        ox, oy = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
        row, x, column, y = row[ox], x[ox], column[oy], y[oy]
        for low in range(0, len(shared), step):
            table_a, table_b = np.zeros((len(rows), step), np.float32), np.zeros((len(columns), step), np.float32)
            i, j = np.searchsorted(x, [low, low + step])
            table_a[row[i:j], x[i:j] - low] = 1
            i, j = np.searchsorted(y, [low, low + step])
            table_b[column[i:j], y[i:j] - low] = 1
            common += table_a @ table_b.T
    # whole numbers below 2**24 are exact in these tables
    counts = common.astype(np.int64)
    union = n[rows][:, None] + m[columns][None, :] - counts
    linked = np.zeros_like(wanted)
    linked[np.ix_(rows, columns)] = 100 * counts >= percent * union
    return linked & wanted


def block_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components among rows (task, side, doc_id, component, signature, shingles), dealt by task."""
    least = percent / 100 - MARGIN

    def links(table: pa.Table) -> tuple[list[int], list[int]]:
        codes = table.column(3).combine_chunks().dictionary_encode().indices.to_numpy()
        side = table.column(1).to_numpy()
        signature = np.array(table.column(4).combine_chunks().flatten()).astype(np.int64).view(np.uint64).reshape(table.num_rows, -1)
        # sides: 0 and 1 of two blocks; 2 of a block with itself
        a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side[0] != 2 else (np.flatnonzero(side == 2),) * 2
        wanted = codes[a][:, None] != codes[b][None, :]
        if side[0] == 2:
            wanted &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
        i, j = np.nonzero(wanted)
        for low in range(0, len(i), 1 << 16):
            part = slice(low, low + (1 << 16))
            wanted[i[part], j[part]] = estimate(signature[a[i[part]]], signature[b[j[part]]]) >= least
        if not wanted.any():
            return [], []
        flat = table.column(5).combine_chunks()
        offsets, values = np.asarray(flat.offsets), np.asarray(flat.values).view(np.uint64)
        sets = [values[offsets[k]:offsets[k + 1]] for k in range(table.num_rows)]
        found = compared([sets[k] for k in a], [sets[k] for k in b], wanted, percent)
        i, j = np.nonzero(found)
        return a[i].tolist(), b[j].tolist()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for table in groups(batches):
            a, b = links(table)
            ids = table.column(2).combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a, pa.int64())), ids.take(pa.array(b, pa.int64()))], ["a", "b"])

    kind = members.schema["doc_id"].dataType.simpleString()
    dealt = members.repartition("task").sortWithinPartitions("task")
    return dealt.select("task", "side", "doc_id", "component", "signature", "shingles").mapInArrow(look, f"a {kind}, b {kind}")


def near_links(reps: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of the class representatives `reps` that are linked at all; rows: doc_id, key, text."""
    least = percent / 100 - MARGIN
    banded = reps.select("doc_id", "key", "n", "signature", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).filter("members > 1")
    even = max(1, reps.count() * (MINIMA // band_width(percent)) // HOT_SHARE)
    shared = written(shared.withColumn("parts", F.ceil(F.col("members") / even).cast("int")), "shared")
    # fewer than HOT_SHARE rows
    hot = F.broadcast(shared.filter("parts > 1").select("band", "bucket", F.col("parts").alias("dealt")))
    banded = banded.join(hot, ["band", "bucket"], "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.coalesce("dealt", F.lit(1))).cast("int")).drop("dealt")
    met = written(banded.join(in_parts(shared), ["band", "bucket", "part"]), "buckets")
    sets = written(full_sets(rows.join(met.select("doc_id", "key").distinct().hint("shuffle_hash"), ["doc_id", "key"]), size).dropDuplicates(["doc_id", "key"]), "sets")

    # the pivot of a bucket meets the most others over all its bands
    fame = met.groupBy("doc_id", "key").agg(F.sum("members").alias("fame"))
    famed = met.join(fame, ["doc_id", "key"])
    pivots = famed.groupBy("band", "bucket").agg(F.max(F.struct("fame", "doc_id", "key", "n", "signature")).alias("p"), F.first("parts").alias("parts"))
    pivots = written(pivots, "pivots")
    pairs = (
        met.join(in_parts(pivots).drop("parts"), ["band", "bucket", "part"]).filter("doc_id <> p.doc_id or key <> p.key")
        # sizes alone rule out what differs too much
        .filter(f"100 * least(n, p.n) >= {percent} * greatest(n, p.n)")
        .filter(estimate_column(F.col("signature"), F.col("p.signature")) >= least)
        .select("doc_id", "key", "n", F.col("p.doc_id").alias("pivot_id"), F.col("p.key").alias("pivot_key"), F.col("p.n").alias("pivot_n")).distinct()
    )
    theirs = sets.select(F.col("doc_id").alias("pivot_id"), F.col("key").alias("pivot_key"), F.col("shingles").alias("pivot_shingles"))
    common = F.size(F.array_intersect("shingles", "pivot_shingles"))
    links = written(
        pairs.join(sets, ["doc_id", "key"]).join(theirs, ["pivot_id", "pivot_key"]).withColumn("common", common)
        .filter(f"100 * common >= {percent} * (n + pivot_n - common)").select(F.col("doc_id").alias("a"), F.col("pivot_id").alias("b")),
        "links",
    )
    joined = written(components(links), "joined")

    # where a bucket of more than a pair still holds several components, its members are compared in blocks;
    # bands whose buckets have the same members say the same
    labelled = met.filter("members > 2").join(joined.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    hashes = [F.sum(F.xxhash64(F.lit(i), "doc_id", "key").cast("decimal(38,0)")).alias(f"h{i}") for i in range(2)]
    several = labelled.groupBy("band", "bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.first("members").alias("members"), F.first("parts").alias("parts"), *hashes).filter("a <> b")
    chosen = several.groupBy("members", "h0", "h1").agg(F.min(F.struct("band", "bucket", "parts")).alias("c")).select("c.*")
    chosen = in_parts(written(chosen, "chosen")).drop("parts")
    labelled = written(labelled.join(chosen, ["band", "bucket", "part"]).select("band", "bucket", "part", "parts", "doc_id", "key", "n", "signature", "component"), "open")
    rest = written(block_links(in_blocks(labelled, sets, percent), percent), "links")
    return components(links.union(rest)) if not rest.isEmpty() else joined


def in_parts(df: DataFrame) -> DataFrame:
    """Each row once for each of its `parts`, with its number as `part`."""
    return df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def in_blocks(labelled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (task, side, doc_id, component, signature, shingles): a task for each two blocks of a bucket that can hold a link.

    A component that fills a block has blocks of its own; the others share blocks. Blocks follow each other by size of the
    set, cut by the counts of sizes, so that blocks too far apart in size are not paired. Blocks are paired, not rows.
    """
    bucket = ["band", "bucket"]
    labelled = labelled.withColumn("weight", F.greatest(F.lit(1 / BLOCK_ROWS), F.col("n") / BLOCK_SHINGLES))
    filled = labelled.groupBy(*bucket, "component").agg(F.sum("weight").alias("weight"), F.first("parts").alias("parts")).filter("weight > 1")
    filled = in_parts(filled).select(*bucket, "component", "part", F.lit(True).alias("filled"))
    placed = labelled.join(filled, [*bucket, "component", "part"], "left").withColumn("kind", F.when(F.col("filled"), F.concat(F.lit("own "), F.col("component").cast("string"))).otherwise("shared"))
    before = Window.partitionBy(*bucket, "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*bucket, "kind", "n").agg(F.sum("weight").alias("weight"), F.first("parts").alias("parts"))
    # read twice: sums of fractions may come out otherwise another time
    sizes = written(sizes.withColumn("first", F.floor(F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).withColumn("cuts", F.ceil("weight").cast("int")).drop("weight"), "sizes")
    placed = placed.drop("parts").join(in_parts(sizes).drop("parts"), [*bucket, "kind", "n", "part"])
    placed = placed.withColumn("block", F.concat_ws("/", "kind", "first", F.pmod(F.xxhash64("doc_id", "key"), F.col("cuts"))))
    blocks = sizes.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).groupBy(*bucket, "kind", F.concat_ws("/", "kind", "first", "cut").alias("block")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    others = blocks.select(*bucket, F.col("block").alias("other"), F.col("kind").alias("other_kind"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    pairs = blocks.join(others, bucket).filter("block <= other and (kind = 'shared' or kind <> other_kind)")
    pairs = pairs.filter(f"100 * high >= {percent} * other_low and 100 * other_high >= {percent} * low")
    task = F.concat_ws(":", "band", "bucket", "block", "other")
    tasks = pairs.select(*bucket, task.alias("task"), F.explode(F.when(
        F.col("block") == F.col("other"), F.array(F.struct(F.col("block").alias("mine"), F.lit(2).alias("side"))),
    ).otherwise(F.array(F.struct(F.col("block").alias("mine"), F.lit(0).alias("side")), F.struct(F.col("other").alias("mine"), F.lit(1).alias("side"))))).alias("x")).select(*bucket, "task", "x.*")
    members = placed.join(tasks, [*(placed[c] == tasks[c] for c in bucket), placed["block"] == tasks["mine"]]).select("task", "side", "doc_id", "key", "component", "signature")
    return members.join(sets, ["doc_id", "key"]).select("task", "side", "doc_id", "component", "signature", "shingles")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    A-Z count as small; words are `[^\\x20\\x09-\\x0D]+`; a document's set has the different shingles of `size` words, or all its
    words as one where they are fewer. Documents are linked where 100 * intersection >= percent * union, confirmed on the
    full sets; component_id is the smallest doc_id reachable and kept says that it is the document's own. Without words
    (or text) a set is empty and linked with nothing. Rows of one doc_id are one document, linked with what any of its
    texts is linked with; a null id is linked with nothing and kept. Other columns are not read. An empty table gives no
    row. Candidates come from bands of minima: two documents at 85 percent miss all of them once in some 130,000 pairs,
    at 80 percent once in some 3,500,000, see `missed`, and a group of copies is held together by all its links.
    """
    small_batches(docs.sparkSession)
    rows = texts(docs, id_col, text_col)
    made = written(sketches(rows, size, percent), "sketches")
    full = made.filter("n > 0 and doc_id is not null")
    classes = written(full.groupBy("set_a", "set_b", "n").agg(F.min(F.struct("doc_id", "key", "bands", "signature")).alias("first")).select("set_a", "set_b", "n", "first.*"), "classes")
    joined = near_links(classes, rows.filter("doc_id is not null"), size, percent)
    names = classes.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("set_a", "set_b", "n", F.coalesce("component", "doc_id").alias("component_id"))
    result = made.join(names, ["set_a", "set_b", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    result = joined_by_id(result)
    own = F.coalesce("component_id", "doc_id")
    return result.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without the documents that `near_duplicates` does not keep.

    Rows without words, with a null text or a null id stay; rows of one id stay or go together, so repeated rows of a kept
    document stay each. Other columns, of any name, are passed on. An empty table gives no row.
    """
    (gone_id,) = unused(docs, "gone_id")
    gone = near_duplicates(docs, size, percent, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone.hint("shuffle_hash"), F.col(id_col) == F.col(gone_id), "left_anti")


def joined_by_id(result: DataFrame) -> DataFrame:
    """Components that meet in the texts of one doc_id are one."""
    result = written(result, "named")
    met = result.filter("component_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).filter("a <> b")
    if met.isEmpty():
        return result
    links = result.join(met.select("doc_id", "a"), "doc_id").select("a", F.col("component_id").alias("b")).filter("b is not null")
    new = components(links)
    return result.join(new.select(F.col("node").alias("component_id"), "component"), "component_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id")
    )
