"""Documents that hold passages of a benchmark, by fingerprints of item-sized windows.

Windows as long as an item are fingerprinted by SimHash over their weighted five-word shingles. A multi-index over four
blocks of the fingerprint finds every item within the radius, and the exact weighted similarity decides. A window that
shares no shingle with an item of its size is not fingerprinted: its similarity to all of them is 0.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Runs, chunks, forget, mixed, small_batches, word_symbols, words, written
from .ordering import dealt_in_order, with_positions

#: Words of a shingle, and the similarity from which a passage counts as the item's.
SHINGLE, SIMILARITY = 5, 0.8
#: Bits in which fingerprints may differ. At similarity 0.8 the cosine of two windows is some 0.89, so about 10 of 64
#: bits differ, with a deviation of 3.
RADIUS = 19
BLOCKS, BITS = 4, 16
#: Items that are looked for in one pass over the documents, and their bytes, so what is broadcast stays bounded.
ITEMS, ITEM_BYTES = 1000, 4 << 20
#: Shingles of windows that are fingerprinted together.
STRETCH = 1 << 16

#: A-Z made small, ASCII punctuation a space; letters and digits of all scripts kept.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32
_SHIFTS = np.arange(64, dtype=np.uint64)


def plain_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol and size in bytes of each word, and the number of the first word of each text."""
    plain = _PLAIN[data] if len(data) else data
    begins, ends, starts = words(plain, at)
    return word_symbols(plain, begins, ends), ends - begins, starts


def shingles(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight (bytes of its words: long words are rarer) of the shingle that begins at each word, as far as they fit."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    return Runs(symbols).every(SHINGLE), total[SHINGLE:] - total[:-SHINGLE] if len(sizes) >= SHINGLE else np.zeros(0, np.int64)


def fingerprints(hashes: np.ndarray, weights: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHash of the shingles begin, ..., end - 1 of each window."""
    signs = (hashes[:, None] >> _SHIFTS & np.uint64(1)).astype(np.int32) * 2 - 1
    sums = np.zeros((len(hashes) + 1, 64), np.int64)
    np.cumsum(signs * weights[:, None], axis=0, out=sums[1:])
    return ((sums[end] - sums[begin] > 0).astype(np.uint64) << _SHIFTS).sum(1, dtype=np.uint64)


def weighed(hashes: np.ndarray, weights: np.ndarray) -> dict[int, int]:
    """The multiset of shingles: each with its weight times its count."""
    found: dict[int, int] = {}
    for h, w in zip(hashes.tolist(), weights.tolist()):
        found[h] = found.get(h, 0) + w
    return found


def similarity(a: dict[int, int], b: dict[int, int]) -> float:
    """Weighted Jaccard: the sum of the lesser weights by the sum of the greater."""
    common = sum(min(w, b[h]) for h, w in a.items() if h in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


@dataclass
class Items:
    """A block of benchmark items, as broadcast; the index is built where it is used."""

    ids: list
    texts: list[str]

    @cached_property
    def parsed(self) -> list[tuple[int, np.ndarray, np.ndarray, bytes]]:
        """Of each item: its words, its shingles with weights, and its words' symbols."""
        made = []
        for text in self.texts:
            raw = np.frombuffer(text.encode(), np.uint8)
            symbols, sizes, _ = plain_words(raw, np.array([0, len(raw)]))
            made.append((len(symbols), *shingles(symbols, sizes), symbols.tobytes()))
        return made

    @cached_property
    def long(self) -> list[int]:
        return [i for i, item in enumerate(self.parsed) if item[0] >= SHINGLE]

    @cached_property
    def short(self) -> dict[int, dict[bytes, list[int]]]:
        """Items of too few words for a shingle, by their number of words and their whole sequence."""
        found: dict[int, dict[bytes, list[int]]] = {}
        for i, item in enumerate(self.parsed):
            if 0 < item[0] < SHINGLE:
                found.setdefault(item[0], {}).setdefault(item[3], []).append(i)
        return found

    @cached_property
    def short_hashes(self) -> dict[int, np.ndarray]:
        return {n: np.unique(np.concatenate([Runs(np.frombuffer(key, np.uint64)).every(n) for key in items])) for n, items in self.short.items()}

    @cached_property
    def lengths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All shingles, rising, and where their item lengths lie: the different lengths of the items that hold each."""
        pairs = {(int(h), self.parsed[i][0]) for i in self.long for h in self.parsed[i][1]}
        keys = np.array(sorted(pairs), np.uint64).reshape(-1, 2)
        unique, first = np.unique(keys[:, 0], return_index=True)
        return unique, np.append(first, len(keys)), keys[:, 1].astype(np.int64)

    @cached_property
    def slots(self) -> dict[int, np.ndarray]:
        """Of each item length the numbers of the shingles that such items hold."""
        _, firsts, lengths = self.lengths
        of = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        return {int(n): of[lengths == n] for n in np.unique(lengths)}

    @cached_property
    def maybe(self) -> np.ndarray:
        """Quick test on the top bits of a shingle."""
        table = np.zeros(1 << 20, bool)
        table[(self.lengths[0] >> np.uint64(44)).astype(np.int64)] = True
        return table

    @cached_property
    def prints(self) -> np.ndarray:
        made = [fingerprints(self.parsed[i][1], self.parsed[i][2], np.array([0]), np.array([len(self.parsed[i][1])]))[0] for i in self.long]
        return np.array(made, np.uint64)

    @cached_property
    def index(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block of bits: the items by every value that differs from theirs in at most RADIUS // BLOCKS bits.

        Fingerprints within RADIUS differ in at most that many bits of some block.
        """
        reach = range(RADIUS // BLOCKS + 1)
        masks = np.array([sum(1 << b for b in bits) for n in reach for bits in itertools.combinations(range(BITS), n)], np.int64)
        made = []
        for block in range(BLOCKS):
            own = (self.prints >> np.uint64(BITS * block) & np.uint64((1 << BITS) - 1)).astype(np.int64)
            values = (own[:, None] ^ masks[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            made.append((np.searchsorted(values[order], np.arange((1 << BITS) + 1)), (order // len(masks)).astype(np.int32)))
        return made

    @cached_property
    def weights(self) -> dict[int, dict[int, int]]:
        return {i: weighed(self.parsed[i][1], self.parsed[i][2]) for i in self.long}

    def near(self, prints: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window, item, bits that differ) for all within RADIUS."""
        windows, items = [], []
        for block, (starts, members) in enumerate(self.index):
            value = (prints >> np.uint64(BITS * block) & np.uint64((1 << BITS) - 1)).astype(np.int64)
            first, many = starts[value], starts[value + 1] - starts[value]
            windows.append(np.repeat(np.arange(len(prints)), many))
            items.append(members[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())])
        n = max(1, len(self.prints))
        both = np.unique(np.concatenate(windows) * n + np.concatenate(items))
        window, item = both // n, both % n
        apart = np.bitwise_count(prints[window] ^ self.prints[item])
        for w, i, d in zip(window[apart <= RADIUS].tolist(), item[apart <= RADIUS].tolist(), apart[apart <= RADIUS].tolist()):
            yield w, self.long[i], d

    def look(self, data: np.ndarray, at: np.ndarray, least: float) -> dict[tuple[int, int], tuple[float, int, int, int]]:
        """Of the texts in data: (text, item) and the best of its windows: (similarity, begin, words, bits that differ)."""
        found: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        symbols, sizes, starts = plain_words(data, at)
        self.look_for_short(symbols, starts, found)
        if not self.long or len(symbols) < SHINGLE:
            return found
        hashes, weights = shingles(symbols, sizes)
        known, firsts, lengths = self.lengths
        hit = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(known, hashes[hit]), len(known) - 1)
        hit, slot = hit[known[slot] == hashes[hit]], slot[known[slot] == hashes[hit]]
        # shingles over the border of two texts are none
        doc = np.searchsorted(starts, hit, "right") - 1
        inside = hit + SHINGLE <= starts[doc + 1]
        hit, slot, doc = hit[inside], slot[inside], doc[inside]
        if not len(hit):
            return found
        known_weight = np.concatenate(([0], np.cumsum(weights[hit])))
        total = np.concatenate(([0], np.cumsum(weights)))
        of_length = np.zeros(len(known), bool)
        places = Runs(symbols)
        seen = np.unique(slot)
        for length in np.unique(np.concatenate([lengths[firsts[x]:firsts[x + 1]] for x in seen])).tolist():
            of_length[:] = False
            of_length[self.slots[length]] = True
            mine = of_length[slot]
            at_hit, at_doc = hit[mine], doc[mine]
            # every window of that length that holds such a shingle, once; a shorter text is one window
            size = np.minimum(length, starts[at_doc + 1] - starts[at_doc])
            low, high = np.maximum(starts[at_doc], at_hit + SHINGLE - size), np.minimum(at_hit, starts[at_doc + 1] - size)
            low[1:] = np.maximum(low[1:], np.maximum.accumulate(high)[:-1] + 1)
            many = np.maximum(high - low + 1, 0)
            begin = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            size, of = np.repeat(size, many), np.repeat(at_doc, many)
            # what is in common with an item is of known shingles, so these must weigh `least` of the window
            end = begin + size - SHINGLE + 1
            common = known_weight[np.searchsorted(hit, end)] - known_weight[np.searchsorted(hit, begin)]
            good = common >= (least - 1e-9) * (total[end] - total[begin])
            begin, size, of = begin[good], size[good], of[good]
            # of windows with the same words in the same text the first
            same = mixed(places.hashes(begin, begin + size) + mixed(of.astype(np.uint64)))
            first = np.sort(np.unique(same, return_index=True)[1])
            self.compare(hashes, weights, begin[first], size[first], of[first], starts, least, found)
        return found

    def look_for_short(self, symbols: np.ndarray, starts: np.ndarray, found: dict) -> None:
        """Items without a shingle, at the first place where their words stand."""
        for n, items in self.short.items():
            runs = Runs(symbols).every(n)
            at = np.flatnonzero(np.isin(runs, self.short_hashes[n]))
            doc = np.searchsorted(starts, at, "right") - 1
            inside = at + n <= starts[doc + 1]
            at, doc = at[inside], doc[inside]
            # places with the same words in the same text, but for the first, say nothing new
            first = np.sort(np.unique(mixed(runs[at] + mixed(doc.astype(np.uint64))), return_index=True)[1])
            for place, d in zip(at[first].tolist(), doc[first].tolist()):
                for item in items.get(symbols[place:place + n].tobytes(), ()):
                    found.setdefault((d, item), (1.0, place - int(starts[d]), n, 0))

    def compare(self, hashes: np.ndarray, weights: np.ndarray, begin: np.ndarray, size: np.ndarray, of: np.ndarray, starts: np.ndarray, least: float, found: dict) -> None:
        """Fingerprint windows, look up items near them and keep the best of what is alike; STRETCH shingles at a time."""
        part = np.cumsum(size) // STRETCH
        for edge in np.flatnonzero(np.diff(part, prepend=-1)).tolist():
            until = int(np.searchsorted(part, part[edge], "right"))
            b, n = begin[edge:until], size[edge:until] - SHINGLE + 1
            # only shingles within some window
            used = np.zeros(int((b + n).max() - b[0]) + 1, np.int32)
            np.add.at(used, b - b[0], 1)
            np.add.at(used, b - b[0] + n, -1)
            inside = np.flatnonzero(np.cumsum(used[:-1]) > 0)
            slim = np.searchsorted(inside, b - b[0])
            prints = fingerprints(hashes[b[0] + inside], weights[b[0] + inside], slim, slim + n)
            for w, item, apart in self.near(prints):
                at, shingled, d = int(b[w]), int(n[w]), int(of[edge + w])
                ours = weighed(hashes[at:at + shingled], weights[at:at + shingled])
                alike = similarity(ours, self.weights[item])
                if alike >= least:
                    best = found.get((d, item))
                    place = at - int(starts[d])
                    if best is None or (-alike, place) < (-best[0], best[1]):
                        found[d, item] = alike, place, shingled + SHINGLE - 1, apart


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The items in blocks of at most ITEMS items and about ITEM_BYTES bytes; items without text are none."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).filter("text is not null").withColumn("place", F.monotonically_increasing_id())
    order = [F.col("item_id"), F.col("place")]
    # an item counts as its bytes, and as its share of a block at least
    size = F.greatest(F.octet_length("text").cast("long"), F.lit(ITEM_BYTES // ITEMS))
    placed = written(with_positions(dealt_in_order(rows, order, "item-order"), order, size).withColumn("block", F.expr(f"start div {ITEM_BYTES}")), "items")
    last = placed.agg(F.max("block")).first()[0]
    for block in range(-1 if last is None else last + 1):
        # bounded by the size of a block and one item
        found = placed.filter(F.col("block") == block).select("item_id", "text").orderBy("item_id", "text").collect()
        if found:
            yield Items([r[0] for r in found], [r[1] for r in found])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, begin, n_words, distance, similarity): the best window of each document for each item it holds.

    Words are split at white space and ASCII punctuation, A-Z count as small. A window has as many words as the item; a
    shorter document is one window. Of equally similar windows the first counts. Items of fewer than five words match
    where their words stand in a row; documents of fewer than five words hold no longer item. A null or empty text, or item, matches nothing; repeated rows and
    items of the same text are reported each; null ids stay null. Other columns are not read. Nothing of the documents
    is shuffled; a benchmark beyond a block (ITEMS items, ITEM_BYTES bytes) takes one pass over them for each block.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    items = benchmark.select(F.col(item_id_col).alias("item_id"))
    kind, item_kind = (x.schema[0].dataType.simpleString() for x in (rows, items))
    schema = f"doc_id {kind}, item_id {item_kind}, begin long, n_words long, distance int, similarity double"
    ids_type = to_arrow_type(items.schema[0].dataType)
    spark = docs.sparkSession
    small_batches(spark)
    result = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(block)

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            forget()
            items = shared.value
            for batch in batches:
                for first, _, data, at in chunks(batch.column(1)):
                    found = sorted(items.look(data, at, least).items())
                    of = pa.array([first + doc for (doc, _), _ in found], pa.int64())
                    columns = zip(*[(n, begin, apart, alike) for _, (alike, begin, n, apart) in found])
                    n, begin, apart, alike = columns if found else ((), (), (), ())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(of), pa.array([items.ids[i] for (_, i), _ in found], ids_type), pa.array(begin, pa.int64()),
                         pa.array(n, pa.int64()), pa.array(apart, pa.int32()), pa.array(alike, pa.float64())],
                        ["doc_id", "item_id", "begin", "n_words", "distance", "similarity"],
                    )

        result = result.union(rows.mapInArrow(look, schema))
    return result


def clean(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those that hold an item, as `contaminated` finds them.

    A null or empty text stays, ids may be null or repeated, rows of one id are judged each by its own text, other columns
    of any name are passed on. An empty table gives no row, an empty benchmark takes none away.
    """
    spark = docs.sparkSession
    small_batches(spark)
    place = docs.columns.index(text_col)
    for block in item_blocks(benchmark, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            forget()
            for batch in batches:
                good = np.ones(len(batch), bool)
                column = batch.column(place).fill_null("")
                for first, _, data, at in chunks(column):
                    for doc, _ in shared.value.look(data, at, least):
                        good[first + doc] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
