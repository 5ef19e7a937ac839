"""Near duplicates and repeated passages against brute force."""
from __future__ import annotations

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagetally.llm import components, minhash, repeats, suffixes

LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text):
    return (text or "").encode().split()


def shingles(text, size):
    w = [x.translate(LOW) for x in words(text)]
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near_components(rows, size, percent):
    """Smallest id reachable of each id, over all pairs."""
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(corpus, make_docs, size, percent):
    expected = near_components(corpus, size, percent)
    got = minhash.near_duplicates(make_docs(corpus), size, percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((i, len(shingles(t, size))) for i, t in corpus)
    for r in got:
        assert r["component_id"] == expected.get(r["doc_id"])
        assert r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])


def test_large_group_in_blocks(make_docs, monkeypatch):
    """Blocks smaller than the group, so that components are spread over several and compared between them."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(60):
        copy = list(base)
        for at in rng.choice(120, int(rng.integers(0, 8)), replace=False):
            copy[at] = f"x{rng.integers(4)}"
        rows.append((i, " ".join(copy)))
    expected = near_components(rows, 3, 85)
    assert len(set(expected.values())) > 3
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(make_docs(rows), 3, 85).collect()}
    assert got == expected


def test_hot_buckets_and_blocks_of_unlike_sizes(make_docs, monkeypatch):
    """Buckets in parts, and blocks in the order of sizes: links between neighbouring blocks are found, none is lost at the edges."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 6)
    monkeypatch.setattr(minhash, "HOT_SHARE", 4000)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(90):
        base = [f"t{j}" for j in range(60 + 2 * (i % 45))]
        for at in rng.choice(len(base), int(rng.integers(0, 4)), replace=False):
            base[at] = f"x{rng.integers(4)}"
        rows.append((i, " ".join(base)))
    rows += [(200 + i, rows[0][1]) for i in range(30)]
    for size, percent in ((3, 85), (5, 80)):
        expected = near_components(rows, size, percent)
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(make_docs(rows), size, percent).collect()}
        assert got == expected


def test_blocks_too_far_apart_in_size_are_not_paired(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 10)
    rows = [(0, 7, 0, 1, i, 0, 100 + 10 * (i // 10), [0], i) for i in range(200)]
    labelled = spark.createDataFrame(rows, "band int, bucket long, part int, parts int, doc_id long, key int, n long, signature array<long>, component long")
    sets = spark.createDataFrame([(i, 0, [1]) for i in range(200)], "doc_id long, key int, shingles array<long>")
    dealt = minhash.in_blocks(labelled, sets, 85).select("task", "doc_id").collect()
    together = defaultdict(set)
    for r in dealt:
        together[r["task"]].add(r["doc_id"])
    pairs = {p for ids in together.values() for p in itertools.combinations(sorted(ids), 2)}
    size = {r[4]: r[6] for r in rows}
    can = {(a, b) for a, b in itertools.combinations(range(200), 2) if 100 * size[a] >= 85 * size[b]}
    assert can <= pairs
    assert len(pairs) < 0.6 * 200 * 199 / 2


def test_estimate_of_packed_minima():
    rng = np.random.default_rng(1)
    union = rng.integers(1, 1 << 62, 1200, dtype=np.uint64)
    a, b = np.unique(union[:1000]), np.unique(union[200:])
    packed = minhash.packed(minhash.minima([a, b]))
    assert abs(minhash.estimate(packed[0], packed[1]) - 800 / 1200) < 0.25
    assert minhash.estimate(packed[0], packed[0]) == pytest.approx(1)


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {90: 90, 95: 90, 100: 90}


def removed_words(rows, length):
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - length + 1):
            if i is not None:
                k = tuple(w[p:p + length])
                first[k] = min(first.get(k, i), i)
    for i, t in rows:
        w = words(t)
        out = np.zeros(len(w), bool)
        for p in range(len(w) - length + 1):
            if i is not None and first[tuple(w[p:p + length])] < i:
                out[p:p + length] = True
        yield i, len(w), int(out.sum()), hashlib.sha256(b" ".join(x for x, o in zip(w, out) if not o)).hexdigest()


def test_repeated_passages(corpus, make_docs):
    got = repeats.kept_digest(repeats.remove_repeats(make_docs(corpus))).collect()
    made = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got)
    assert made == Counter(removed_words(corpus, 50))
    assert all(r["n_removed"] == sum(p["end"] - p["begin"] for p in r["passages"]) for r in got)


def test_deduplicated_keeps_columns_and_drops_what_is_gone(make_docs):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = make_docs([(1, passage), (2, passage), (3, "before " + passage + " after"), (4, None), (None, passage), (5, "")])
    got = {(r["doc_id"], r["text"]) for r in repeats.deduplicated(docs).collect()}
    assert got == {(1, passage), (3, "before after"), (4, None), (None, passage), (5, "")}
    assert repeats.deduplicated(docs).columns == docs.columns


def removed_bytes(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    count = defaultdict(int)
    for b in raw:
        for p in range(len(b) - length + 1):
            count[b[p:p + length]] += 1
    for (i, _), b in zip(rows, raw):
        out = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p:p + length]] > 1:
                out[p:p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], out.astype(int), [0]))))
        yield i, len(b), int(out.sum()), len(edges) // 2, np.frombuffer(b, np.uint8)[~out].tobytes()


@pytest.mark.parametrize(("batches", "together"), [(4, 4096), (3, 1)])
def test_repeated_bytes(corpus, make_docs, monkeypatch, batches, together):
    """Also with a number of batches that leaves two levels, and with every suffix compared window by window through Spark."""
    monkeypatch.setattr(suffixes, "TOGETHER", together)
    got = suffixes.remove_repeated_bytes(make_docs(corpus), batches=batches).collect()
    made = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got)
    assert made == Counter(removed_bytes(corpus, 200))


def test_levels_merge_geometrically(spark, make_docs):
    family = suffixes.Family()
    rows = suffixes.texts(make_docs([(i, f"text {i} " * 60) for i in range(5)]))
    filled = []
    for i in range(5):
        family.add(suffixes.sampled(rows.filter(f"doc_id = {i}"), 200, 24))
        filled.append(sorted(family.levels))
    assert filled == [[0], [1], [0, 1], [2], [0, 2]]


def test_entries_of_a_hot_suffix_are_spread(spark):
    rows = [(7 if i % 3 else i, i, i, 1, 0, 1) for i in range(400)]
    family = suffixes.Family()
    family.add(spark.createDataFrame(rows, "suffix long, run long, doc_id long, key int, begin int, n int").repartition(8))
    files = family.entries[0].filter("suffix = 7").selectExpr("input_file_name() as file").groupBy("file").count().collect()
    assert len(files) == 8 and sum(r["count"] for r in files) == sum(r[0] == 7 for r in rows)
    assert family.levels[0].filter("suffix = 7").collect()[0]["many"] == sum(r[0] == 7 for r in rows)


def test_empty_tables(make_docs):
    docs = make_docs([])
    for made in (minhash.near_duplicates(docs), repeats.remove_repeats(docs), suffixes.remove_repeated_bytes(docs), repeats.deduplicated(docs), minhash.one_of_each(docs)):
        assert made.count() == 0


@pytest.mark.parametrize("percent", [85, 80])
def test_planted_pairs_at_the_threshold_share_a_band(percent):
    """2,000 pairs of sets of exactly that similarity."""
    rng = np.random.default_rng(percent)
    width = minhash.band_width(percent)
    assert minhash.missed(percent, width) <= minhash.MISSED and {85: 4, 80: 3}[percent] == width
    caught = 0
    for _ in range(2000):
        common, own = (170, 15) if percent == 85 else (160, 20)
        hashes = rng.integers(0, 1 << 63, common + 2 * own, dtype=np.uint64)
        a, b = minhash.minima([np.sort(hashes[:common + own]), np.sort(np.concatenate([hashes[:common], hashes[common + own:]]))])
        equal = (a == b)[:minhash.MINIMA // width * width].reshape(-1, width)
        caught += equal.all(1).any()
    assert caught >= 1999


def test_stages_pass_on_columns_of_any_name(spark):
    """Columns named as those that the stages add, nulls, repeated rows, empty texts and empty tables."""
    rng = random.Random(21)
    passage = " ".join(f"p{rng.randrange(900)}" for _ in range(60))
    texts = [(1, passage + " first"), (2, "before " + passage), (2, "before " + passage), (3, "short"), (3, "short"), (4, None), (4, ""), (None, passage), (None, None), (5, "other words that stand alone here")]
    rows = [(i, t, f"k{n}", n, f"f{n}", [n], f"g{n}") for n, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _found_id long, _found_key string, _passages array<int>, _Gone_id string").repartition(3)
    made = repeats.deduplicated(docs)
    assert made.dtypes == docs.dtypes
    wanted = [(r[0], "before" if r[0] == 2 else r[1], *r[2:]) for r in rows]
    assert sorted(map(tuple, made.collect()), key=str) == sorted(wanted, key=str)
    left = minhash.one_of_each(docs, 3, 80)
    assert left.dtypes == docs.dtypes
    assert sorted(map(tuple, left.collect()), key=str) == sorted((r for r in rows if r[0] != 2), key=str)
    for stage in (repeats.deduplicated, minhash.one_of_each):
        assert stage(docs.limit(0)).count() == 0
