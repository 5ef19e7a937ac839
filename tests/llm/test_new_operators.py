"""Fill-in-the-middle, license scan and centroids against plain versions of themselves."""
from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetally.llm import centroids, licenses, middles
from pagetally.llm.licenses import GRAM, SHARE, TEMPLATES

# --- fill in the middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = ["", None, " ", "\n\t ", "x", " x", "x ", "<P>", "a <S> b", "a <M>", "a < P > b", "<P <S", "é", "日本語 のテキスト\n\n", "a" * 5000, "a b c", "tail  \n", "<", ">P> <", "z\x0bz\x0cz"]


def plain_sample(doc_id, text, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 50), (100, 0), (0, 50)])
def test_middles_are_those_of_a_plain_version(corpus, make_docs, rate, spm):
    rows = corpus + [(1000 + 37 * j + i, text) for j in range(6) for i, text in enumerate(ODD)] + [(2000, "one two three " * 40000), (None, "no id at all"), (2001, "twice"), (2001, "twice")]
    recipe = middles.Recipe(rate=rate, spm=spm)
    made = middles.restored(middles.fill_in_middle(make_docs(rows), recipe), recipe)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    assert sorted(map(tuple, made.collect()), key=str) == sorted((plain_sample(i, t, rate, spm) for i, t in rows), key=str)


def test_middles_of_an_empty_table_and_with_other_markers(make_docs):
    assert middles.restored(middles.fill_in_middle(make_docs([]))).count() == 0
    recipe = middles.Recipe(rate=100, prefix="[pre]", middle="[mid]", suffix="{suffix}")
    made = middles.restored(middles.fill_in_middle(make_docs([(i, f"a <P> b {i} [pr c") for i in range(20)]), recipe), recipe).collect()
    assert all(r.restored == f"a <P> b {r.doc_id} [pr c" and r.form != "plain" for r in made)
    for bad in ({"prefix": ""}, {"prefix": "aba"}, {"prefix": "<S>"}, {"prefix": "x<"}, {"prefix": "é"}, {"prefix": "q<M>q"}):
        with pytest.raises(ValueError):
            middles.Recipe(**bad)
    with pytest.raises(Exception, match="each marker once"):
        middles.restored(make_docs([(1, "no marker")]).select("doc_id", F.lit("psm").alias("form"), F.col("text").alias("output"))).collect()


# --- licenses

def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[-1]))
    return row[-1]


def plain_scan(text):
    """n_words, base places, base labels, all labels: phrases at every place, wordings by subsequences of windows at every word."""
    words, base, base_labels, labels = license_words(text), [], set(), set()
    for t in TEMPLATES:
        own = license_words(t.text)
        if t.phrase:
            at = [i for i in range(len(words) - len(own) + 1) if words[i:i + len(own)] == own]
            if at:
                labels.add(t.label)
            if at and t.base:
                base += at
                base_labels.add(t.label)
        elif len(set(words) & set(own)) > 0.5 * len(set(own)):
            n = len(own)
            if any(subsequence(words[i:i + n + n // 2], own) >= SHARE * n for i in range(0, max(1, len(words) - n // 2), max(1, n // 4))):
                labels.add(t.label)
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels))


def license_rows(rng):
    filler = lambda n: " ".join(f"word{rng.randrange(300)}" for _ in range(n))
    rows = []
    for i, t in enumerate(TEMPLATES):
        rows.append((i, f"{filler(30)}\n{t.text}.\n{filler(20)}"))
        words = t.text.split()
        changed = [f"changed{j}" if j % 11 == 5 else w for j, w in enumerate(words)]
        rows.append((100 + i, filler(7) + " " + " ".join(changed)))
        rows.append((200 + i, " ".join(w for j, w in enumerate(words) if j % 13 != 6) + " " + filler(3)))
        rows.append((300 + i, " ".join(f"{w} inserted" if j % 17 == 3 else w for j, w in enumerate(words))))
        rng.shuffle(words)
        rows.append((400 + i, " ".join(words)))
    rows += [(500, "Under the MIT license, UNDER-THE-MIT-LICENSE; under the mit. license"), (501, "cc by nc cc by nc by nc"), (502, "cc by nç"), (503, ""), (504, None), (505, "mit"),
             (506, "under the mit licenses"), (None, "Apache License, Version 2"), (507, "Apache License, Version 2"), (507, "Apache License, Version 2"), (508, "cc by nc " * 9000)]
    return rows + [(600 + i, filler(400)) for i in range(10)]


def test_licenses_are_those_of_a_plain_version(make_docs):
    rows = license_rows(random.Random(3))
    made = licenses.license_labels(make_docs(rows)).collect()
    assert all(0 <= r.score <= 1 and (r.score >= SHARE) == bool(r.labels) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in made)
    assert sorted((tuple(r)[:-1] for r in made), key=str) == sorted(((i, *plain_scan(t)) for i, t in rows), key=str)


def test_license_spans_say_where(make_docs):
    mit = next(t for t in TEMPLATES if t.label == "mit" and not t.phrase)
    text = "head " * 50 + mit.text.replace("free of charge", "free of any charge") + " tail" * 50
    found = licenses.license_spans(make_docs([(1, text)])).collect()
    assert [r.label for r in found] == ["mit"] and found[0].begin <= 50 and found[0].begin + found[0].n_words >= 50 + len(license_words(mit.text)) and found[0].share == 1.0
    twice = licenses.license_spans(make_docs([(1, f"{mit.text} {'gap ' * 200} {mit.text}")])).collect()
    assert len(twice) == 2
    assert licenses.license_labels(make_docs([])).count() == 0 and licenses.license_spans(make_docs([(1, "nothing")])).count() == 0
    with pytest.raises(ValueError):
        licenses.license_spans(make_docs([]), [licenses.Template("x", "two words")])
    assert GRAM == 3


def test_subsequences_by_bits():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        assert licenses.in_order(np.array(a, np.uint64), np.array(b, np.uint64)) == subsequence(a, b)


# --- centroids

def plain_clusters(rows, k, rounds, dimensions):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centers))[::-1]

    for _ in range(rounds):
        groups: dict[int, list] = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[0], []).append(v)
        centers = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(centers)]
    placed = [(i, *nearest(v)) for i, v in kept]
    by = {c: sum(d for _, x, d in placed if x == c) for _, c, _ in placed}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, by[c], sum(by.values()), digests[c]) for i, c, d in placed), key=str)


VECTORS = "vec_id long, embedding array<float>, cluster string, distance string, vec_ids int"


@pytest.mark.parametrize("k,rounds,dimensions,n", [(8, 10, 64, 300), (5, 4, 12, 200), (3, 2, 7, 50), (8, 10, 4, 5)])
def test_clusters_are_those_of_a_plain_version(spark, k, rounds, dimensions, n):
    rng = random.Random(n)
    rows = [(i, [float(np.float32(rng.gauss(i % 3, 0.4))) for _ in range(dimensions)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(n // 2)] + [rows[1], rows[1], (None, rows[2][1]), (1, rows[3][1])]
    rows += [(9000, None), (9001, []), (9002, rows[0][1][:-1]), (9003, [None, *rows[0][1][1:]]), (9004, [math.nan, *rows[0][1][1:]]), (9005, [-math.inf, *rows[0][1][1:]])]
    table = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], VECTORS).repartition(3)
    made = centroids.cluster_vectors(table, k, rounds, dimensions)
    assert made.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, made.collect()), key=str) == plain_clusters(rows, k, rounds, dimensions)


def test_clusters_of_nothing_and_of_too_large_components(spark):
    assert centroids.cluster_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert centroids.cluster_vectors(spark.createDataFrame([(1, [1.0] * 63, "", "", 1)], VECTORS)).count() == 0
    with pytest.raises(Exception, match="fit into 64 bits"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64, "", "", 1)], VECTORS)).count()


def test_dictionaries_lose_nothing():
    rng = np.random.default_rng(1)
    for shape, values in (((500, 64), 3), ((4096, 64), 900), ((100, 12), 2), ((50, 7), 5), ((1, 64), 9)):
        vectors = rng.integers(-values, values, shape)
        encoded = centroids.Encoded.unpacked(*centroids.Encoded.of(vectors).packed())
        assert (encoded.vectors() == vectors).all()
    copies = centroids.Encoded.of(np.repeat(rng.integers(-900, 900, (3, 64)), 100, axis=0))
    assert copies.codes.shape == (1, 300) and copies.entries.shape == (3, 64)
