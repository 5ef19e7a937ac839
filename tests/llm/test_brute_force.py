"""Language mixtures and hash trees against plain versions that share no code with the operators."""
from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from pagetally.llm import language, merkle

BUCKETS, SMOOTH, ROUNDS, ROUNDS_LESS = 1 << 15, 0.5, 12, 6


def letters(text):
    """Trigrams of bytes with a letter in their middle, between spaces."""
    raw = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in b" " + text.lower().encode() + b" ")
    return [raw[i:i + 3] for i in range(len(raw) - 2) if raw[i + 1] != 32]


def bucket(gram):
    x = int.from_bytes(gram, "big")
    for factor, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        x = (x ^ (x >> shift)) * factor % (1 << 64)
    return (x ^ (x >> 31)) % BUCKETS


def learned(labelled):
    """Counts and totals of each language."""
    counts = {}
    for text, lang in labelled:
        counts.setdefault(lang, Counter()).update(bucket(g) for g in letters(text))
    return {lang: (c, sum(c.values())) for lang, c in counts.items()}


def mixture(model, text):
    """Shares of the languages with the best penalised likelihood, in double precision, one trigram at a time."""
    seen = Counter(bucket(g) for g in letters(text))
    n = sum(seen.values())
    if not n:
        return {}
    names = sorted(model)
    chance = {(lang, b): (c[b] + SMOOTH) / (total + SMOOTH * BUCKETS) for lang, (c, total) in model.items() for b in seen}

    def round_of(shares):
        new = dict.fromkeys(shares, 0.0)
        for b, times in seen.items():
            mass = sum(shares[x] * chance[x, b] for x in shares)
            for x in shares:
                new[x] += times * shares[x] * chance[x, b] / mass / n
        return new

    def likelihood(shares):
        return sum(times * math.log(sum(shares[x] * chance[x, b] for x in shares)) for b, times in seen.items())

    shares = {x: 1 / len(names) for x in names}
    for _ in range(ROUNDS):
        shares = round_of(shares)
    order = sorted(names, key=lambda x: -shares[x])
    cost = 0.5 * math.log(max(2.0, n / 3))
    best, best_score = None, -math.inf
    for size in range(1, len(names) + 1):
        kept = {x: max(shares[x], 1e-9) for x in order[:size]}
        whole = sum(kept.values())
        kept = {x: v / whole for x, v in kept.items()}
        for _ in range(ROUNDS_LESS if size > 1 else 0):
            kept = round_of(kept)
        score = likelihood(kept) / 3 - cost * (size - 1)
        if score <= best_score:
            break
        best, best_score = kept, score
    return best


@pytest.fixture(scope="module")
def stock():
    """Texts of five made languages, some of which share half their words."""
    rng = random.Random(21)
    alphabets = {"aa": "abcdeo", "bb": "fghiku", "cc": "lmnprs", "dd": "äöüßtv", "ee": "хцшыюя"}
    common = ["".join(rng.choice("aeiou") for _ in range(4)) for _ in range(20)]
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(2, 7))) for _ in range(40)] + (common if k in ("aa", "bb") else []) for k, v in alphabets.items()}
    say = lambda names, n: " ".join(rng.choice(words[rng.choice(names)]) for _ in range(n))
    labelled = [(say([k], 40), k) for k in words for _ in range(15)]
    texts = [say(names, n) for n in (1, 3, 20, 150) for names in (["aa"], ["dd"], ["aa", "bb"], ["bb", "ee"], ["aa", "bb", "cc"], list(words)) for _ in range(4)]
    return labelled, [*texts, "", "12 34", "x", "Q" * 300, "AA bb\tCC\n" * 40, None]


def test_mixtures_by_brute_force(spark, stock):
    labelled, texts = stock
    rows = [(i, text, lang) for i, (text, lang) in enumerate(labelled)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    counts = learned(labelled)
    sets = Counter()
    for r in got:
        text = texts[r["doc_id"]] or ""
        expected = mixture(counts, text) if re.search(r"[^\W\d_]", text) else {}
        made = dict(zip(r["languages"], r["proportions"]))
        assert set(made) == set(expected), text
        assert all(abs(made[x] - expected[x]) < 1e-3 for x in made), (text, made, expected)
        if expected:
            assert abs(r["score"] - max(expected.values())) < 1e-3 and expected[r["lang_pred"]] > r["score"] - 1e-3
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        sets[len(expected)] += 1
    assert sets[1] and sets[2] and sets[3]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


SPACE = " \t\n\x0b\f\r"


def units(paragraph):
    """Up to eight words of at most 32 characters with the white space around them, or up to 64 of a longer word."""
    found, at, n = [], 0, len(paragraph)

    def blank(i):
        while i < n and paragraph[i] in SPACE:
            i += 1
        return i

    def word(i):
        while i < n and paragraph[i] not in SPACE:
            i += 1
        return i

    while at < n:
        begin, end, words = blank(at), blank(at), 0
        while words < 8 and end < n and word(end) - end <= 32:
            end, words = blank(word(end)), words + 1
        if not words and begin < n:
            end = blank(min(word(begin), begin + 64))
        found.append(paragraph[at:end])
        at = end
    return found


def tree(text):
    """Root hash, and all unit hashes."""
    roots, leaves = [], []
    for section in text.split("\n\n"):
        hashes = []
        for paragraph in section.split("\n"):
            own = [sha(u) for u in units(paragraph)]
            leaves += own
            hashes.append(sha(*own))
        roots.append(sha(*hashes))
    return sha(*roots), leaves


def like(a, b):
    (root_a, a), (root_b, b) = tree(a), tree(b)
    if root_a == root_b:
        return 1.0
    # a text without a unit has one empty entry
    a, b = ({u[:8] for u in x} or {""} for x in (a, b))
    return 2 * len(a & b) / (len(a) + len(b))


def test_fingerprints_by_brute_force(make_docs):
    """Whole trees: roots, likeness to the edited text and likeness to the next one, with ties, nulls and odd texts."""
    rng = random.Random(22)
    words = ["word", "other", "漢字かな" * 12, "é", "x" * 33, "y" * 32, "z" * 200, "🙂"]
    gaps = [" ", " ", " ", "  ", "\t", "\n", "\n\n", "\n\n\n"]
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.choice([1, 5, 30, 200]))) for _ in range(40)]
    texts += [None, "", "\n", "\n\n", " ", "a", "a b c", texts[0], texts[3], texts[3] + " more", "\n\n".join(texts[:5])]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in merkle.edited_likeness(make_docs(rows)).collect()}
    assert set(got) == set(range(len(rows)))
    for i, text in rows:
        text, following = text or "", texts[i - 1] or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + following[:cut]
        r = got[i]
        assert r["edited_sha256"] == sha(edited) and r["n_chars"] == len(text)
        assert r["fingerprint"][:64] == tree(text)[0] and r["edited_fingerprint"][:64] == tree(edited)[0]
        assert r["near_edited"] == pytest.approx(like(text, edited)), i
        assert r["near_next"] == pytest.approx(like(text, following)), i
