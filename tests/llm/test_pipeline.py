"""The pipeline against its stages by brute force."""
from __future__ import annotations

import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from test_dedup import near_components, words  # noqa: E402
from test_texts import best_fit, brute_decontamination  # noqa: E402

from pagetally.llm import language  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rng = random.Random(11)
    stock = {"en": "the of and house water think with their would", "de": "der die und nicht schön große Straße über mit"}

    def text(lang, n):
        return " ".join(rng.choice(stock[lang].split()) + str(rng.randrange(500)) for _ in range(n))

    items = [(k, text("en", 20)) for k in range(4)]
    passage, rows = text("en", 70), []
    for i in range(40):
        lang = "en" if i % 3 else "de"
        rows.append((i, text(lang, rng.randrange(5, 120)), lang))
    base = text("en", 90)
    rows += [(50 + i, base, "en") for i in range(3)] + [(60, base + " end", "en")]
    rows += [(70 + i, text("en", 20) + " " + passage + "\n" + text("en", 15), "en") for i in range(3)]
    rows += [(80 + k, text("en", 30) + " " + t + " " + text("en", 10), "en") for k, t in items]
    rows += [(90, "123 456", None), (91, None, None), (92, "", "en"), (93, passage, "en")]
    docs = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), [(i, t) for i, t, _ in rows], items


def test_run(spark, tables):
    folder, rows, items = tables
    kept = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    components = near_components(kept, 5, 80)
    kept = [(i, t) for i, t in kept if components[i] == i]
    first = {}
    for i, t in kept:
        w = words(t)
        for p in range(len(w) - 49):
            first[tuple(w[p:p + 50])] = min(first.get(tuple(w[p:p + 50]), i), i)
    left = []
    for i, t in kept:
        w = words(t)
        out = {q for p in range(len(w) - 49) if first[tuple(w[p:p + 50])] < i for q in range(p, p + 50)}
        t = b" ".join(x for q, x in enumerate(w) if q not in out).decode() if out else t
        if t:
            left.append((i, t))
    leaked = {i for i, _, _ in brute_decontamination(left, items)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in left if i not in leaked}
    assert len(leaked) == 4 and len(kept) < len(rows) - 4 and len(left) < len(kept)
    got = corpus_pipeline.run(spark, folder).collect()
    made = defaultdict(int)
    for r in got:
        made[r["doc_id"]] += r["length"]
    assert made == n
    assert len({r["sequence_id"] for r in got}) == best_fit([r["length"] for r in got], 1024)


def test_stages_return_the_columns_of_documents(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert dict(stage(spark, docs, folder).dtypes) == dict(docs.dtypes)
    assert Counter(name for name, _ in corpus_pipeline.STAGES).most_common(1)[0][1] == 1


def test_the_language_stage_drops_texts_without_a_main_language(spark):
    rng = random.Random(5)
    stock = {k: [k + "".join(rng.choice(letters) for _ in range(5)) for _ in range(60)] for k, letters in (("b", "abcdefgh"), ("m", "ijklmnop"), ("t", "qrstuvwx"))}

    def text(**counts):
        chosen = [rng.choice(stock[k]) for k, n in counts.items() for _ in range(n)]
        rng.shuffle(chosen)
        return " ".join(chosen)

    rows = [(i, text(**{k: 60}), k) for i, k in enumerate("bmt" * 20)]
    # thirds, with and without a stated language and twice; then main languages of three quarters and of all
    rows += [(100, text(b=40, m=40, t=40), "b"), (101, text(b=40, m=40, t=40), None), (101, text(b=40, m=40, t=40), None)]
    rows += [(110, text(b=90, m=30), "b"), (111, text(m=90, t=30), None), (112, text(t=90, b=30), "b"), (113, text(t=60), None), (114, "12 34", "b"), (115, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = sorted(tuple(r) for r in corpus_pipeline.identify_language(spark, docs, "").collect())
    found = {111: "m", 113: "t"}
    assert made == [(i, t, found.get(i, k)) for i, t, k in rows if i not in (100, 101, 114, 115)]
    model = language.fit(docs.filter(~language.held_out()))
    judged = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert {i for i, r in judged.items() if r.score < 0.5} == {100, 101, 114, 115} and len(judged[100].languages) == 3
