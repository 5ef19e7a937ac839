"""Operators that read each text on its own, or order documents, against the library they follow or a brute-force version."""
from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagetally.llm import bpe, decontaminate, html, language, merkle, packing, shards

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, "a", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>z", "  two  spaces \n\n\t", "don't I'LL we've", "日本語のテキスト", "é́ naïve ½²", "a b c", "😀" * 50, "a" * 5000, "\x00\x1c\x85", "1234567 89"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def test_token_counts(make_docs, library, corpus):
    rows = corpus + [(1000 + i, t) for i, t in enumerate(ODD)]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in bpe.token_counts(make_docs(rows), BPE).collect())
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == Counter((i, len((t or "").encode()), k, k > 512) for (i, t), k in zip(rows, n))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), st.sampled_from(" \n'sté½ab")), max_size=40))
def test_any_text_counts_like_the_library(text):
    library = Tokenizer.from_file(BPE) if not hasattr(test_any_text_counts_like_the_library, "t") else test_any_text_counts_like_the_library.t
    test_any_text_counts_like_the_library.t = library
    ids = library.encode(text, add_special_tokens=False).ids
    assert bpe.count_tokens(text, BPE) == len(ids)
    assert packing.token_ids(text, BPE) == np.array(ids, "<u4").tobytes()


def test_packing(make_docs, library, corpus):
    rows = [(i, t) for i, t in corpus if i not in (170, 171)] + [(1000 + i, t) for i, t in enumerate(ODD)]
    got = packing.pack(make_docs(rows), BPE, capacity=128).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows if i is not None}
    nulls = [len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows if i is None]
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        assert 0 < r["length"] <= 128 and r["offset"] + r["length"] <= 128
        if r["doc_id"] is not None:
            part = np.array(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
            assert r["length"] == 128 or r["piece"] == 0
    assert {i: sum(r["length"] for r in x) for i, x in pieces.items() if i is not None} == {i: len(x) for i, x in ids.items()}
    assert sum(r["length"] for r in pieces[None]) == sum(nulls)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)]).tolist()]
        assert [o for o, _ in sorted(places)] == ends[:-1]
    assert len(sequences) == best_fit([r["length"] for r in got], 128)


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= n]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan_over_counts_is_best_fit(counts):
    slots = packing.plan(counts, 30)
    used = defaultdict(int)
    taken = Counter()
    for s in slots:
        n = min([x.first for x in slots if x.length == s.length and x.first > s.first], default=counts[s.length]) - s.first
        taken[s.length] += n
        for k in range(n):
            sequence, offset = s.sequence + k // s.per, s.offset + k % s.per * s.length
            assert used[sequence] == offset
            used[sequence] += s.length
    assert taken == Counter(counts) and all(x <= 30 for x in used.values())
    assert len(used) == best_fit([n for n, c in counts.items() for _ in range(c)], 30)


def test_shards(make_docs, corpus):
    got = shards.shards(make_docs(corpus), 4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in corpus)
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    for k in range(4):
        own = [r for r in got if r["shard"] == k]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 4) <= most
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids) and {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None for r in got)


def test_shards_keep_copies_together(make_docs, corpus):
    rows = corpus + [(2000 + i, "a hot text of which a third of all rows are copies") for i in range(60)]
    for n_shards in (1, 4, 7):
        got = shards.shards(make_docs(rows), n_shards, together=True).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
        for k in range(n_shards):
            own = [r for r in got if r["shard"] == k]
            assert sorted(r["slot"] for r in own) == list(range(len(own)))
            assert abs(sum(r["size"] for r in own) - total / n_shards) <= most
        ordered = [(r["size"], r["text_crc32"]) for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
        changes = 1 + sum(a != b for a, b in zip(ordered, ordered[1:]))
        assert changes == len(set(ordered))
    assert shards.shards(make_docs([]), together=True).count() == 0


def test_fingerprints(make_docs, corpus):
    docs = make_docs(corpus)
    got = merkle.edited_likeness(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in corpus)
    plain = [(i, t or "") for i, t in corpus if i is not None and i not in (170, 171)]
    single = make_docs(plain)
    order = sorted(plain, key=lambda x: -x[0])
    made = {r["doc_id"]: r for r in merkle.edited_likeness(single).collect()}
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(t)
        edited = t[:n - n // 3] + following[:n // 3]
        assert made[i]["n_chars"] == n and made[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (made[i]["fingerprint"] == made[i]["edited_fingerprint"]) == (t == edited)
        assert 0 <= made[i]["near_next"] <= 1 and 0 <= made[i]["near_edited"] <= 1
        assert (made[i]["near_edited"] == 1) >= (t == edited)
    equal = defaultdict(set)
    for i, t in plain:
        equal[t].add(made[i]["fingerprint"])
    assert all(len(x) == 1 for x in equal.values()) and len({min(x) for x in equal.values()}) == len(equal)


def test_branches_locate_edits(spark):
    a, b = "first line\nsecond line\n\nthird\nfourth", "first line\nsecond CHANGED\n\nthird\nfourth\nfifth"
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    prints = rows.select(merkle.fingerprint(merkle.sections(rows["a"])).alias("a"), merkle.fingerprint(merkle.sections(rows["b"])).alias("b"))
    found = prints.select(merkle.differing(prints["a"], prints["b"]).alias("x"), merkle.likeness(prints["a"], prints["b"]).alias("y")).first()
    assert [tuple(x) for x in found["x"]] == [(0, 1), (1, 2)] and found["y"] == pytest.approx(2 * 3 / (4 + 5))


def test_units_of_text_without_white_space(spark, make_docs):
    rng = random.Random(6)
    chinese = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000)) for _ in range(2)]
    got = {r["doc_id"]: r for r in merkle.edited_likeness(make_docs([(1, chinese[0]), (2, chinese[1])])).collect()}
    assert all(0.6 < r["near_edited"] < 0.7 and r["near_next"] == 0 for r in got.values())
    # the units are the text, and words of usual length are cut as before
    odd = [(i, t or "") for i, t in enumerate([*ODD, "word " * 20 + "x" * 100 + " end " + "y" * 33 + "z", "x" * 32 + " " + "x" * 33, "one two three four five six seven eight nine ten"])]
    cut = spark.createDataFrame(odd, "i int, t string").selectExpr("t", f"regexp_extract_all(t, r'{merkle.UNIT}', 0) as u", "regexp_extract_all(t, r'\\s*(?:\\S+\\s*){1,8}|\\s+', 0) as v").collect()
    assert all("".join(r["u"]) == r["t"] and all(len(u.strip()) <= 8 * 33 for u in r["u"]) for r in cut)
    assert all(r["u"] == r["v"] for r in cut if max(map(len, r["t"].split()), default=0) <= 32)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    right = [r["lang_pred"] == r["lang"] for r in got if r["held_out"]]
    assert sum(right) >= 0.95 * len(right)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_language_mixture_and_odd_texts(make_docs):
    en, de = "the house with the water and this thing that they think", "der schöne Hund und das große Haus nicht ohne Schlüssel"
    train = make_docs([(i, en if i % 2 else de) for i in range(20)], ["en" if i % 2 else "de" for i in range(20)])
    model = language.fit(train)
    rows = [(1, en), (2, de), (3, (en + " " + de + " ") * 5), (4, None), (5, ""), (6, "123 !!"), (None, en), (7, "x" * 3), (1, en)]
    got = {(r["doc_id"], r["lang_pred"], tuple(sorted(r["languages"]))) for r in language.identify(make_docs(rows), model).collect()}
    assert {(1, "en", ("en",)), (2, "de", ("de",)), (None, "en", ("en",)), (4, "und", ()), (5, "und", ()), (6, "und", ())} <= got
    assert [x[2] for x in got if x[0] == 3] == [("de", "en")]
    assert [r["doc_id"] for r in language.identified(make_docs(rows[3:6]), model).collect()] == []
    nothing = language.fit(make_docs([]))
    assert {r["lang_pred"] for r in language.identify(make_docs(rows), nothing).collect()} == {"und"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1><a href="/">home</a></header><nav><ul><li><a href=x>The menu of the site</a></ul></nav><div class="cookie-notice">We use the cookies of this site and that is all that you need to know about it.</div>
<article><h1>The head &amp; line</h1><p>The first of the   paragraphs is
long and it has what it takes to be read as text of the page: of and to in is that it was for.<p>Short.</p><div class="share"><a href=y>Share this</a></div>
<p>Last one, &eacute;t&#233; &lt;b&gt; <b>bold</b><br>and more</p><form><label>Name of the reader</label></form></article>
<section id="comments"><p>This is the comment of a reader and it is long enough to look like the text of the page itself.</p></section>
<aside>The sidebar of the page</aside><footer>&copy; the owner</footer>"""


def test_extraction(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p>" + "The text of the page without an article is in the body of it and that is what it has to be. " * 4 + "</p><p>And on.</p><p>" + "This is the end of the text that was in the page and it is for all of us to be read as such. " * 3), (None, "x", "<article>&amp &am x"), (1, "u", PAGE)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {(r["page_id"], r["url"]): r["text"] for r in got}
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert text[1, "u"].split("\n") == [
        "The head & line", "The first of the paragraphs is long and it has what it takes to be read as text of the page: of and to in is that it was for.",
        "Short.", "Last one, été <b> bold and more",
    ]
    assert text[2, None] == text[3, "v"] == "" and text[None, "x"] == "& &am x"
    assert text[4, "w"].count("\n") == 2 and "\nAnd on.\n" in text[4, "w"]


ARTICLE = "<article><h1>The head</h1><p>" + "This is the text of the article and it is in the page for all of us to be read as such. " * 3 + "</p></article>"


def test_wrappers_of_an_article_are_not_marks():
    whole = html.main_text(ARTICLE)
    assert len(whole) > 250
    for attribute in (
        'class="layout has-sidebar"', 'class="no-sidebar"', 'class="ad-free"', 'class="sticky-nav"', 'class="overflow-hidden"', 'style="overflow:hidden"',
        'data-state="not hidden yet"', "data-x=hidden", 'class="sidebar-right"', 'id="sidebar"', 'class="header menu"', 'style="background-position:hidden"',
    ):
        for name in ("div", "section"):
            assert html.main_text(f"<nav>The menu of the site</nav><{name} {attribute}>{ARTICLE}</{name}>") == whole, attribute
        if attribute not in ('class="sidebar-right"', 'id="sidebar"', 'class="header menu"'):
            assert html.main_text(f"<div {attribute}>{ARTICLE.replace('article>', 'div>')}</div>") == whole, attribute
    assert html.main_text(f"<form id=all>{ARTICLE}</form>") == whole


def test_marked_and_hidden_elements_stay_out():
    whole, other = html.main_text(ARTICLE), "<p>This is what was not to be in the text of the page and it is long enough to be read as such.</p>"
    for attribute in (
        "class=sidebar", 'class="left ad"', 'class="cookie-notice"', 'id="comments-list"', "hidden", 'hidden=""', 'aria-hidden="true"', 'style="color:red; display: none"',
        'style="visibility:hidden !important"', "role=banner",
    ):
        inner = ARTICLE.replace("</article>", f"<div {attribute}>{other}</div></article>")
        assert html.main_text(inner) == whole, attribute
    for apart in (f"<div id=comments><article>{other}</article></div>", f'<div id=comments><article class="comment-body">{other * 9}</article></div>', f"<aside><article>{other}</article></aside>"):
        assert html.main_text(ARTICLE + apart) == html.main_text(f"<main>{ARTICLE}{apart}</main>") == whole, apart


def test_linked_text_of_an_article_stays():
    long = "This is the text of the article and it is in the page for all of us to be read as such. " * 3
    page = f"""<article><h1><a href=x>The linked head</a></h1><p>{long}</p><p>See <a href=y>the report</a> first.</p><p><a href=z>Read more</a></p>
    <p>{long}</p><h2>Sources</h2><ul><li><a href=r>Report of the year</a></li><li><a href=s>Another report</a>, 2020</li></ul></article><p>Outside <a href=y>of it</a></p>"""
    assert html.main_text(page).split("\n") == [
        "The linked head", long.strip(), "See the report first.", long.strip(), "Sources", "Report of the year", "Another report, 2020",
    ]


def test_text_beside_a_card_stays():
    long = ["This is the text of the page and it is in the body for all of us to be read as such. " * 3 + x for x in "abc"]
    content = "<div id=content>" + "".join(f"<p>{x}</p>" for x in long) + "</div>"
    for card in ("<article class=card><h3><a href=x>Another</a></h3></article>", "<article><a href=x>Another</a></article>", "<div class=related><article>Another one</article></div>"):
        for page in (card + content, content + card):
            assert [x for x in html.main_text(page).split("\n") if "Another" not in x] == long
    middling = [x[:150] for x in long]
    assert [x for x in html.main_text("<article>Another one</article>" + "".join(f"<p>{x}</p>" for x in middling)).split("\n") if "Another" not in x] == [x.strip() for x in middling]
    # a page whose article has most of the text is that article
    assert html.main_text("<article>" + content + f"</article><p>{long[0]}</p>").split("\n") == long


def test_short_blocks_belong_to_the_element_that_has_the_text():
    long = "This is the text of the page and it is in the body for all of us to be read as such. " * 3
    inner = f"<h1>The head</h1><p>Short begin.</p><p>{long}</p><div class=ad>Buy this</div><p>Between.</p><section><p>{long}</p></section><p>The end.</p>"
    frame = "<div id=top>Slogan of the site</div><ul><li><a href=x>Menu</a></ul>%s<ul><li><a href=x>More</a></ul><div>Owner, 2020</div>"
    wanted = ["The head", "Short begin.", long.strip(), "Between.", long.strip(), "The end."]
    for name in ("article", "main", "div", "section", "center", "td"):
        for page in (f"<{name}>{inner}</{name}>", frame % f"<{name}>{inner}</{name}>", f"<div>{frame % f'<{name}>{inner}</{name}>'}</div>"):
            assert html.main_text(page).split("\n") == wanted, (name, page[:40])
    # without an element of its own the text begins and ends at what is bad
    assert html.main_text(f"<body>{frame % inner}").split("\n") == wanted
    assert html.main_text("<div>" * 3000 + inner) .split("\n") == wanted


def test_pages_read_alike_without_article_and_main(spark):
    pages = [r["html"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    alike = sum(html.main_text(x) == html.main_text(re.sub(r"(?i)<(/?)(?:article|main)\b", r"<\1div", x)) for x in pages)
    assert 10 * alike >= 9 * len(pages) > 0


def test_languages_without_stop_words():
    menu = "<ul><li><a href=a>Menu</a></li><li><a href=b>Kontakt</a></li></ul>"
    for text in (
        "Wczoraj rano mieszkańcy małego miasteczka zobaczyli niezwykłe zjawisko nad jeziorem, które przyciągnęło wielu ciekawskich turystów. ",
        "Вчера утром жители небольшого города увидели над озером необычное явление, которое привлекло многих любопытных туристов. ",
        "昨天早上，小镇的居民在湖面上看到了一种不寻常的现象，吸引了许多好奇的游客前来观看，当地报纸也作了报道。",
    ):
        for times in (1, 3):
            paragraphs = [(text * times + str(i)) for i in range(3)]
            page = menu + "<div>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div>" + menu
            assert html.main_text(page).split("\n") == paragraphs, text
    mixed = "<p>" + "The text of the page is in the body of it and that is what it has to be. " * 4 + "</p><p>" + "Вчера утром жители города увидели над озером необычное явление. " * 4 + "</p>"
    assert len(html.main_text(mixed).split("\n")) == 2


def test_broken_markup_never_fails():
    rng = random.Random(2)
    for _ in range(300):
        page = "".join(rng.choice(["<p", ">", "</", "<a href='", "text ", "<script>", "</script", "<!--", "-->", "&#x;", "<div class=ad>", "</p>", "<h1>", "\""]) for _ in range(30))
        html.main_text(page)


def test_broken_markup_takes_time_in_proportion():
    for page in ("<b>" * 60_000 + "</i>" * 60_000, "<p><div>" + "<b>" * 60_000 + "<hr>" * 60_000, "<svg>" * 60_000, "<p>" + "<b>" * 60_000 + "<div></div>" * 60_000, f"<div>{'The text of it is in the page. ' * 8}" * 20_000):
        began = time.perf_counter()
        html.main_text(page)
        assert time.perf_counter() - began < 5, page[:20]


def test_a_text_is_judged_alike_beside_any_others(spark):
    rng = random.Random(8)
    stock = {k: [f"{k}{''.join(rng.choice('abcdefghij' if k < 'n' else 'klmnopqrst') for _ in range(5))}" for _ in range(60)] for k in "bdgmprtw"}
    rows = [(i, " ".join(rng.choice(stock[k]) for _ in range(60)), k) for i, k in enumerate("bdgmprtw" * 12)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(labelled)
    mixtures = [" ".join(rng.choice(stock[rng.choice("bdgmprtw"[:n])]) for _ in range(80)) for n in (1, 2, 3, 5, 8) for _ in range(12)] + ["", "x", "12"]
    together, _ = language.shares(model, mixtures)
    for text, row in zip(mixtures, together):
        alone, _ = language.shares(model, [text])
        assert np.allclose(alone[0], row, atol=1e-5) and ((alone[0] > 0) == (row > 0)).all()


def test_rare_languages_are_learned(spark):
    assert language.equal_part([10, 10_000, 20_000], 1000) == 495 and language.equal_part([5, 7], 1000) >= 7 and language.equal_part([], 10) == 10
    rows = [(i, f"frequent words number {i}", "en") for i in range(3000)] + [(5000 + i, f"seltene Wörter Nummer {i}", "de") for i in range(4)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_docs=100)
    assert model.languages == ("de", "en")


def test_null_languages_are_filled(spark):
    rows = [(i, "the house of the water and the wind", "en") for i in range(9)] + [(20, "das Haus und der Wind und das Wasser", "de"), (30, "the water of the house", None), (31, "der Wind und das Haus", None), (32, "12", None), (33, "the house", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs.filter("doc_id < 30"))
    made = {r.doc_id: r.lang for r in language.identified(docs, model, 0.0, lang_col="lang").collect()}
    assert (made[30], made[31], made[33]) == ("en", "de", "xx") and 32 not in made
    assert {r.doc_id: r.lang for r in language.identified(docs, model, 0.0).collect()}[30] is None


def brute_decontamination(rows, items):
    plain = bytes(decontaminate._PLAIN)
    def parts(t):
        return (t or "").encode().translate(plain).split()

    def bag(w):
        found = Counter()
        for k in range(len(w) - 4):
            found[tuple(w[k:k + 5])] += sum(map(len, w[k:k + 5]))
        return found

    for i, t in rows:
        w = parts(t)
        for item, u in items:
            v = parts(u)
            if not v or not w:
                continue
            if len(v) < 5:
                if any(w[b:b + len(v)] == v for b in range(len(w) - len(v) + 1)):
                    yield i, item, 1.0
                continue
            if len(w) < 5:
                continue
            n = min(len(v), len(w))
            target = bag(v)
            best = 0.0
            for b in range(len(w) - n + 1):
                ours = bag(w[b:b + n])
                common = sum((ours & target).values())
                best = max(best, common / (sum(ours.values()) + sum(target.values()) - common))
            if best >= 0.8:
                yield i, item, best


def test_decontamination(spark, make_docs, corpus):
    rng = random.Random(5)
    items = [(k, " ".join(f"q{rng.randrange(3000)}" for _ in range(rng.randrange(15, 60)))) for k in range(12)]
    items += [(20, None), (21, ""), (22, "one"), (23, items[3][1]), (24, "Two, words!"), (25, "how many are there"), (26, "How many, are"), (27, "how many are there")]
    rows = list(corpus) + [(165, "one two"), (380, "He asked: how many are there? How many? " + corpus[0][1]), (381, corpus[1][1] + " how many are"), (382, "there how many are")]
    for k in range(10):
        w = items[k][1].split()
        w[0 if k % 2 else -1] = "edited"
        rows.append((300 + k, "Before it. " + " ".join(w).title() + ". after, all"))
        rows.append((330 + k, items[k][1]))
        rows.append((350 + k, " ".join(items[k][1].split()[:len(w) // 2])))
    rows.append((370, "two words"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"] or -1, r["item_id"], round(r["similarity"], 9)) for r in decontaminate.contaminated(make_docs(rows), benchmark).collect())
    expected = sorted((i or -1, item, round(s, 9)) for i, item, s in brute_decontamination(rows, items))
    assert got == expected and len(got) > 15
    left = Counter(r["doc_id"] for r in decontaminate.clean(make_docs(rows), benchmark).collect())
    assert left == Counter(i for i, t in rows if (i or -1, t) not in {(a, t) for a, _, _ in expected})
    assert decontaminate.contaminated(make_docs([]), benchmark).count() == 0
    assert decontaminate.contaminated(make_docs(rows), benchmark.limit(0)).count() == 0


def test_a_hot_shingle_costs_no_more_than_its_text():
    """Items of many lengths that begin alike, and a document that repeats their beginning and holds one of them."""
    six = "alpha beta gamma delta epsilon zeta"
    texts = [six + " " + " ".join(f"i{k}w{j}" for j in range(10 + k)) for k in range(60)]
    items = decontaminate.Items(list(range(60)), texts)
    raw = np.frombuffer(((six + " ") * 20_000 + texts[7]).encode(), np.uint8)
    began = time.perf_counter()
    found = items.look(raw, np.array([0, len(raw)]), 0.8)
    assert set(found) == {(0, 7)} and found[0, 7][:3] == (1.0, 120_000, 23)
    assert time.perf_counter() - began < 5


def test_benchmark_in_several_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 400)
    items = [(k, " ".join(f"b{k}x{j}" for j in range(12))) for k in range(20)]
    docs = make_docs([(k, "some words " + t) for k, t in items])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(decontaminate.item_blocks(benchmark, "item_id", "text"))) > 2
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()) == [(k, k) for k in range(20)]


def test_all_within_the_radius_are_found():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"z{x}" for x in rng.integers(0, 10000, 20)) for _ in range(30)]
    items = decontaminate.Items(list(range(30)), texts)
    prints = []
    for p in items.prints:
        for n in (0, 5, 19, 20):
            flips = rng.choice(64, n, replace=False)
            prints.append(int(p) ^ sum(1 << int(b) for b in flips))
    prints = np.array(prints, np.uint64)
    apart = np.bitwise_count(prints[:, None] ^ items.prints[None, :])
    assert {(w, i) for w, i, _ in items.near(prints)} == set(zip(*(x.tolist() for x in np.nonzero(apart <= decontaminate.RADIUS))))


def test_empty_tables(spark, make_docs):
    docs = make_docs([])
    for made in (bpe.token_counts(docs, BPE), packing.pack(docs, BPE), shards.shards(docs), merkle.edited_likeness(docs), language.identify_languages(docs)):
        assert made.count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_item_ids_of_other_types(spark, make_docs):
    docs = make_docs([(1, "a passage of six words here"), (2, "nothing of it")])
    for kind, value in (("int", 7), ("string", "seven"), ("short", 7), ("long", None)):
        benchmark = spark.createDataFrame([(value, "a passage of six words here")], f"item_id {kind}, text string")
        assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()] == [(1, value)]


def test_training_on_a_sample(spark):
    docs = spark.createDataFrame([(i, "the house" if i % 2 else "das haus", "en" if i % 2 else "de") for i in range(4000)], "doc_id long, text string, lang string")
    model = language.fit(docs, train_docs=500)
    assert model.languages == ("de", "en")
    assert language.fit(docs.filter("lang is null")).languages == ()
