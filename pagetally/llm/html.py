"""Main text of web pages by block rules in two passes.

First each block is judged alone by stop-word density, length and link density; then blocks too short to tell, and
blocks near the border, take the label of their nearest decided neighbours.
On pages without article or main, the innermost element with
nine tenths of the good text bounds those neighbours: within it only a block judged bad is bad.
"""
from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, German, French, Spanish, Italian and Portuguese.
STOP_WORDS = frozenset(
    "the of and to in is that it for was on with as be at by this have from or are not but which they an were been "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an dem im er sie wir ich bei "
    "le la les de des du et un une est en que qui dans pour par sur pas au avec ce il elle sont plus ne se on ou "
    "el los las del y que se una con por para su como más al lo es son este "
    "di che il per non sono della dei è gli "
    "o os do da em um uma não ao dos".split()
)

#: Elements whose content is no markup; without an end tag they run to the end of the page.
RAW = frozenset("script style noscript title iframe textarea".split())
#: Elements whose content is never text of the page.
SILENT = RAW | frozenset("template svg math object select button canvas audio video".split())
#: Elements that hold no content of the page itself.
OUTSIDE = frozenset("nav header footer aside form menu dialog".split())
#: Elements that hold it.
INSIDE = frozenset("article main".split())
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "html body p div section article main header footer nav aside form menu dialog ul ol li dl dt dd table caption thead tbody "
    "tfoot tr td th h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address fieldset legend hr details summary center".split()
)
#: Elements that group blocks: one of them holds the text where no article or main does.
HOLDERS = frozenset("html body div section article main table td center details".split())
#: Elements whose links may be what the list or table is about.
ITEMS = frozenset("li dt dd td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class or id that mark what does not belong to the text, as the whole name or its leading word ("sidebar-left").
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies disqus "
    "disclaimer footer header masthead menu menubar nav navbar navigation newsletter notice notices popup promo promoted promotion related "
    "share sharing sidebar social sponsor sponsored subscribe teaser toolbar widget consent gdpr replies pagination".split()
)
#: Last words of a name that tells a state of the page ("ad-free", "menu-open") and not what the element is.
STATES = frozenset("free less none off on open opened closed collapsed expanded enabled disabled visible hidden active".split())
#: An opened `p` ends where one of these begins.
CLOSES_P = BLOCKS - {"html", "body"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in SILENT}
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
#: Letters of the languages of STOP_WORDS, and letters of which one says as much as three of those.
_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f]")
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")

#: Code points below which a block is too short to be judged alone, and share of link text above which it is no text.
SHORT, LONG, LINKS = 70, 200, 0.5
#: The same share within the page's article, where a link in a sentence is text.
ONLY_LINKS = 0.9
#: Share of stop words from which a block reads as text, and from which it may.
STOPS_HIGH, STOPS_LOW = 0.18, 0.08


#: Share of the good unlinked text that the holder of the page's text has at least.
HELD = 0.9


class Holder:
    """An element that groups blocks, with what good text stands in it."""

    __slots__ = ("parent", "number", "held")

    def __init__(self, parent: Holder | None, number: int):
        self.parent, self.number, self.held = parent, number, 0


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    inside: bool
    outside: bool
    item: bool  # of a list or table
    raised: bool  # in an article or main whose own ancestor is marked
    holder: Holder
    label: str = ""


def _marks(attributes: str) -> tuple[bool, bool]:
    """Whether the class, id or role marks the element as no part of the text, and whether it is hidden."""
    marked = hidden = False
    for found in _ATTRIBUTE.finditer(attributes):
        name, value = found[1].lower(), (found[2] or found[3] or found[4] or "").lower()
        if name in ("class", "id", "role"):
            for word in value.split():
                words = [w for w in re.split("[_-]+", word) if w]
                marked |= bool(words) and words[0] in MARKS and (len(words) == 1 or words[-1] not in STATES)
        elif name == "hidden":
            hidden |= value != "until-found"
        elif name == "aria-hidden":
            hidden |= value.strip() == "true"
        elif name == "style":
            for rule in value.split(";"):
                key, _, what = rule.partition(":")
                what = what.replace("!important", "").strip()
                hidden |= (key.strip(), what) in (("display", "none"), ("visibility", "hidden"), ("visibility", "collapse"))
    return marked, hidden


def blocks(page: str) -> list[Block]:
    """The page cut at block elements, each with its share of link text and the containers it stands in.

    Broken markup is read as it comes: an end without a beginning is passed over, what is not closed ends with its
    container or the page, and `<` that begins no tag is text. A mark (or form) around an article or main does not put
    what stands inside that element outside, unless the article is marked too, as that of a comment is.
    """
    found: list[Block] = []
    holder = Holder(None, 0)
    holders = 1
    open_tags: list[tuple[str, bool, bool, bool, int]] = []  # name, holds page content, holds none, is marked, marks it lifted
    parts: list[str] = []
    linked_parts: list[str] = []
    links = outside = inside = marks = raised = items = 0
    heading = False
    done = 0
    # so that no search goes twice over what is open or to the page's end: open elements by name, places of those at which
    # the search for an open p ends, and names without an end tag further on
    is_open: Counter[str] = Counter()
    stops: list[int] = []
    endless: set[str] = set()

    def close_block() -> None:
        nonlocal parts, linked_parts
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                linked = len(_SPACE.sub(" ", "".join(linked_parts)).strip())
                found.append(Block(text, linked, heading, inside > 0, outside > 0 or marks > 0, items > 0, raised > 0, holder))
            parts, linked_parts = [], []

    def text_until(end: int) -> None:
        if end > done:
            piece = html.unescape(page[done:end])
            parts.append(piece)
            if links:
                linked_parts.append(piece)

    def pop_to(i: int) -> None:
        nonlocal links, inside, outside, marks, raised, items, heading, holder
        while len(open_tags) > i:
            name, within, without, marked, lifted = open_tags.pop()
            is_open[name] -= 1
            if stops and stops[-1] == len(open_tags):
                stops.pop()
            if name in HOLDERS and holder.parent:
                holder = holder.parent
            links -= name == "a"
            items -= name in ITEMS
            inside -= within
            outside -= without
            marks += lifted - marked
            raised -= lifted > 0
            if len(name) == 2 and name[0] == "h" and name[1].isdigit():
                heading = False

    position = 0
    while (token := _TOKEN.search(page, position)) is not None:
        text_until(token.start())
        done = position = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        if name in SILENT:
            if not token[1] and not token[3].endswith("/"):
                end = None if name in endless else _ENDS[name].search(page, done)
                if end is None:
                    endless.add(name)
                if end or name in RAW:
                    done = position = end.end() if end else len(page)
            parts.append(" ")
            continue
        if name in BLOCKS or name == "br":
            if name == "br":
                parts.append(" ")
                continue
            close_block()
        if token[1]:
            if not is_open[name]:
                continue
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == name:
                    pop_to(i)
                    break
            continue
        if name in CLOSES_P and stops and open_tags[stops[-1]][0] == "p":
            pop_to(stops[-1])
        if name in VOID or token[3].endswith("/"):
            continue
        marked, hidden = _marks(token[3]) if token[3] and name not in ("html", "body") else (False, False)
        within, without, lifted = name in INSIDE, name in OUTSIDE, 0
        if within:
            # what is around an article or main says nothing of its text
            lifted, marked = 0 if marked else marks, False
        else:
            # a header within the article is its heading, but a form or a menu is not
            without = hidden or without and name != "form" and not (name == "header" and inside and not marked)
            marked |= name == "form"
        is_open[name] += 1
        if name in CLOSES_P:
            stops.append(len(open_tags))
        open_tags.append((name, within, without, marked, lifted))
        if name in HOLDERS:
            holder, holders = Holder(holder, holders), holders + 1
        links += name == "a"
        items += name in ITEMS
        inside += within
        outside += without
        marks += marked - lifted
        raised += lifted > 0
        if len(name) == 2 and name[0] == "h" and name[1].isdigit():
            heading = True
    text_until(len(page))
    close_block()
    return found


def _own(b: Block) -> int:
    """Code points that are no link."""
    return len(b.text) - b.linked


def _size(text: str) -> int:
    """Code points, those of Chinese, Japanese and Korean counted three times."""
    return len(text) if text.isascii() else len(text) + 2 * len(_WIDE.findall(text))


def _stops(texts: list[str]) -> float:
    found = [w for text in texts for w in _WORD.findall(text.lower())]
    return sum(w in STOP_WORDS for w in found) / max(1, len(found))


def _foreign(text: str) -> bool:
    """Whether most letters are of no language of STOP_WORDS."""
    letters = 0 if text.isascii() else sum(map(len, _WORD.findall(text)))
    return letters > 2 * len(_LATIN.findall(text))


def first_label(block: Block, unlisted: bool = False) -> str:
    """good, bad, near (of the border) or short (too little to tell). unlisted: the page is in no language of STOP_WORDS."""
    n = len(block.text)
    if block.outside:
        return "bad"
    if block.inside:
        # headings and lists of links may be the article's own
        if block.linked > ONLY_LINKS * n and not block.heading and not block.item:
            return "bad"
    elif block.linked > LINKS * n:
        return "bad"
    size = _size(block.text)
    if block.heading:
        return "short"
    if size < SHORT:
        return "bad" if block.linked and not block.inside else "short"
    stops = _stops([block.text])
    if stops < STOPS_LOW and (unlisted or _foreign(block.text)):
        return "good" if size > LONG else "near"
    if stops >= STOPS_HIGH:
        return "good" if size > LONG or block.inside else "near"
    if stops >= STOPS_LOW:
        return "good" if block.inside and size > LONG else "near"
    # what the page itself marks as its article is not dropped for its words
    return "near" if block.inside else "bad"


def _settle(found: list[Block], edge: str, headings: bool) -> None:
    """near and short become good or bad by the nearest decided blocks before and after. edge: what the ends count as."""
    labels = [b.label for b in found]
    n = len(labels)
    before, after = [edge] * n, [edge] * n
    last = edge
    for i in range(n):
        before[i] = last
        if labels[i] in ("good", "bad"):
            last = labels[i]
    last = edge
    for i in range(n - 1, -1, -1):
        after[i] = last
        if labels[i] in ("good", "bad"):
            last = labels[i]
    for i, b in enumerate(found):
        if labels[i] == "near":
            b.label = "bad" if before[i] == after[i] == "bad" else "good"
        elif labels[i] == "short":
            # a heading goes with what follows it
            b.label = after[i] if b.heading and headings else before[i] if before[i] == after[i] else edge


def _text_holder(found: list[Block]) -> Holder | None:
    """The innermost element that has HELD of the good unlinked text; None where no block is good."""
    every: dict[int, Holder] = {}
    for b in found:
        here: Holder | None = b.holder
        while here and here.number not in every:
            every[here.number] = here
            here.held = 0
            here = here.parent
        if b.label == "good":
            b.holder.held += _own(b)
    # an element has a higher number than what it stands in
    for number in sorted(every, reverse=True):
        if (parent := every[number].parent) is not None:
            parent.held += every[number].held
    good = sum(_own(b) for b in found if b.label == "good")
    return every[max(n for n in every if every[n].held >= HELD * good)] if good else None


def _held(found: list[Block], holder: Holder) -> list[Block]:
    """The blocks in the holder but for what comes before or after its good ones with a bad one in between."""
    within: dict[int, bool] = {holder.number: True}
    mine = []
    for b in found:
        here, passed = b.holder, []
        while here.number not in within and here.parent:
            passed.append(here.number)
            here = here.parent
        held = within.get(here.number, False)
        for number in passed:
            within[number] = held
        if held:
            mine.append(b)
    good = [i for i, b in enumerate(mine) if b.label == "good"]
    first = max((i + 1 for i in range(good[0]) if mine[i].label == "bad"), default=0)
    last = min((i for i in range(good[-1] + 1, len(mine)) if mine[i].label == "bad"), default=len(mine))
    return mine[first:last]


def decide(found: list[Block]) -> list[Block]:
    """The blocks that are main text. Where article or main hold most of the page's unlinked text, the others' blocks are out.

    Articles in a marked element (comments, related) are out only beside an unmarked one with more text.
    """
    raised = sum(_own(b) for b in found if b.raised and not b.outside)
    if raised < sum(_own(b) for b in found if b.inside and not b.raised and not b.outside):
        for b in found:
            b.outside |= b.raised
    article = [b for b in found if b.inside and not b.outside]
    whole = bool(article) and 2 * sum(map(_own, article)) >= sum(_own(b) for b in found if not b.outside)
    for b in article:
        b.label = first_label(b)
    # the ends of the page count as bad, those of its article as good
    _settle(article, "good", False)
    others = [b for b in found if not b.inside or b.outside]
    if whole:
        for b in others:
            b.label = "bad"
    else:
        unlisted = _stops([b.text for b in others if not b.outside and b.linked <= LINKS * len(b.text) and _size(b.text) >= SHORT]) < STOPS_LOW
        for b in others:
            b.label = first_label(b, unlisted)
        # where no block is long enough to be good alone, those near it are the text
        if not any(b.label == "good" for b in others):
            for b in others:
                b.label = "good" if b.label == "near" else b.label
        if (holder := _text_holder(others)) is not None:
            # within the element that has the text only blocks judged bad are bad, and its ends count as good
            _settle([b for b in _held(others, holder) if not b.outside], "good", False)
        _settle(others, "bad", True)
    return [b for b in found if b.label == "good"]


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in decide(blocks(page or "")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page; a null page is empty, a page without main text gives an empty text.

    White space within a block is one space, blocks are joined by one line feed. Repeated rows are read each, null ids and
    urls stay null, other columns are not read. Nothing is shuffled.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array(map(len, made), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
