"""Token counts by byte-pair merging with a heap over a linked list of symbols.

The count of a text is its symbols minus the merges; no identifiers are made. Merging happens within the pieces that
the tokenizer's split gives, and a piece met before is not merged again.
"""
from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import held, small_batches

#: Pieces a worker remembers; beyond that it starts anew, so memory stays bounded.
REMEMBERED = 800_000


def _latin_split() -> re.Pattern:
    """The byte-level split for texts of code points below 256, with the classes spelled out by their Unicode property."""
    letters, digits, space = (
        "".join(re.escape(chr(i)) for i in range(256) if regex.match(kind, chr(i))) for kind in (r"\p{L}", r"\p{N}", r"\s")
    )
    endings = "'s|'t|'re|'ve|'m|'ll|'d"
    return re.compile(
        f"{endings}| ?[{letters}]+| ?[{digits}]+| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


class Splitter:
    """Pieces of a text, as the byte-level tokenizer of a file cuts it, and its special strings."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.path = path
        content = self.content()
        if (content.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or content.get("normalizer"):
            raise ValueError(f"{path}: not a byte-level tokenizer without a normalizer")
        specials = {x["content"]: x["id"] for x in content.get("added_tokens", [])}
        self.specials = specials
        longest_first = sorted(specials, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if specials else None
        self.latin = _latin_split()

    def content(self) -> dict:
        """What the file says; not kept, as it is large."""
        with open(self.path, encoding="utf-8") as file:
            return json.load(file)

    def pieces(self, text: str) -> list[str]:
        """Of a text without special strings."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
            return [text[a:b] for _, (a, b) in cut]
        return self.latin.findall(text)

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Runs of ordinary text, and special strings with their id, as the library finds them by default."""
        done = 0
        if self.special is not None:
            for found in self.special.finditer(text):
                if found.start() > done:
                    yield text[done:found.start()], None
                yield found.group(), self.specials[found.group()]
                done = found.end()
        if done < len(text):
            yield text[done:] if done else text, None


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, free = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(free)
            free += 1
    return [letters[b] for b in range(256)]


class Merger(dict):
    """Number of tokens of each piece; a missing one is merged when asked for."""

    def __init__(self, splitter: Splitter):
        super().__init__()
        letters = byte_letters()
        model = splitter.content()["model"]
        vocabulary = model["vocab"]
        self.start = [vocabulary[x] for x in letters]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            self.ranks[vocabulary[left], vocabulary[right]] = rank, vocabulary[left + right]

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        count = self[piece] = self.count(piece)
        return count

    def count(self, piece: str) -> int:
        symbols: list[int] = [self.start[b] for b in piece.encode()]
        n = len(symbols)
        ranks = self.ranks
        heap = []
        for i in range(n - 1):
            found = ranks.get((symbols[i], symbols[i + 1]))
            if found:
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        merges = 0
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            # entries of pairs that are gone stay in the heap: a merged symbol reads -1
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = made, -1
            merges += 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                found = ranks.get((made, symbols[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, made, symbols[k], found[1]))
            h = before[i]
            if h >= 0:
                found = ranks.get((symbols[h], made))
                if found:
                    heapq.heappush(heap, (found[0], h, symbols[h], made, found[1]))
        return n - merges


def _merger(path: str) -> tuple[Splitter, Merger]:
    splitter = Splitter(path)
    return splitter, Merger(splitter)


def count_tokens(text: str, path: str) -> int:
    splitter, merger = held(f"merger of {path}", lambda: _merger(path))
    count = merger.__getitem__
    return sum(1 if special is not None else sum(map(count, splitter.pieces(part))) for part, special in splitter.parts(text))


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than `limit`) of every document.

    `path`: the tokenizer's file, which every executor reads at that place. A null text counts as empty (0 and 0), a null
    id stays null, repeated rows are counted each. Other columns are not read. Nothing is shuffled.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            n = [count_tokens(x.as_py(), path) for x in column]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
