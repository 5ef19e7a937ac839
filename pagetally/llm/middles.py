"""Fill-in-the-middle samples: each byte of a batch is scattered to its place, and gathered from there again.

A text is cut in prefix, middle and suffix; two of three parts trade places around markers. For a whole batch an array of
differences holds, at the byte where a part begins, by how much the shift of that part differs from the part before. Its
cumulative sum is the shift of every byte, and one numpy scatter builds all outputs. Reading back finds the markers,
rebuilds the same shifts from the lengths between them and gathers.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, forget, words

PLAIN, PSM, SPM = 0, 1, 2
NAMES = np.array(["plain", "psm", "spm"])
#: Order of the parts in a psm and an spm output; 0 prefix, 1 middle, 2 suffix.
ORDERS = {PSM: (0, 2, 1), SPM: (2, 0, 1)}


@dataclass(frozen=True)
class Recipe:
    """Seed of the draws, per cent of texts that stay plain from `rate` on, per cent of the others in spm form, markers.

    Markers are of ASCII, and none may overlap with another or with itself, so that each is found again where it was put.
    """

    seed: int = 42
    rate: int = 50
    spm: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.middle, self.suffix)
        for a in marks:
            if not a or not a.isascii():
                raise ValueError("markers are of one ASCII character at least")
            for b in marks:
                if any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)) + (a is not b))) or (a is not b and a in b):
                    raise ValueError("markers must not overlap")

    @property
    def marks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.frombuffer(m.encode(), np.uint8) for m in (self.prefix, self.middle, self.suffix))


def draws(id_col: str, seed: int) -> list[Column]:
    """h1 to h4: the first 32-bit groups of the sha256 of seed and id; a null id is drawn as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def cuts(data: np.ndarray, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its units (a word with the space before it; space at the end), and where prefix and middle end."""
    _, ends, first = words(data, at)
    n_words = np.diff(first)
    # a text that does not end with its last word has a unit of space there
    last = np.where(n_words > 0, ends[np.maximum(first[1:], 1) - 1] if len(ends) else 0, at[:-1])
    n = n_words + (last < at[1:])
    a, b = h1 % (n + 1), h2 % (n + 1)
    # the byte before unit 0 is the text's first, the end of unit k is the end of word k or of the text
    places = np.append(ends, 0)

    def place(count: np.ndarray) -> np.ndarray:
        at_word = places[np.clip(first[:-1] + count - 1, 0, len(ends))]
        return np.where(count == 0, at[:-1], np.where(count <= n_words, at_word, at[1:]))

    return n, place(np.minimum(a, b)), place(np.maximum(a, b))


def found(data: np.ndarray, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Where the mark begins, within one text."""
    n = len(data) - len(mark) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hit = data[:n] == mark[0]
    for i in range(1, len(mark)):
        hit &= data[i:n + i] == mark[i]
    places = np.flatnonzero(hit)
    of = np.searchsorted(at, places, "right") - 1
    return places[places + len(mark) <= at[of + 1]]


def part_places(forms: np.ndarray, lengths: np.ndarray, marks: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where parts and marks (rows: texts, columns: prefix, middle, suffix) begin in the output, and its length."""
    parts, ahead = np.zeros_like(lengths), np.zeros_like(lengths)
    parts[:, 1], parts[:, 2] = lengths[:, 0], lengths[:, 0] + lengths[:, 1]
    total = lengths.sum(1)
    for form, order in ORDERS.items():
        rows = np.flatnonzero(forms == form)
        place = np.zeros(len(rows), np.int64)
        for part in order:
            ahead[rows, part] = place
            place = place + len(marks[part])
            parts[rows, part] = place
            place = place + lengths[rows, part]
        total[rows] = place
    return parts, ahead, total


def shifts(n: int, begins: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The shift of each of n bytes: `by` from `begins` on, rows in order; of parts that begin together the last counts."""
    steps = np.zeros(n + 1, np.int64)
    begins, by = begins.ravel(), by.ravel()
    np.add.at(steps, begins, np.diff(by, prepend=0))
    return np.cumsum(steps[:-1])


def scattered(data: np.ndarray, at: np.ndarray, forms: np.ndarray, one: np.ndarray, two: np.ndarray, recipe: Recipe) -> tuple[np.ndarray, np.ndarray]:
    """The outputs of all texts and where each begins."""
    marks = recipe.marks
    begins = np.stack([at[:-1], one, two], 1)
    lengths = np.diff(np.concatenate([begins, at[1:, None]], 1), axis=1)
    parts, ahead, total = part_places(forms, lengths, marks)
    out_at = np.concatenate(([0], np.cumsum(total)))
    out = np.empty(out_at[-1], np.uint8)
    out[np.arange(len(data)) + shifts(len(data), begins, out_at[:-1, None] + parts - begins)] = data
    marked = np.flatnonzero(forms != PLAIN)
    for part, mark in enumerate(marks):
        place = out_at[marked] + ahead[marked, part]
        out[place[:, None] + np.arange(len(mark))] = mark
    return out, out_at


def gathered(data: np.ndarray, at: np.ndarray, forms: np.ndarray, recipe: Recipe) -> tuple[np.ndarray, np.ndarray]:
    """The texts that the outputs were made of and where each begins, from outputs and forms alone."""
    marks = recipe.marks
    marked = np.flatnonzero(forms != PLAIN)
    where = np.zeros((len(forms), 3), np.int64)
    for part, mark in enumerate(marks):
        places = found(data, at, mark)
        of = np.searchsorted(at, places, "right") - 1
        places, of = places[forms[of] != PLAIN], of[forms[of] != PLAIN]
        if not np.array_equal(of, marked):
            raise ValueError("an output that is not plain needs each marker once")
        where[of, part] = places
    lengths = np.zeros((len(forms), 3), np.int64)
    lengths[:, 0] = np.diff(at)
    sources = np.zeros((len(forms), 3), np.int64)
    sources[:, 0] = at[:-1]
    for form, order in ORDERS.items():
        rows = np.flatnonzero(forms == form)
        for i, part in enumerate(order):
            until = where[rows, order[i + 1]] if i < 2 else at[rows + 1]
            sources[rows, part] = where[rows, part] + len(marks[part])
            lengths[rows, part] = until - sources[rows, part]
    back_at = np.concatenate(([0], np.cumsum(lengths.sum(1))))
    begins = back_at[:-1, None] + np.concatenate([np.zeros((len(forms), 1), np.int64), np.cumsum(lengths, 1)[:, :2]], 1)
    plain = forms == PLAIN
    sources[plain, 1:] = sources[plain, :1] + (begins - begins[:, :1])[plain, 1:]
    n = int(back_at[-1])
    return data[np.arange(n) + shifts(n, begins, sources - begins)], back_at


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def fill_in_middle(docs: DataFrame, recipe: Recipe = Recipe(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document.

    A text is cut between units: a word `[^\\x20\\x09-\\x0D]+` with the white space before it, or white space at the end.
    Of n units, the prefix holds as many as the smaller of h1 % (n + 1) and h2 % (n + 1), prefix and middle as many as the
    larger; see `draws`. A text that is empty, holds a marker, or has h3 % 100 >= rate is plain: its output is the text,
    its lengths are null. With h4 % 100 < spm the others are spm (suffix, prefix, middle), else psm (prefix, suffix,
    middle), each part after its marker. A null text counts as empty; a null id stays null and is drawn as an empty one.
    Repeated rows and equal ids give equal draws. Other columns, of any name, are not read; an empty table gives no row.
    Nothing is shuffled; a task holds some arrays of 8 bytes for each byte of 256 KB of text, or of one longer text.
    """

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            draw = [batch.column(2 + i).to_numpy() for i in range(4)]
            for first, last, data, at in chunks(batch.column(1)):
                h1, h2, h3, h4 = (h[first:last] for h in draw)
                n, one, two = cuts(data, at, h1, h2)
                forms = np.where(h4 % 100 < recipe.spm, SPM, PSM)
                forms[(np.diff(at) == 0) | (h3 % 100 >= recipe.rate)] = PLAIN
                for mark in recipe.marks:
                    forms[np.searchsorted(at, found(data, at, mark), "right") - 1] = PLAIN
                plain = forms == PLAIN
                # code points: bytes that continue none
                points = np.concatenate(([0], np.cumsum(data & 0xC0 != 0x80)))
                chars = [points[one] - points[at[:-1]], points[two] - points[one]]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, last - first), pa.array(n, pa.int64()), pa.array(NAMES[forms]),
                    *[pa.array(c, pa.int64(), mask=plain) for c in chars], _strings(*scattered(data, at, forms, one, two, recipe)),
                ], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(id_col, recipe.seed))])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scatter, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(samples: DataFrame, recipe: Recipe = Recipe(), form_col: str = "form", output_col: str = "output", name: str = "restored") -> DataFrame:
    """The rows, all columns, and the text that each was made of, from its output and form alone.

    A null output gives an empty text. An output that is said not to be plain but lacks a marker is refused.
    """
    form, output = samples.columns.index(form_col), samples.columns.index(output_col)
    schema = samples.drop(name).schema.add(name, "string")
    kept = [i for i, c in enumerate(samples.columns) if c != name]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            names = batch.column(form).to_numpy(zero_copy_only=False)
            for first, last, data, at in chunks(batch.column(output).fill_null("")):
                forms = np.select([names[first:last] == "psm", names[first:last] == "spm"], [PSM, SPM], PLAIN)
                text = _strings(*gathered(data, at, forms, recipe))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(first, last - first) for i in kept], text], schema.names)

    return samples.mapInArrow(gather, schema)
