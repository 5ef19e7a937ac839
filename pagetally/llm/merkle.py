"""Fingerprints of documents as hash trees: text, sections, paragraphs, units of words.

A section ends at an empty line (two line feeds), a paragraph at a line feed, and a unit is up to eight words of a
paragraph, or 64 code points of one long word, with the white space around them, so the units of a text are the text. The hash of a node is the SHA-256 of
its children's hashes; roots are equal when texts are, and comparing branches finds where texts differ.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts
from .ordering import dealt_in_order, with_positions

#: Up to eight words of at most 32 code points with the white space around them; or up to 64 code points of a longer word (Chinese,
#: Japanese, encoded data); or white space alone.
UNIT = r"\s*(?:\S{1,32}+(?!\S)\s*){1,8}|\s*\S{1,64}\s*|\s+"


def _hash(children: Column) -> Column:
    return F.sha2(F.concat_ws("", children), 256)


def _paragraph(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.sha2(u, 256))


def sections(text: Column) -> Column:
    """The tree below the root: array of (hash, paragraphs: array of (hash, units: array of hashes)).

    Each level is bound by a lambda of its own, so that no hash is computed twice.
    """
    units = F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), _paragraph))
    paragraphs = F.transform(units, lambda s: F.transform(s, lambda p: F.struct(_hash(p).alias("hash"), p.alias("units"))))
    return F.transform(paragraphs, lambda s: F.struct(_hash(F.transform(s, lambda p: p["hash"])).alias("hash"), s.alias("paragraphs")))


def fingerprint(tree: Column) -> Column:
    """The tree as a string: root, '/', sections by ';', '/', units by ','.

    A section reads `hash:paragraph,paragraph`, a paragraph `hash*number of units`. The root is whole; sections and
    paragraphs keep 16 hexadecimal digits and units 8, enough to compare two documents.
    """
    root = F.sha2(F.concat_ws("", F.transform(tree, lambda s: s["hash"])), 256)
    branches = F.transform(tree, lambda s: F.concat(
        F.substring(s["hash"], 1, 16), F.lit(":"),
        F.concat_ws(",", F.transform(s["paragraphs"], lambda p: F.concat(F.substring(p["hash"], 1, 16), F.lit("*"), F.size(p["units"]).cast("string")))),
    ))
    units = F.flatten(F.transform(tree, lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: p["units"]))))
    return F.concat(root, F.lit("/"), F.concat_ws(";", branches), F.lit("/"), F.concat_ws(",", F.transform(units, lambda u: F.substring(u, 1, 8))))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: 1 for equal roots, else twice the units in common by the units of both (different units count)."""
    ours, theirs = (F.array_distinct(F.split(F.element_at(F.split(x, "/", 3), 3), ",")) for x in (a, b))
    common = F.size(F.array_intersect(ours, theirs))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0)).otherwise(2.0 * common / (F.size(ours) + F.size(theirs)))


def differing(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: array of (section, paragraph), from 0; branches with equal hashes are not entered.

    Sections and paragraphs are compared by their number; one that only the other has is listed as well.
    """
    ours, theirs = (F.split(F.element_at(F.split(x, "/", 3), 2), ";") for x in (a, b))

    def within(s: Column, i: Column) -> Column:
        mine, other = s["x"], s["y"]
        left, right = (F.split(F.substring_index(F.coalesce(x, F.lit("")), ":", -1), ",") for x in (mine, other))
        pairs = F.arrays_zip(left.alias("x"), right.alias("y"))
        marked = F.transform(pairs, lambda p, j: F.when(~p["x"].eqNullSafe(p["y"]), F.struct(i.alias("section"), j.alias("paragraph"))))
        return F.when(mine.eqNullSafe(other), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(F.filter(marked, lambda m: m.isNotNull()))

    return F.flatten(F.transform(F.arrays_zip(ours.alias("x"), theirs.alias("y")), within))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars (code points) and fingerprint of every document, in one pass without a shuffle. A null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
        .withColumn("tree", sections(F.col("text")))
        .select("doc_id", F.char_length("text").cast("long").alias("n_chars"), fingerprint(F.col("tree")).alias("fingerprint"))
    )


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and against the next document, by their fingerprints.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document in descending order of doc_id; after the last comes the first. A null id comes last. Rows of one doc_id
    with different texts follow each other by the hash of the text; repeated rows (same id, same text) are one document
    and each gets its result. A single document is its own next one. Columns of other names are not read.

    The order is settled on ids alone. Texts are shuffled once, by id; what a document passes on (the part that is
    needed, and its fingerprint) once more.
    """
    rows = texts(docs, id_col, text_col)
    ids = rows.select("doc_id", "key", F.char_length("text").alias("n")).dropDuplicates(["doc_id", "key"])
    order = [F.col("doc_id").desc_nulls_last(), F.col("key").desc()]
    placed = with_positions(dealt_in_order(ids, order, "document-order"), order)
    # the document before takes from this one
    takers = placed.select(
        (F.col("row") % F.col("rows") + 1).alias("row"), F.col("doc_id").alias("taker_id"), F.col("key").alias("taker_key"), F.expr("n div 3").alias("taken"),
    )
    passed_to = placed.select("row", F.col("doc_id").alias("giver_id"), F.col("key").alias("giver_key")).join(takers, "row").drop("row")

    # both joins deal the same columns of the texts out by the same keys, so Spark does it once; a null id is a key, too
    zero = F.lit(0).cast(rows.schema["doc_id"].dataType)
    ours = F.coalesce("doc_id", zero), F.col("doc_id").isNull()
    passed_to = passed_to.select(
        F.coalesce("giver_id", zero).alias("giver"), F.col("giver_id").isNull().alias("giver_null"), "giver_key",
        F.coalesce("taker_id", zero).alias("taker"), F.col("taker_id").isNull().alias("taker_null"), "taker_key", "taken",
    )
    given = (
        rows.join(passed_to.hint("shuffle_hash"), (ours[0] == F.col("giver")) & (ours[1] == F.col("giver_null")) & (F.col("key") == F.col("giver_key")))
        .withColumn("tree", sections(F.col("text")))
        .select("taker", "taker_null", "taker_key", F.expr("substring(text, 1, taken)").alias("piece"), fingerprint(F.col("tree")).alias("next_fingerprint"))
        # repeated rows give the same twice
        .dropDuplicates(["taker", "taker_null", "taker_key"])
    )
    both = (
        rows.join(given, (ours[0] == F.col("taker")) & (ours[1] == F.col("taker_null")) & (F.col("key") == F.col("taker_key")))
        .withColumn("n_chars", F.char_length("text"))
        .withColumn("edited", F.concat(F.expr("substring(text, 1, n_chars - n_chars div 3)"), F.col("piece")))
        .withColumn("tree", sections(F.col("text"))).withColumn("edited_tree", sections(F.col("edited")))
        .select(
            "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
            fingerprint(F.col("tree")).alias("fingerprint"), fingerprint(F.col("edited_tree")).alias("edited_fingerprint"), "next_fingerprint",
        )
    )
    return both.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        differing(F.col("fingerprint"), F.col("edited_fingerprint")).alias("edited_paragraphs"),
    )
