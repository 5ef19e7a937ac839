"""Contiguous shards of near equal bytes, cut from global prefix sums."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .ordering import dealt_in_order, with_positions


def shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", together: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    Documents are taken in the order of doc_id (nulls first), then text_crc32, size and place in the input; with `together`
    first by the MD5 of the text, so that copies are neighbours and at most n_shards - 1 groups of them are cut. A document
    belongs to the shard in whose share of all bytes its middle lies, so shards are contiguous in that order and differ
    from the equal share by less than one document. Its size is the UTF-8 bytes of the text plus 1 (a null text has
    none, and a checksum of 0). `slot` counts from 0 within the shard. The law is `bytes`: grown_shard is null. Repeated rows have slots of their own; an empty
    table gives no row; more shards than documents leave some empty. Text itself is not shuffled, and a group of copies of any size is dealt by the rest of the order.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
        *([F.md5(text.cast("binary")).alias("digest")] if together else []),
    )
    order = [F.col(c) for c in ("doc_id", "text_crc32", "size", "place")]
    if together:
        order = [F.col("digest"), *order]
    placed = with_positions(dealt_in_order(rows, order, "shard-order"), order, F.col("size"))
    # in whole numbers: the doubled middle of the document against the doubled total
    middle = F.expr(f"cast(least({n_shards - 1}, ((2 * start + size) * {n_shards}) div (2 * total)) as int)")
    placed = written(placed.withColumn("shard", middle), "shards")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    # at most n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
