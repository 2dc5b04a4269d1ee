"""Contiguous shards of nearly equal size, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import global_prefix, n_bytes, whole


def assign_shards(docs: DataFrame, n_shards: int, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the documents, in the order of their ids, into n_shards contiguous runs of nearly equal bytes.

    Only ids, sizes and checksums are moved: they are range-partitioned by id, each partition is summed on its own, and
    the partitions' totals give the global prefix sums. A document belongs to the shard in whose equal share of the
    total its middle byte lies; a shard is thus off its share by less than one document.

    Null texts count as empty, null ids come first, rows of one id follow each other by checksum (equal rows in any
    order), extra columns are left out, and an empty table gives no rows. With fewer documents than shards some
    numbers stay unused.
    """
    text = whole(text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), (n_bytes(text) + overhead).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    placed, _, total = global_prefix(slim, [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")], "size")
    middle = 2 * F.col("before") + F.col("size")
    shard = F.least(F.lit(n_shards - 1), F.expr(f"({n_shards} * (2 * before + size)) div {2 * max(total, 1)}")) if total else F.lit(0) * middle
    cut = placed.withColumn("shard", shard.cast("int"))
    first = cut.groupBy("shard").agg(F.min("position").alias("first"))
    return cut.join(F.broadcast(first), "shard").select(  # at most n_shards rows
        "doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot"), "before"
    )
