"""Sharding by bytes: global prefix sums, cut at equal targets (native DataFrame code).

Documents are laid out in the order of their ids.  A range partitioning puts
that order into partitions; each partition's total bytes and rows are summed,
the few totals are prefix-summed, and a window inside each partition completes
the global position of every document in bytes and in rows.  The byte axis is
cut at equal targets, so shards are contiguous in the order and their sizes
differ by about one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage


def shard_by_bytes(documents: DataFrame, *, shards: int = 40, overhead: int = 16, partitions: int | None = None) -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes plus ``overhead``), text_crc32, shard, slot.

    A document is in the shard in which its middle byte falls; slot counts from 0
    without gaps in each shard, in the order of (doc_id, text_crc32, size).  The
    result depends on the rows alone, not on their partitioning.

    Null text: size ``overhead``, crc 0, like an empty text.  Null ids come first.
    Repeated rows keep a slot each; equal rows are interchangeable, and a tie number
    fixed when the rows are staged spreads even a hot id over several partitions.
    A document larger than a shard's target may leave a shard empty.  No rows: no
    rows.  Other columns are ignored, whatever their names.
    """
    n = partitions or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = stage(
        documents.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + overhead).alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("tie"),
        ),
        "shard-sizes",
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size"), F.col("tie")]
    # Staged: the sampled range bounds are drawn once, so totals and windows see the same partitions.
    ranged = stage(sized.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "shard-ranges")

    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
        .select(
            "part",
            F.coalesce(F.sum("part_bytes").over(earlier), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("rows_before"),
            F.sum("part_bytes").over(Window.partitionBy()).alias("all_bytes"),
        )
    )
    inside = Window.partitionBy("part").orderBy(*order)
    begin = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = stage(
        ranged.join(F.broadcast(totals), "part")  # one row per range partition
        .withColumn("begin", begin)
        .withColumn("place", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(f"least({shards - 1}, (2 * begin + size) * {shards} div (2 * all_bytes))").cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "place"),
        "shard-places",
    )
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first_place"))
    return placed.join(F.broadcast(firsts), "shard").select(  # one row per shard
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first_place")).cast("long").alias("slot")
    )
