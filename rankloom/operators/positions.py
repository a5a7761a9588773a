"""Positions within groups of any size: ranges of the order are numbered apart and put end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage


def numbered(rows: DataFrame, group: str, order: str, partitions: int | None = None) -> DataFrame:
    """Adds ``position`` (from 1, by rising ``order``, nulls first; equal rows in any order) and ``of``, the size of the group.

    A range partitioning by group and order puts a large group into several partitions, whose
    counts are prefix-summed; windows stay within one partition.  It is written once, since the
    sampled bounds of ranges must not change between the two uses.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = stage(stage(tied, "positions-rows").repartitionByRange(n, F.col(group).asc_nulls_first(), F.col(order).asc_nulls_first(), "__tie").withColumn("__part", F.spark_partition_id()), "positions-ranges")
    counts = dealt.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__c"))
    by_group = Window.partitionBy(group)
    bases = counts.select(F.col(group).alias("__group"), "__part", F.coalesce(F.sum("__c").over(by_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"), F.sum("__c").over(by_group).alias("of"))
    inside = Window.partitionBy(group, "__part").orderBy(F.col(order).asc_nulls_first(), "__tie")
    placed = dealt.withColumn("__n", F.row_number().over(inside))
    joined = placed.join(bases.withColumnRenamed("__part", "__p"), F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__p")))
    return joined.select(*rows.columns, (F.col("__base") + F.col("__n")).alias("position"), "of")
