"""The running tally of an append-only log, as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_log(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_tally(log: DataFrame, target: str, unique: str | None = None) -> DataFrame:
    """Count, first and latest sighting of each target, updated as rows arrive; the state holds one row per target.

    ``unique`` names the rows: one that comes again is not counted again, for which the state
    holds the names seen.
    """
    once = log.dropDuplicates([unique]) if unique else log
    return once.groupBy(target).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def with_shares(tally: DataFrame) -> DataFrame:
    """A finished tally with each target's share of all in percent."""
    total = tally.agg(F.sum("n").alias("__total"))  # one row
    return tally.join(F.broadcast(total)).withColumn("percent", F.round(100 * F.col("n") / F.col("__total"), 2)).drop("__total")


def windowed_tally(log: DataFrame, target: str, late: str = "1 day", window: str = "7 days") -> DataFrame:
    """Counts per event-time window; rows later than ``late`` are left out and closed windows leave the state."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), target).agg(F.count(F.lit(1)).alias("n"))


def drain(tally: DataFrame, folder: str, keys: list[str], name: str | None = None) -> DataFrame:
    """Run a tally over everything there is and return its final rows.

    Every batch's changed rows are written under its number, so a repeated batch
    replaces itself; the latest batch of each key counts.  A tally with a ``name`` goes on
    from its checkpoint: the next call reads only what has arrived since.
    """
    spark = tally.sparkSession
    out = f"{folder}/tally-{name or uuid.uuid4().hex}"

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")

    query = tally.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{out}/state").foreachBatch(save).start()
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*tally.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{out}/rows")
    values = [c for c in tally.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")
