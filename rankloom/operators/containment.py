"""Which strings hold which others, by an equi-join on short runs of characters instead of comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 3


def _runs(text: Column) -> Column:
    """All distinct runs of 1 to LONGEST characters."""
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>")))))


def held_in(holders: DataFrame, needles: DataFrame, longest: int | None = None) -> DataFrame:
    """(holder), (needle) -> the pairs in which the holder contains the needle.

    The needle's beginning must be among the holder's runs, which is an equi-join;
    containment itself is checked after it.  Null and empty needles are in nothing.
    Beginnings have LONGEST characters, so needles that begin alike all meet the same holders; with
    ``longest`` they have so many, and a holder's runs are of the lengths that occur: good for short
    holders, where a needle is a run itself.
    """
    wanted = needles.select("needle").where(F.length("needle") > 0).distinct().withColumn("run", F.substring("needle", 1, longest or LONGEST))
    held = holders.select("holder").where(F.length("holder") > 0).distinct()
    if longest:
        sizes = wanted.select(F.length("run").alias("n")).distinct()  # ``longest`` rows at most
        at = lambda i: F.substring(F.col("holder"), i, F.col("n"))
        sized = held.join(F.broadcast(sizes), F.length("holder") >= F.col("n"))
        runs = sized.select("holder", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("holder") - F.col("n") + 1), at))).alias("run"))
    else:
        runs = held.select("holder", F.explode(_runs(F.col("holder"))).alias("run"))
        runs = runs.join(wanted.select("run").distinct(), "run", "left_semi")
    return runs.join(wanted, "run").where(F.contains("holder", "needle")).select("holder", "needle")


def either_way(a: DataFrame, b: DataFrame, longest: int | None = None) -> DataFrame:
    """(a), (b) -> the distinct pairs in which one contains the other; ``longest`` as in :func:`held_in`."""
    one = held_in(a.select(F.col("a").alias("holder")), b.select(F.col("b").alias("needle")), longest).select(F.col("holder").alias("a"), F.col("needle").alias("b"))
    other = held_in(b.select(F.col("b").alias("holder")), a.select(F.col("a").alias("needle")), longest).select(F.col("needle").alias("a"), F.col("holder").alias("b"))
    return one.unionByName(other).distinct()
