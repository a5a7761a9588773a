"""Exact order statistics of large groups: a mergeable sketch finds where they lie, a second pass looks only there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

#: The sketch's ranks are off by at most the group's size over this.
ACCURACY = 10_000


def order_statistics(rows: DataFrame, wanted: DataFrame, sizes: DataFrame, accuracy: int = ACCURACY) -> DataFrame:
    """(grp, value), (grp, name, at) -> (grp, name, x): the value at each place ``at``, from 0 in rising order.

    sizes: (grp, n), n values that are not null.  Quantile sketches are partial aggregates; they
    give a value below and one above each place, which enclose at most 6 of every
    ``accuracy`` rows besides ties.  The second pass counts what lies below and orders only
    distinct values in between, with their counts.
    """
    asked = wanted.join(sizes, "grp").where((F.col("at") >= 0) & (F.col("at") < F.col("n")))
    share = lambda by: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("at") + by) / F.col("n") + by * 2.0 / accuracy))
    ends = asked.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("name", "at", share(-1).alias("p"), share(1).alias("q")))).alias("w"))
    # Sketches of all groups at once; their quantiles are taken afterwards, at places of each group's own.
    grid = [i / accuracy for i in range(0, accuracy + 1, max(1, accuracy // 1000))]
    sketch = rows.where("value is not null").groupBy("grp").agg(F.percentile_approx("value", grid, accuracy).alias("g"), F.min("value").alias("least"), F.max("value").alias("most"))
    step = F.lit(float(len(grid) - 1))
    low = lambda p: F.when(p * step < 1, F.col("least")).otherwise(F.get("g", (F.floor(p * step) - 1).cast("int")))
    high = lambda q: F.when(q * step > step - 1, F.col("most")).otherwise(F.get("g", (F.ceil(q * step) + 1).cast("int")))
    marks = ends.join(sketch, "grp").select("grp", "least", "most", "g", F.explode("w").alias("x")).select("grp", "x.name", "x.at", low(F.col("x.p")).alias("lo"), high(F.col("x.q")).alias("hi"))
    marks = stage(marks, "quantile-marks")  # one row for each figure wanted
    met = rows.where("value is not null").join(marks, "grp")
    below = met.groupBy("grp", "name").agg(F.count_if(F.col("value") < F.col("lo")).alias("below"))
    between = met.where(F.col("value").between(F.col("lo"), F.col("hi"))).groupBy("grp", "name", "at", "value").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("grp", "name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = between.withColumn("upto", F.sum("c").over(upto)).join(below, ["grp", "name"])
    here = (F.col("below") + F.col("upto") > F.col("at")) & (F.col("below") + F.col("upto") - F.col("c") <= F.col("at"))
    return placed.where(here).select("grp", "name", F.col("value").alias("x"))


def study_statistics(rows: DataFrame, part: float = 0.25) -> DataFrame:
    """(grp, value) -> grp, n, mean, sd (of a sample), median (between the middle two), top and bottom (means of the best and worst ``part``), least, most.

    A row is among the best if at most ``part`` of the other rows are better, so ties at the
    cut all count.  Null values count in n alone.  Nothing is ordered by group: all
    figures are partial aggregates, but for the few values about the median and the cuts.
    """
    known = rows.select("grp", F.col("value").cast("double").alias("value"))
    sizes = stage(known.groupBy("grp").agg(F.count("value").alias("n")), "study-sizes")
    span = F.col("n") - 1
    places = {"low": F.floor(span / 2), "high": F.ceil(span / 2), "top": span - F.floor(part * span), "bottom": F.floor(part * span)}
    wanted = sizes.select("grp", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("long").alias("at")) for k, v in places.items()])).alias("x")).select("grp", "x.*")
    found = order_statistics(known, wanted, sizes).groupBy("grp").agg(*[F.max(F.when(F.col("name") == k, F.col("x"))).alias(f"x_{k}") for k in places])
    joined = known.join(stage(found, "study-cuts"), "grp", "left")
    v = F.col("value")
    return joined.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), ((F.first("x_low") + F.first("x_high")) / 2).alias("median"),
        F.avg(F.when(v >= F.col("x_top"), v)).alias("top"), F.avg(F.when(v <= F.col("x_bottom"), v)).alias("bottom"), F.min(v).alias("least"), F.max(v).alias("most"),
    )
