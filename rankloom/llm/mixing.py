"""Mixing sources to target weights by systematic sampling (native DataFrame code).

Each source gets a target number of words.  Every document of the source is
expected ``target / source_size`` times.  Documents are laid out in a fixed
order, their expected copies are prefix-summed within the source, one random
offset per source is added, and a document is emitted once for each integer
boundary that its interval crosses.

The order is by size class, then by a hash of id and text: neighbouring documents
have nearly the same size, so every size class is taken at the same rate and
the words taken come out near the target, not just the number of documents.

A source may hold most of all rows, so no window is over a whole source.  The
prefix sum has three levels: ranks inside a (source, size class, hash prefix)
cell, the cells' counts inside a size class, the classes' counts inside a
source.  Only the first level sees documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stage, word_count

#: Steps of the offset; coarse enough that adding it to a whole number below 2**35 is exact.
OFFSET_STEPS = 65536

#: Columns that ``mix`` makes; no column that it keeps may be named so.
MADE = "doc_id source size said skey class hash cell rank base rate offset crossed source_size target copies".split()


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(skey, source, source_size) -> the same with ``target``.

    Sources by code point (null last) weigh ``weights``, repeating.  They share
    ``share`` times all words; no target is above ``cap`` times its source, and
    the excess is shared again by weight.  The end of that resharing is a common
    level: target = min(cap * size, weight * level).  It is found in one pass over
    the sources by rising ``cap * size / weight``: the first source whose share of
    what is left fits under its cap fixes the level.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rising = Window.orderBy("ratio", "place")
    everything = Window.partitionBy()
    level = F.min_by("share_left", F.when(~F.col("capped"), F.col("row"))).over(everything)
    return (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("row", F.row_number().over(rising))
        .withColumn("left", F.sum("source_size").over(everything) * F.lit(float(share)) - (F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most")))
        .withColumn("weight_left", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("share_left", F.col("left") / F.col("weight_left"))
        .withColumn("capped", F.col("share_left") >= F.col("ratio"))
        .withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * level)))
        .select("skey", "source", "source_size", "target")
    )


def mix(documents: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix", hash_digits: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """Copies of every document in the mix.

    Returns one row per input row: doc_id, size (words), source_size, target
    (words, of its source) and copies (0 or more; never above ``cap`` rounded up).
    ``seed`` fixes the random offsets; reruns and other partitionings agree.
    ``hash_digits`` hexadecimal digits of the hash split each size class, so rows without
    an id are spread like any others.
    ``keep`` columns follow, as they are; they break ties and must not be named like
    one of ``MADE``.

    Null or empty text: size 0; such rows are laid out like any other and take no
    words.  Null source: a source of its own.  Null or repeated ids: allowed, rows
    that are equal in id, source and size are interchangeable.  No rows: no rows.
    Columns other than ``keep`` are ignored, whatever their names.
    """
    doc_key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sized = stage(
        documents.select("doc_id", "source", word_count("text").alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("said"), *keep).select(
            "doc_id",
            "source",
            *keep,
            F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey"),
            "size",
            size_class("size").alias("class"),
            F.md5(F.concat(doc_key, F.lit("/"), "said").cast("binary")).alias("hash"),
        ).withColumn("cell", F.substring("hash", 1, hash_digits)),
        "mix-sizes",
    )
    totals = sized.groupBy("skey").agg(F.first("source", ignorenulls=True).alias("source"), F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, cap)

    cells = sized.groupBy("skey", "class", "cell").agg(F.count(F.lit(1)).alias("n"))
    in_class = Window.partitionBy("skey", "class").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    in_source = Window.partitionBy("skey").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = cells.groupBy("skey", "class").agg(F.sum("n").alias("n")).select("skey", "class", F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("class_base"))
    bases = cells.withColumn("cell_base", F.coalesce(F.sum("n").over(in_class), F.lit(0))).join(classes, ["skey", "class"]).select("skey", "class", "cell", (F.col("class_base") + F.col("cell_base")).alias("base"))

    in_cell = Window.partitionBy("skey", "class", "cell").orderBy("hash", F.col("doc_id").asc_nulls_first(), "size", *keep)
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.col("skey")).cast("binary")), 1, 4), 16, 10).cast("double") + 0.5) / OFFSET_STEPS
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ranked = sized.withColumn("rank", F.row_number().over(in_cell)).join(bases, ["skey", "class", "cell"]).withColumn("rank", F.col("base") + F.col("rank"))
    return (
        ranked.join(targets.drop("source"), "skey")
        .withColumn("rate", rate)
        .withColumn("offset", offset)
        .withColumn("crossed", F.floor(F.col("rate") * F.col("rank") + F.col("offset")) - F.floor(F.col("rate") * (F.col("rank") - 1) + F.col("offset")))
        .select("doc_id", "size", "source_size", "target", F.least(F.col("crossed"), F.ceil("rate")).cast("int").alias("copies"), *keep)
    )


def size_class(size: str):
    """A string that rises with the size: its number of binary digits, then its three digits after the first."""
    bits = F.bin(F.col(size))
    return F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 2, 3))


def apply_mix(documents: DataFrame, **how) -> DataFrame:
    """``documents`` with every row as often as ``mix`` takes it; ``how`` are arguments of ``mix``.

    Rows are told apart by a number of their own, fixed by staging, so null and
    repeated ids are rows like any other.
    """
    row = fresh("row", [*documents.columns, *MADE])
    rows = stage(documents.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    taken = mix(rows, keep=(row,), **how).where("copies > 0").select(row, F.col("copies").alias(fresh("n", [*documents.columns, row])))
    times = taken.columns[1]
    return rows.join(taken, row).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*documents.columns)
