"""Exact deduplication: sorted runs of digests, merged in binomial rounds.

Every partition of the input makes a sorted run of its texts' digests, one entry for
each digest: how many rows have it, and which of them stays.  In each round the runs of
``fan_in`` neighbouring partitions are merged into one, entry by entry, so an entry of
a round has at most ``fan_in`` predecessors, even of a text that a third of all rows
hold; after the last round there is one run.  No run is ever in one place: each is dealt
out by its digests, so a round is one shuffle of (owner of the run, digest) and a merge
of sorted entries in every task.  Texts stay where they are read.

An entry is verified at every level: it stands for rows whose SHA-256, length and a second
hash of the text agree, and entries that differ in any of them are never merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage

#: What makes two texts the same.
DIGEST = ["sha", "bytes", "check"]


def _row(largest: bool) -> tuple[Column, object]:
    """The order in which rows stay, and the aggregate that finds the first: an id before none, then the id, then the row."""
    known = F.col("doc_id").isNotNull()
    return F.struct((known if largest else ~known).alias("known"), F.col("doc_id").alias("id"), F.col("row").alias("row")), F.max if largest else F.min


def merge_runs(runs: DataFrame, width: int, *, largest: bool = False, fan_in: int = 16) -> DataFrame:
    """One run of ``width`` runs: (node, digest, best, n) -> (digest, best, n); rounds that each merge ``fan_in`` runs."""
    pick = F.max if largest else F.min
    while width > 1:
        runs = runs.withColumn("node", F.floor(F.col("node") / fan_in).cast("int")).groupBy("node", *DIGEST).agg(pick("best").alias("best"), F.sum("n").alias("n"))
        width = -(-width // fan_in)
    return runs.drop("node")


def mark_copies(documents: DataFrame, *, largest: bool = False, fan_in: int = 16, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``documents``: doc_id, keep_id, group_size, kept, text_sha256, and the ``keep`` columns.

    Rows with equal texts are a group; the row with the least doc_id stays (the
    ``largest``, if asked for), and keep_id is its id.  Exactly one row of a group is kept:
    rows without an id only if no row has one, and of rows with the same id one, by
    the order in which the input was read.

    Null text: equal to the empty text.  Texts of every length are hashed whole.  No rows:
    no rows.  Other columns are ignored, whatever their names; ``keep`` columns must not
    be named like the others here.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = text.cast("binary")
    # Written once: the rows' numbers and partitions must not change between the uses.
    rows = stage(
        documents.select(
            "doc_id", F.unhex(F.sha2(raw, 256)).alias("sha"), F.octet_length(text).cast("long").alias("bytes"), F.xxhash64(raw).alias("check"),
            F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part"), *keep,
        ),
        "dedup-digests",
    )
    order, pick = _row(largest)
    own = rows.groupBy("part", *DIGEST).agg(pick(order).alias("best"), F.count(F.lit(1)).alias("n"))
    width = (rows.agg(F.max("part").alias("last")).first()["last"] or 0) + 1
    merged = merge_runs(own.withColumnRenamed("part", "node"), width, largest=largest, fan_in=fan_in).where("n > 1")
    # Down again: first to the entries of the partitions, at most one for each text and partition, then to their rows.
    told = own.select("part", *DIGEST).join(merged, DIGEST)
    both = rows.join(told, ["part", *DIGEST], "left")
    alone = F.col("n").isNull()
    return both.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *keep,
    )


def drop_copies(documents: DataFrame, **how) -> DataFrame:
    """``documents`` without all but one row of each text; ``how`` are arguments of ``mark_copies``.

    Rows are told apart by a number of their own, fixed by staging, so null and
    repeated ids are rows like any other, and all columns come out as they were.
    """
    number = fresh("number", [*documents.columns, "doc_id", "keep_id", "group_size", "kept", "text_sha256", *DIGEST, "row", "part", "best", "n"])
    rows = stage(documents.withColumn(number, F.monotonically_increasing_id()), "dedup-rows")
    kept = mark_copies(rows, keep=(number,), **how).where("kept").select(number)
    return rows.join(kept, number, "left_semi").select(*documents.columns)
