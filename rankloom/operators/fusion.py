"""Combining ranked lists: reciprocal ranks, unions, pools, back-filled and tiered reranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .bm25 import ranked

PAIR = ["query_id", "doc_id"]
TIERS = {"excellent": 0, "good": 1, "ill-fit": 2}


def reciprocal_rank(a: DataFrame, b: DataFrame, absent: int = 51, top: int = 12) -> DataFrame:
    """1/r1 + 1/r2 with a fixed rank where a list lacks the document."""
    both = a.select(*PAIR, F.col("rank").alias("r1")).join(b.select(*PAIR, F.col("rank").alias("r2")), PAIR, "full")
    score = F.round(1 / F.coalesce("r1", F.lit(absent)) + 1 / F.coalesce("r2", F.lit(absent)), 6)
    return ranked(both.select(*PAIR, score.alias("score")), top)


def two_query_union(patient: DataFrame, intent: DataFrame, n_patient: int = 50, n_intent: int = 30, most: int = 100) -> DataFrame:
    """The top of two rankings: by the first score (-1 where absent), then by the second."""
    a = patient.where(F.col("rank") <= n_patient).select(*PAIR, F.col("score").alias("a"))
    b = intent.where(F.col("rank") <= n_intent).select(*PAIR, F.col("score").alias("b"))
    both = a.join(b, PAIR, "full").withColumn("a", F.coalesce("a", F.lit(-1.0)))
    scored = both.withColumn("score", F.when(F.col("a") >= 0, F.col("a")).otherwise(F.col("b")))
    return ranked(scored, most, [F.desc("a"), F.desc_nulls_last("b"), F.asc("doc_id")]).select(*PAIR, "score", "rank")


def pool(lists: list[tuple[str, DataFrame]], most: int = 50) -> DataFrame:
    """Union of lists (query_id, doc_id, pos) by priority; the first source of a document counts."""
    rows = None
    for i, (source, df) in enumerate(lists):
        part = df.select(*PAIR, F.col("pos").cast("long").alias("pos"), F.lit(i).alias("priority"), F.lit(source).alias("pool_source"))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(*PAIR).orderBy("priority", "pos"))).where("n = 1")
    return ranked(first, most, [F.asc("priority"), F.asc("pos"), F.asc("doc_id")]).select(*PAIR, "pool_source", "rank")


def back_fill(given: DataFrame, base: DataFrame, top: int = 12) -> DataFrame:
    """A given order (query_id, doc_id, pos) without unknown or repeated ids, filled up in the base order; score 1/rank."""
    valid = given.groupBy(*PAIR).agg(F.min("pos").alias("pos")).join(base.select(*PAIR), PAIR, "left_semi")
    rest = base.join(valid.select(*PAIR), PAIR, "left_anti").select(*PAIR, F.col("rank").cast("long").alias("pos"), F.lit(1).alias("part"))
    rows = valid.select(*PAIR, F.col("pos").cast("long").alias("pos"), F.lit(0).alias("part")).unionByName(rest)
    out = ranked(rows, top, [F.asc("part"), F.asc("pos"), F.asc("doc_id")])
    return out.select(*PAIR, "rank", F.round(1 / F.col("rank"), 6).alias("score"))


def with_tier(scores: DataFrame, evaluations: DataFrame, default: str = "good") -> DataFrame:
    """Adds tier and its order; documents that were not evaluated get the default."""
    order = F.when(F.col("tier") == "excellent", 0).when(F.col("tier") == "ill-fit", 2).otherwise(1)
    return scores.join(evaluations, "doc_id", "left").withColumn("tier", F.coalesce("tier", F.lit(default))).withColumn("tier_order", order)


def tier_rerank(scores: DataFrame, evaluations: DataFrame, top: int = 12) -> DataFrame:
    return ranked(with_tier(scores, evaluations), top, [F.asc("tier_order"), F.desc("score"), F.asc("doc_id")])


def progressive(scores: DataFrame, evaluations: DataFrame, *, batch: int = 12, rounds: int = 5, most: int = 30, top: int = 12) -> DataFrame:
    """Evaluate in batches by falling score until the top three are all excellent, or the budget is spent.

    As evaluations are a table, round r has seen the first min(r * batch, most)
    documents, so every round's stop condition is a window aggregate and no loop runs:
    a query stops at the first round in which three documents seen are excellent.
    """
    limit = min(batch * rounds, most)
    # Written, since it is read twice and the scores would be made twice.
    seen = with_tier(stage(ranked(scores, limit), "progressive-seen"), evaluations)
    third = seen.where("tier_order = 0").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("n = 3")
    stop = third.select("query_id", F.least(F.ceil(F.col("rank") / batch), F.lit(rounds)).cast("int").alias("rounds_used"))
    full = F.lit(-(-limit // batch))
    kept = seen.join(stop, "query_id", "left").withColumn("rounds_used", F.coalesce("rounds_used", full).cast("int"))
    kept = kept.where(F.col("rank") <= F.col("rounds_used") * batch).drop("rank")
    return ranked(kept, top, [F.asc("tier_order"), F.desc("score"), F.asc("doc_id")])


def draw(candidates: DataFrame, n: int, seed: str = "draw") -> DataFrame:
    """``n`` candidates (query_id, doc_id) of each query in an order that looks random and that any rerun draws again, with ``pos``."""
    key = F.md5(F.concat_ws("/", F.lit(seed), F.col("query_id").cast("string"), F.col("doc_id").cast("string")).cast("binary"))
    order = Window.partitionBy("query_id").orderBy(key, "doc_id")
    return candidates.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n)


def with_tier_by_name(scores: DataFrame, evaluations: DataFrame, default: str = "good") -> DataFrame:
    """Like :func:`with_tier` for evaluations (name, tier) of documents by name, regardless of case; a repeated name: its best tier."""
    order = F.when(F.col("tier") == "excellent", 0).when(F.col("tier") == "ill-fit", 2).otherwise(1)
    by_name = evaluations.groupBy(F.lower(F.trim("name")).alias("__key")).agg(F.min_by("tier", order).alias("tier"))
    joined = scores.join(by_name, F.lower(F.trim("name")) == F.col("__key"), "left").drop("__key")
    return joined.withColumn("tier", F.coalesce("tier", F.lit(default))).withColumn("tier_order", order)
