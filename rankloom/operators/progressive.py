"""Ranking with an evaluator in the loop: batches by falling score, each judged before it is known who needs another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import fresh_path, stage
from .bm25 import ranked
from .providers import ASSUMED, FAILED, Provider, evaluations

#: Takes (query_id, doc_id, rank); gives (query_id, doc_id, tier, reason), not necessarily for all of them.
Evaluator = Callable[[DataFrame], DataFrame]

TOP, ROUNDS, BUDGET, NONE_LEFT = "top-k-excellent", "max-iterations", "max-profiles-reviewed", "no-more-profiles"
_ORDER = {"excellent": 0, "good": 1, "ill-fit": 2}
JUDGED = "query_id long, doc_id long, rank int, tier string, reason string, iteration_found int, evaluated boolean"


def by_provider(provider: Provider, documents: DataFrame, queries: DataFrame) -> Evaluator:
    """An evaluator that hands batches of (query_id, doc_id, query, texts of ``documents``) to a provider and reads its JSON."""

    def evaluate(rows: DataFrame) -> DataFrame:
        asked = rows.select("query_id", "doc_id").join(documents, "doc_id").join(queries.withColumnRenamed("text", "query"), "query_id")
        return evaluations(asked, provider)

    return evaluate


def by_table(given: DataFrame) -> Evaluator:
    """An evaluator that looks answers up in (query_id, doc_id, tier, reason)."""
    return lambda rows: rows.select("query_id", "doc_id").join(given, ["query_id", "doc_id"])


def _read(spark, path: str) -> DataFrame | None:
    """What a round wrote, if it was finished."""
    try:
        return spark.read.schema(spark.read.parquet(path).schema).parquet(path)
    except AnalysisException:
        return None


def progressive(scores: DataFrame, evaluator: Evaluator, *, batch: int = 12, rounds: int = 5, most: int = 30, target: int = 3, top: int = 12, whole_batches: bool = False, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, doc_id, score) -> the ``top`` of every query, and how its search went.

    In each of at most ``rounds`` rounds the next ``batch`` documents of every query that is
    still searched go to the evaluator, ``most`` in all; a query is done when ``target``
    documents seen are excellent, when rounds or budget are spent, or when it has no more
    documents.  What the evaluator does not answer counts as good.  Documents of a last
    batch beyond the budget are left out, or (``whole_batches``) take part unevaluated.

    Every round's answers are written before the next begins, so the evaluator sees a
    query's document once, and a search that is begun again in the same ``path`` goes on
    behind the last round that was finished.

    Results: query_id, doc_id, score, tier, reason, iteration_found, rank.  Searches: query_id,
    stop_reason, rounds_used, reviewed, excellent, good, ill_fit (of the documents seen).
    """
    spark = scores.sparkSession
    path = path or fresh_path(spark, "progressive")
    deepest = batch * rounds if whole_batches else min(batch * rounds, most)
    ranking = _read(spark, f"{path}/ranking")
    if ranking is None:
        ranked(scores).where(F.col("rank") <= deepest).select(F.col("query_id").cast("long").alias("query_id"), F.col("doc_id").cast("long").alias("doc_id"), "score", "rank").write.mode("overwrite").parquet(f"{path}/ranking")
        ranking = _read(spark, f"{path}/ranking")
    sizes = ranking.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    seen = spark.createDataFrame([], JUDGED)
    stops = spark.createDataFrame([], "query_id long, stop_reason string, rounds_used int")
    for r in range(rounds):
        active = sizes.join(stops, "query_id", "left_anti").select("query_id")
        first, last = r * batch, min((r + 1) * batch, deepest)
        fetched = ranking.where((F.col("rank") > first) & (F.col("rank") <= last)).join(active, "query_id", "left_semi").drop("score")
        done = _read(spark, f"{path}/round-{r}")
        if done is None:
            answers = evaluator(fetched.where(F.col("rank") <= most)).dropDuplicates(["query_id", "doc_id"]).select("query_id", "doc_id", "tier", "reason", F.lit(True).alias("evaluated"))
            judged = fetched.join(answers, ["query_id", "doc_id"], "left")
            unanswered = F.when(F.col("rank") <= most, FAILED).otherwise("")
            judged.select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"), F.coalesce("tier", F.lit(ASSUMED)).alias("tier"), F.coalesce("reason", unanswered).alias("reason"), F.lit(r).alias("iteration_found"), (F.col("rank") <= most).alias("evaluated")).write.mode("overwrite").parquet(f"{path}/round-{r}")
            done = _read(spark, f"{path}/round-{r}")
        seen = seen.unionByName(done)
        so_far = seen.groupBy("query_id").agg(F.count_if(F.col("tier") == "excellent").alias("excellent"), F.count_if("evaluated").alias("reviewed"), F.count(F.lit(1)).alias("fetched"), F.max("iteration_found").alias("at"))
        reason = (
            F.when(F.col("excellent") >= target, TOP)
            .when((F.lit(r + 1) >= rounds), ROUNDS)
            .when(F.col("reviewed") >= most, BUDGET)
            .when(F.col("fetched") >= F.col("n"), NONE_LEFT)
        )
        new = active.join(so_far, "query_id").join(sizes, "query_id").select("query_id", reason.alias("stop_reason"), (F.col("at") + 1).alias("rounds_used")).where("stop_reason is not null")
        stops = stage(stops.unionByName(new), "progressive-stops")
        if stops.count() == sizes.count():
            break
    rows = seen.join(ranking.select("query_id", "doc_id", "score"), ["query_id", "doc_id"]).withColumn("tier_order", F.coalesce(*[F.when(F.col("tier") == t, o) for t, o in _ORDER.items()], F.lit(1)))
    results = ranked(rows.drop("rank"), top, [F.asc("tier_order"), F.desc("score"), F.asc("doc_id")]).select("query_id", "doc_id", "score", "tier", "reason", "iteration_found", "rank")
    counts = seen.groupBy("query_id").agg(F.count_if("evaluated").alias("reviewed"), *[F.count_if(F.col("tier") == t).alias(t.replace("-", "_")) for t in _ORDER])
    return results, stops.join(counts, "query_id")


def progressive_with_checklist(scores: DataFrame, boosts: DataFrame, evaluator: Evaluator, **how) -> tuple[DataFrame, DataFrame]:
    """``progressive`` on scores raised by what documents have of a query's checklist.

    boosts: (query_id, doc_id, boost), such as ``rescore.checklist`` makes of ``providers.checklists``; a pair
    without one keeps its score.
    """
    raised = scores.join(boosts, ["query_id", "doc_id"], "left").withColumn("score", F.round(F.col("score") * F.coalesce("boost", F.lit(1.0)), 6)).drop("boost")
    return progressive(raised, evaluator, **how)
