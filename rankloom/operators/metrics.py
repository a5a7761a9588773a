"""Ranking metrics and rank diagnostics, one aggregate per case."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage


def judged(ranking: DataFrame, truth: DataFrame, tasks: int | None = None) -> DataFrame:
    """The ranked documents of each query's truth (query_id, doc_id) with hit 1, and the truth's size; a query without any has one row with hit 0.

    Other ranks go where the truth meets them, and only the truth is held there: the ranking is not sorted again.
    With ``tasks``, both sides are dealt into so many before anything is held, and the hits are written once.
    """
    deal = lambda df: df.repartition(tasks, "query_id", "doc_id") if tasks else df
    pairs = deal(truth).distinct()
    sizes = pairs.groupBy("query_id").agg(F.count("doc_id").alias("n_true"))
    hits = deal(ranking).join(pairs.withColumn("hit", F.lit(1)).hint("shuffle_hash"), ["query_id", "doc_id"])
    hits = stage(hits, "hits") if tasks else hits
    # Sizes, a row for each query, go to the hits: no task gathers the hits of a query.
    without = sizes.join(hits.select("query_id").distinct(), "query_id", "left_anti").withColumn("hit", F.lit(0))
    return hits.join(F.broadcast(sizes), "query_id").unionByName(without, allowMissingColumns=True)


def at_k(rows: DataFrame, ks=(3, 5, 12)) -> DataFrame:
    """Precision (over k itself), recall, MRR and NDCG of each query that has a truth."""
    aggs = []
    for k in ks:
        hits = F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0))
        aggs += [F.round(hits / k, 6).alias(f"precision_{k}"), F.round(hits / F.first("n_true"), 6).alias(f"recall_{k}")]
    k = max(ks)
    gain = F.sum(F.when(F.col("rank") <= k, F.col("hit") / F.log2(F.col("rank") + 1)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.first("n_true"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    first = F.min(F.when(F.col("hit") == 1, F.col("rank")))
    return rows.groupBy("query_id").agg(*aggs, F.round(F.coalesce(1 / first, F.lit(0.0)), 6).alias("mrr"), F.round(gain / ideal, 6).alias(f"ndcg_{k}"))


def positions(rows: DataFrame) -> DataFrame:
    """Where the true documents stand."""
    rank = F.when(F.col("hit") == 1, F.col("rank"))
    return rows.groupBy("query_id").agg(
        F.round(F.avg(rank), 6).alias("avg_position"), F.min(rank).cast("long").alias("best_position"), F.max(rank).cast("long").alias("worst_position"),
        *[F.count(F.when(rank <= k, 1)).alias(f"in_top_{k}") for k in (3, 5, 10)],
        F.array_join(F.transform(F.sort_array(F.collect_list(rank)), lambda x: x.cast("string")), ",").alias("positions"),
    )


def tier_share(rows: DataFrame, ks=(3, 5, 12)) -> DataFrame:
    """Counts of each tier within the first k ranks, and whether the first three are all excellent."""
    aggs = [F.count(F.when((F.col("rank") <= k) & (F.col("tier") == t), 1)).alias(f"{t.replace('-', '_')}_{k}") for k in ks for t in ("excellent", "good", "ill-fit")]
    return rows.groupBy("query_id").agg(*aggs, (F.count(F.when((F.col("rank") <= 3) & (F.col("tier") == "excellent"), 1)) == 3).alias("all_excellent_3"))


def rank_buckets(rows: DataFrame, edges=(10, 50, 100, 150)) -> DataFrame:
    """Share of hits by bucket of rank."""
    bucket = F.lit(f">{edges[-1]}")
    for lo, hi in reversed(list(zip((0, *edges), edges))):
        bucket = F.when(F.col("rank") <= hi, F.lit(f"{lo + 1}-{hi}")).otherwise(bucket)
    counts = rows.where("hit = 1").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("hits"), F.round(F.avg("rank"), 6).alias("avg_rank"))
    return counts.withColumn("share", F.round(F.col("hits") / F.sum("hits").over(Window.partitionBy()), 6))


def hold_out(cases: DataFrame, group: str, n: int = 5) -> DataFrame:
    """The last ``n`` ids of each group are held out.

    Only the last few of each task are sorted by group; their least id cuts the rest.
    """
    last = cases.select(group, "case_id").distinct().withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("case_id")))).where(F.col("__n") <= n)
    cut = last.groupBy(F.col(group).alias("__group")).agg(F.min("case_id").alias("__cut"))
    joined = cases.join(cut, F.col(group).eqNullSafe(F.col("__group")), "left")
    return joined.withColumn("split", F.when(F.col("case_id") >= F.col("__cut"), "holdout").otherwise("train")).drop("__group", "__cut")


def penalty_ab(base: DataFrame, penalised: DataFrame, top: int = 50) -> DataFrame:
    """How a penalty moves the documents that were in the first ``top``: dropped out, worse, unchanged, better."""
    both = base.where(F.col("rank") <= top).select("query_id", "doc_id", F.col("rank").alias("before")).join(penalised.select("query_id", "doc_id", F.col("rank").alias("after")), ["query_id", "doc_id"], "left")
    dropped = F.col("after").isNull() | (F.col("after") > top)
    return both.groupBy("query_id").agg(
        F.count_if(dropped).alias("dropped"), F.count_if(~dropped & (F.col("after") > F.col("before"))).alias("worse"),
        F.count_if(~dropped & (F.col("after") == F.col("before"))).alias("same"), F.count_if(~dropped & (F.col("after") < F.col("before"))).alias("better"),
    )


def tier_rollup(shares: DataFrame, ks=(3, 5, 12)) -> DataFrame:
    """One row over all queries of :func:`tier_share`: percentages of slots by tier, and of queries whose first three are all excellent."""
    tiers = ("excellent", "good", "ill_fit")
    total = {k: sum((F.sum(f"{t}_{k}") for t in tiers), F.lit(0)) for k in ks}
    percents = [F.round(100 * F.sum(f"{t}_{k}") / total[k], 2).alias(f"{t}_{k}_percent") for k in ks for t in tiers]
    return shares.agg(F.count(F.lit(1)).alias("queries"), *percents, F.round(100 * F.count_if("all_excellent_3") / F.count(F.lit(1)), 2).alias("all_excellent_percent"))


def missing_picks(ranking: DataFrame, truth: DataFrame, n: int = 100, tasks: int | None = None) -> DataFrame:
    """True documents that the first ``n`` ranks lack: their rank and score (null where they are not ranked), the score at rank n, and the gap to it.

    With ``tasks``, truth and ranking are dealt into so many before they are joined.
    """
    deal = lambda df: df.repartition(tasks, "query_id", "doc_id") if tasks else df
    at = ranking.where(F.col("rank") == n).select("query_id", F.col("score").alias("score_at"))
    rows = deal(truth).distinct().join(deal(ranking.select("query_id", "doc_id", "rank", "score")), ["query_id", "doc_id"], "left")
    return rows.where(F.col("rank").isNull() | (F.col("rank") > n)).join(at, "query_id", "left").withColumn("gap", F.round(F.col("score_at") - F.coalesce("score", F.lit(0.0)), 6))


def weight_search(features: DataFrame, truth: DataFrame, configs: DataFrame, names: list[str], k: int = 12) -> DataFrame:
    """Mean recall@k of every configuration, all in one job.

    features: (query_id, doc_id, score, one column for each name); configs: (config, a
    weight for each name), a bounded grid or a draw within ranges.  A configuration ranks
    by score plus the weighted features; queries without a truth do not count.
    """
    sizes = truth.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_true"))
    rows = features.join(sizes, "query_id").join(truth.distinct().withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    grid = configs.agg(F.collect_list(F.struct("config", *[F.col(n).alias(f"w_{n}") for n in names])).alias("g"))  # one row
    each = rows.join(F.broadcast(grid)).withColumn("x", F.explode("g")).select("*", "x.*").drop("g", "x")
    total = F.round(F.col("score") + sum((F.col(n) * F.col(f"w_{n}") for n in names), F.lit(0.0)), 6)
    rank = F.row_number().over(Window.partitionBy("config", "query_id").orderBy(F.desc(total), "doc_id"))
    hits = each.withColumn("r", rank).groupBy("config", "query_id").agg((F.sum(F.when(F.col("r") <= k, F.coalesce("hit", F.lit(0))).otherwise(0)) / F.first("n_true")).alias("recall"))
    return hits.groupBy("config").agg(F.round(F.avg(F.round("recall", 9)), 9).alias("recall"))
