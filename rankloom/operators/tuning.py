"""Search over the ranker's own parameters: k1, b, field weights and rescoring weights, many configurations in one job."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ..config import RankingConfig
from ..functions import text as T
from ..staging import stage
from .best import Best
from .bm25 import idf, query_terms, ranked
from .index import Index

#: Within which the parameters are drawn.
BM25_RANGES = {"k1": (1.0, 2.0), "b": (0.5, 0.9)}
FIELD_RANGES = {
    "expertise_procedures": (1.5, 3.0), "expertise_conditions": (1.5, 3.0), "expertise_interests": (1.0, 2.5), "procedure_groups": (1.5, 4.0), "specialty": (1.5, 3.5), "subspecialties": (1.5, 3.5),
    "description": (1.0, 2.0), "about": (0.3, 1.5), "name": (0.3, 1.5), "memberships": (0.3, 1.5), "address_locality": (0.3, 1.5), "title": (0.3, 1.5),
}
RESCORE_RANGES = {
    "high_signal_1": (1.5, 3.5), "high_signal_2": (3.0, 6.0), "pathway_1": (0.5, 2.0), "pathway_2": (1.0, 3.5), "pathway_3": (2.0, 5.0), "procedure_per_match": (0.2, 0.8), "anchor_per_match": (0.15, 0.4), "anchor_cap": (0.5, 1.0),
    "subspecialty_factor": (0.2, 0.6), "subspecialty_cap": (0.3, 0.8), "negative_1": (-2.0, -0.3), "negative_2": (-3.5, -1.0), "negative_4": (-5.0, -1.5), "safe_lane_1": (0.5, 1.5), "safe_lane_2": (1.0, 3.0), "safe_lane_3_or_more": (2.0, 4.5),
}


def draws(spark: SparkSession, ranges: dict[str, tuple[float, float]], n: int, seed: str = "tune") -> DataFrame:
    """(config, a column for each name): ``n`` configurations within the ranges, which any rerun draws again; six decimal places."""

    def value(name: str, lo: float, hi: float) -> Column:
        digits = F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.col("config").cast("string"), F.lit(name)).cast("binary")), 1, 8)
        return F.round(lo + (hi - lo) * F.conv(digits, 16, 10).cast("double") / float(1 << 32), 6).alias(name)

    return spark.range(n).withColumnRenamed("id", "config").select("config", *[value(k, *r) for k, r in ranges.items()])


@dataclass(frozen=True)
class Statistics:
    """What every configuration needs to know, made once: a written row for each document.

    rows: doc_id, lengths (of the fields), terms (those that a query has): array of struct<term (its
    number), field, n (occurrences)>.  asked: (query_id, term, weight: qtf x idf), the queries' own
    terms.  means: of the fields' lengths, over all documents.
    """

    rows: DataFrame
    asked: pa.Table
    means: list[float]

    def of(self, queries: DataFrame) -> "Statistics":
        """For the queries (query_id) of ``queries`` alone; weights and lengths stay."""
        ids = queries.select("query_id").distinct().toArrow()["query_id"].combine_chunks()
        return replace(self, asked=self.asked.filter(pc.is_in(self.asked["query_id"], ids.cast(self.asked.schema.field("query_id").type))))


HELD = "doc_id long, lengths array<int>, terms array<struct<term: int, field: int, n: int>>"


def occurrences(documents: DataFrame, fields: list[str], tokenise=T.tokens) -> Index:
    """Rows like those of an index that is not kept: every occurrence by itself, nothing sorted or written."""
    made = documents.select("doc_id", *[tokenise(F.col(c)).alias(f"t{i}") for i, c in enumerate(fields)])
    each = [F.transform(f"t{i}", lambda x: F.struct(x.alias("term"), F.lit(i).alias("field"), F.lit(1).alias("n"))) for i in range(len(fields))]  # noqa: B023
    return Index(made.select("doc_id", F.array(*[F.size(f"t{i}") for i in range(len(fields))]).alias("lengths"), F.concat(*each).alias("terms")), fields)


def _numbered(words: pa.Array, width: int):
    """Documents' terms (term, field, n) -> those among ``words``, by number, added up."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, field, n = batch["terms"].flatten().flatten()
            number = pc.index_in(term, words)
            known = number.is_valid().to_numpy(zero_copy_only=False)
            owner, number, field, n = (x.to_numpy(zero_copy_only=False)[known].astype(np.int64) for x in (pc.list_parent_indices(batch["terms"]), number, field, n))
            held, own = np.unique((owner * len(words) + number) * width + field, return_inverse=True)
            cells = (held // width % max(1, len(words)), held % width, np.bincount(own, n, len(held)))
            ends = np.searchsorted(held // (width * max(1, len(words))), np.arange(len(batch) + 1))
            terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in cells], names=["term", "field", "n"]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lengths"], terms], names=["doc_id", "lengths", "terms"])

    return run


def statistics(index: Index, queries: DataFrame, config: RankingConfig = RankingConfig()) -> Statistics:
    """Statistics of the queries' terms in an index or in ``occurrences`` (doc_id: a whole number), which is read once.

    Field weights are at least one repetition, so document frequencies do not change with them.
    """
    asked = query_terms(queries, config.variant == "mini").toArrow().combine_chunks()
    words = pc.unique(asked["term"]).cast(pa.string())
    rows = index.rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lengths", "terms").mapInArrow(_numbered(words, len(index.fields)), HELD)
    held = stage(rows, "tuning-statistics")
    sizes = held.agg(F.count(F.lit(1)).cast("double"), *[F.coalesce(F.avg(F.get("lengths", F.lit(i))), F.lit(0.0)) for i in range(len(index.fields))]).first()
    df = held.select(F.explode(F.array_distinct(F.col("terms")["term"])).alias("term")).groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    weights = df.select("term", idf(F.col("df"), F.lit(sizes[0]), config.variant).alias("idf")).toArrow()
    of_word = np.full(len(words), np.nan)  # of words that no document has
    of_word[weights["term"].to_numpy()] = weights["idf"].to_numpy()
    number = pc.index_in(asked["term"].cast(pa.string()), words)
    weight = asked["qtf"].to_numpy() * of_word[number.to_numpy()]
    made = pa.table({"query_id": asked["query_id"], "term": number, "weight": weight})
    return Statistics(held, made.filter(pa.array(~np.isnan(weight))), list(sizes[1:]))


def _crossed(rows: DataFrame, configs: DataFrame) -> DataFrame:
    """Every row beside every configuration; these are a bounded draw, one row when they are sent."""
    names = [c for c in configs.columns if c != "config"]
    every = configs.agg(F.collect_list(F.struct(F.col("config"), F.struct(*names).alias("with"))).alias("every"))
    return rows.join(F.broadcast(every)).withColumn("c", F.explode("every")).select(*rows.columns, F.col("c.config").alias("config"), F.col("c.with").alias("with"))


#: Sums of a document and query under a configuration that are made at a time.
TOGETHER = 1 << 19


def _best(stats: Statistics, drawn: pa.Table, fields: list[str], k: int):
    """Rows of ``Statistics`` -> (config, query_id, doc_id, score): the ``k`` best of every query under every configuration in a task."""
    k1, b = (drawn[c].to_numpy().astype(float) for c in ("k1", "b"))
    times = np.array([np.maximum(1, np.floor(drawn[f].to_numpy() + 0.5)) for f in fields])  # fields x configurations
    avgdl = np.array(stats.means) @ times
    avgdl[avgdl == 0] = 1.0
    asked = stats.asked.combine_chunks().sort_by([("term", "ascending"), ("query_id", "ascending")])
    names = pc.unique(asked["query_id"]).sort()
    query, weight, term_of = pc.index_in(asked["query_id"], names).to_numpy().astype(np.int64), asked["weight"].to_numpy(), asked["term"].to_numpy()
    heads = np.searchsorted(term_of, np.arange(term_of.max(initial=-1) + 2))  # where each term's queries begin
    configs = drawn["config"].combine_chunks()
    n_configs, n_queries, n_terms = len(drawn), len(names), len(heads) - 1

    def scores(lengths: np.ndarray, document: np.ndarray, term: np.ndarray, field: np.ndarray, n: np.ndarray):
        """Documents by fields; occurrences -> each pair's document and query, its scores (pairs x configurations)."""
        held, own = np.unique(document * n_terms + term, return_inverse=True)
        document, term = held // n_terms, held % n_terms
        tf = np.bincount(own * len(fields) + field, n, len(held) * len(fields)).reshape(-1, len(fields)) @ times
        norm = k1 * (1 - b + b * (lengths @ times) / avgdl)
        gain = tf * (k1 + 1) / (tf + norm[document])
        count = np.diff(heads)[term]
        at = np.repeat(heads[term] - np.cumsum(count) + count, count) + np.arange(count.sum())
        pair = np.repeat(document, count) * n_queries + query[at]
        order = np.argsort(pair, kind="stable")
        pair, first = np.unique(pair[order], return_index=True)
        sums = np.add.reduceat(gain[np.repeat(np.arange(len(held)), count)[order]] * weight[at[order], None], first, axis=0)
        return pair // n_queries, pair % n_queries, np.floor(sums * 1e6 + 0.5) / 1e6

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n_queries * n_configs, k)
        step = k  # the first documents find places, so there are few of them
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            lengths = batch["lengths"].flatten().to_numpy().reshape(len(ids), -1).astype(float)
            lists = batch["terms"]
            term, field, n = (x.to_numpy().astype(np.int64) for x in lists.flatten().flatten())
            document = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
            known = term < n_terms  # terms beyond those are of queries not asked for
            term, field, n, document = term[known], field[known], n[known], document[known]
            work = np.cumsum(np.bincount(document, np.diff(heads)[term], len(ids))) * n_configs
            at = 0
            while at < len(ids):
                fits = int(np.searchsorted(work, (work[at - 1] if at else 0) + TOGETHER, "right"))
                until = min(max(fits, at + 1), at + step)
                step = min(2 * step, TOGETHER)
                lo, hi = np.searchsorted(document, (at, until))
                if work[until - 1] > (work[at - 1] if at else 0):
                    d, q, found = scores(lengths[at:until], document[lo:hi] - at, term[lo:hi], field[lo:hi], n[lo:hi])
                    floor = best.floor.reshape(n_queries, n_configs)
                    pair, c = np.nonzero(found >= floor[q])
                    best.add(q[pair] * n_configs + c, found[pair, c], ids[at:until][d[pair]])
                at = until
        key, doc, score = best.rows()
        cells = [configs.take(pa.array(key % n_configs)), names.take(pa.array(key // n_configs)), pa.array(doc), pa.array(score)]
        yield pa.RecordBatch.from_arrays(cells, names=["config", "query_id", "doc_id", "score"])

    return run


def rank_configs(stats: Statistics, configs: DataFrame, fields: list[str], k: int = 12) -> DataFrame:
    """(config, query_id, doc_id, score, rank): the ``k`` best of every query under every configuration (config, k1, b, a weight for each field).

    Scores are those of ``bm25`` with these parameters; a weight is as many repetitions as
    ``repeats`` makes of it.  A document is read once and scored under all configurations;
    only the best of each task are shuffled.
    """
    spark = configs.sparkSession
    drawn = configs.select("config", "k1", "b", *fields).toArrow().combine_chunks()  # a bounded draw
    kind = from_arrow_type(stats.asked.schema.field("query_id").type).simpleString()
    out = f"config {configs.schema['config'].dataType.simpleString()}, query_id {kind}, doc_id long, score double"
    if not stats.asked.num_rows or not drawn.num_rows:
        return _top(spark.createDataFrame([], out), k)
    # Scoring is long and its rows are small, so their bytes would make too few tasks.
    dealt = stats.rows.repartition(2 * spark.sparkContext.defaultParallelism)
    return _top(dealt.mapInArrow(_best(stats, drawn, fields, k), out), k)


def _top(scored: DataFrame, k: int, by=("score",)) -> DataFrame:
    order = Window.partitionBy("config", "query_id").orderBy(*[F.desc(c) for c in by], "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rescore_configs(counts: DataFrame, configs: DataFrame, k: int = 12) -> DataFrame:
    """(config, query_id, doc_id, score, tier, rank): the tiered rescoring under every configuration of RESCORE_RANGES' names.

    counts: query_id, doc_id, score, and the counts high, pathway, procedure, anchor, safe,
    subspecialty, negative of the first stage's short list.
    """
    crossed = _crossed(counts, configs)
    tier = tiered_parts(*[F.col(c) for c in ("high", "pathway", "procedure", "anchor", "safe", "subspecialty", "negative")], lambda name: F.col("with")[name])
    return _top(crossed.select("config", "query_id", "doc_id", "score", F.round(tier, 6).alias("tier")), k, ("tier", "score"))


def tiered_parts(high: Column, pathway: Column, procedure: Column, anchor: Column, safe: Column, subspecialty: Column, negative: Column, weight) -> Column:
    """The points of ``rescore.tiered`` with every weight given by its name in RESCORE_RANGES."""
    w = weight
    return (
        F.when(high >= 2, w("high_signal_2")).when(high == 1, w("high_signal_1")).otherwise(0.0)
        + F.when(pathway >= 3, w("pathway_3")).when(pathway == 2, w("pathway_2")).when(pathway == 1, w("pathway_1")).otherwise(0.0)
        + w("procedure_per_match") * procedure
        + F.least(w("anchor_per_match") * anchor, w("anchor_cap"))
        + F.when(safe >= 3, w("safe_lane_3_or_more")).when(safe == 2, w("safe_lane_2")).when(safe == 1, w("safe_lane_1")).otherwise(0.0)
        + F.least(w("subspecialty_factor") * subspecialty, w("subspecialty_cap"))
        + F.when(negative >= 4, w("negative_4")).when(negative >= 2, w("negative_2")).when(negative == 1, w("negative_1")).otherwise(0.0)
    )


def ndcg(rankings: DataFrame, truth: DataFrame, k: int = 12) -> DataFrame:
    """(config, query_id, ndcg) of every query that has a truth (query_id, doc_id) and a ranking."""
    known = truth.distinct()
    sizes = known.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_true"))
    rows = rankings.join(sizes, "query_id").join(known.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    gain = F.sum(F.when((F.col("rank") <= k) & F.col("hit").isNotNull(), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.first("n_true"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return rows.groupBy("config", "query_id").agg(F.round(gain / ideal, 9).alias("ndcg"))


def halving(evaluate, configs: DataFrame, cases: DataFrame, *, rounds: int = 3, keep: float = 0.5) -> DataFrame:
    """(config, rounds_survived, train, holdout): successive halving over growing parts of the training cases.

    cases: (query_id, split 'train' or 'holdout').  Round r of ``rounds`` looks at
    1 / 2^(rounds - r) of the training cases, the first by a hash, and keeps the better
    ``keep`` of the configurations (ties: the smaller number).  ``evaluate`` maps (configs,
    query_ids) to (config, query_id, ndcg).  ``train`` is a configuration's mean in its last
    round; ``holdout``, of those that went through all rounds, the mean over cases never looked at.
    """
    order = Window.partitionBy("split").orderBy(F.md5(F.col("query_id").cast("string").cast("binary")), "query_id")
    placed = stage(cases.select("query_id", "split").distinct().withColumn("place", F.row_number().over(order)), "tuning-cases")
    n_train, live, lost = placed.where("split = 'train'").count(), stage(configs, "tuning-configs"), None
    for r in range(1, rounds + 1):
        size = max(1, -(-n_train // (1 << (rounds - r))))
        part = placed.where((F.col("split") == "train") & (F.col("place") <= size)).select("query_id")
        means = stage(evaluate(live, part).groupBy("config").agg(F.round(F.avg("ndcg"), 9).alias("train")), f"tuning-round{r}")
        n = live.count()
        best = ranked(means.select(F.lit(0).alias("query_id"), F.col("config").alias("doc_id"), F.col("train").alias("score")))
        kept = best.where(F.col("rank") <= max(1, int(n * keep))) if r < rounds else best
        out = best.join(kept.select("doc_id"), "doc_id", "left_anti") if r < rounds else best
        gone = out.select(F.col("doc_id").alias("config"), F.lit(r - 1 if r < rounds else rounds).alias("rounds_survived"), F.col("score").alias("train"))
        lost = gone if lost is None else lost.unionByName(gone)
        live = stage(live.join(kept.select(F.col("doc_id").alias("config")), "config", "left_semi"), "tuning-configs")
    held = evaluate(live, placed.where("split = 'holdout'").select("query_id")).groupBy("config").agg(F.round(F.avg("ndcg"), 9).alias("holdout"))
    return lost.join(held, "config", "left")
