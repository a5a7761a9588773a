"""The ranking end to end: filtered documents and queries in, short lists out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RankingConfig
from ..staging import stage
from . import boosts as B
from . import fusion as FU
from . import index
from . import rescore as RS
from .bm25 import bm25, min_max, ranked, repeats
from .phrases import bonuses

PAIR = ["query_id", "doc_id"]


def _with_bonus(queries: DataFrame, documents: DataFrame, signals: DataFrame, config: RankingConfig, fields: dict[str, int] | None, longest: int) -> DataFrame:
    """Every scored pair with its signals and its bonus: 2 for the whole query in the text, 1 for every run of words.

    Texts become postings, and runs of words meet the queries' runs; no text goes further.
    """
    weights = repeats(fields) if fields else fields_of(documents, config)
    scores = index.build(documents, list(weights)).scores(queries, config, weights)
    bonus = bonuses(queries, weighted_text(documents, weights), longest)
    return scores.join(bonus, PAIR, "left").join(signals, "doc_id", "left").withColumn("bonus", F.coalesce("bonus", F.lit(0.0)))


def fields_of(documents: DataFrame, config: RankingConfig) -> dict[str, int]:
    """``text`` if the documents have it, else those of the configuration's fields that they have, with their repetitions."""
    return {"text": 1} if "text" in documents.columns else repeats({f: w for f, w in config.fields.items() if f in documents.columns})


def weighted_text(documents: DataFrame, weights: dict[str, int]) -> DataFrame:
    """doc_id and text: the fields one after another, each as often as its weight says; empty ones are left out."""
    if list(weights.values()) == [1]:
        return documents.select("doc_id", F.col(next(iter(weights))).alias("text"))
    part = lambda f: F.nullif(F.col(f), F.lit(""))
    return documents.select("doc_id", F.concat_ws(" ", *[part(f) for f, n in weights.items() for _ in range(n)]).alias("text"))


def production(queries: DataFrame, documents: DataFrame, signals: DataFrame, config: RankingConfig = RankingConfig(), fields: dict[str, int] | None = None) -> DataFrame:
    """The production ranker: (BM25 x quality x proximity) + phrase bonus, scaled to 0..1 within a query, plus weighted semantic scores.

    signals: doc_id, quality, proximity, semantic (null: 1, 1 and 0).  ``fields`` names the
    columns that make a document's text and how often each counts; without it, that is
    ``text``, or the fields of the configuration (``PRODUCTION_FIELDS``) for whole profiles.  Every document that shares a term with
    a query is scored.
    """
    both = _with_bonus(queries, documents, signals, config, fields, 3)
    raw = F.round(F.col("score") * F.coalesce("quality", F.lit(1.0)) * F.coalesce("proximity", F.lit(1.0)) + F.col("bonus"), 6)
    # Written once: a query's least and greatest score are read before the pairs are scaled by them.
    scaled = min_max(stage(both.select(*PAIR, raw.alias("score"), F.coalesce("semantic", F.lit(0.0)).alias("semantic")), "production-scores"))
    return ranked(scaled.select(*PAIR, F.round(F.round("scaled", 6) + config.semantic_weight * F.col("semantic"), 6).alias("score")))


def local(queries: DataFrame, documents: DataFrame, signals: DataFrame, config: RankingConfig = RankingConfig(variant="local"), fields: dict[str, int] | None = None) -> DataFrame:
    """The local ranker: max(0, (BM25 x quality + bonus for pairs of words) x negative penalty); signals: doc_id, quality, negatives."""
    both = _with_bonus(queries, documents, signals, config, fields, 2)
    raw = (F.col("score") * F.coalesce("quality", F.lit(1.0)) + F.col("bonus")) * B.negative(F.coalesce("negatives", F.lit(0)))
    return ranked(both.select(*PAIR, F.round(F.greatest(F.lit(0.0), raw), 6).alias("score")))


def stage_a(queries: DataFrame, documents: DataFrame, config: RankingConfig = RankingConfig(), top: int | None = None) -> DataFrame:
    """The first stage's best ``top`` (the configured size by default) of every query."""
    size = top or config.stage_a_size()
    return ranked(bm25(queries, documents, config, fields_of(documents, config), top=size), size)


def shortlist(queries: DataFrame, documents: DataFrame, counts, config: RankingConfig = RankingConfig(), where: Column | None = None, first: DataFrame | None = None) -> DataFrame:
    """Filter, first stage, second stage, best ``top_k``.

    ``where`` filters documents first, so document frequencies are those of what is left;
    ``first`` gives the first stage's scores (query_id, doc_id, score) instead, such as those of
    ``conditions.Catalogue.scores``, where every query has a filter of its own.
    ``counts`` adds the columns intent, anchor, negative, subspecialty and ambiguous to
    the first stage's rows, which have query_id, doc_id, score, body and query.
    """
    kept = documents.where(where) if where is not None else documents
    top = stage_a(queries, kept, config) if first is None else ranked(first, config.stage_a_size())
    texts = weighted_text(kept, fields_of(kept, config)).withColumnRenamed("text", "body")
    rows = counts(top.join(texts, "doc_id").join(queries.withColumnRenamed("text", "query"), "query_id"))
    score = RS.additive(*[F.col(c) for c in ("score", "intent", "anchor", "negative", "subspecialty", "ambiguous")], config.intent_weight, config.anchor_weight, config.subspecialty_cap)
    return ranked(rows.select(*PAIR, F.round(score, 6).alias("score")), config.top_k)


def with_unscored(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every pair of candidates (query_id, doc_id), those without a score at 0."""
    return candidates.join(scores, PAIR, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def multi_stage(base: DataFrame, chosen: DataFrame, final: DataFrame, least: int = 12, most: int = 25, top: int = 12) -> DataFrame:
    """Two reranks in a row: a short list given by ``chosen``, filled up to ``most`` if it has fewer than ``least``, then the order given by ``final``.

    base: ranking (query_id, doc_id, rank); chosen, final: given orders (query_id, doc_id,
    pos); ids that are unknown or repeated do not count.  Queries without any choice take
    the first ``most`` of the base.
    """
    filled = FU.back_fill(chosen, base, most)
    own = chosen.groupBy(*PAIR).agg(F.min("pos").alias("pos")).join(base.select(*PAIR), PAIR, "left_semi")
    size = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = filled.join(size, "query_id", "left").where(F.coalesce("n", F.lit(0)).between(1, least - 1) | F.coalesce("n", F.lit(0)).eqNullSafe(0) | (F.col("rank") <= F.col("n"))).drop("n")
    return FU.back_fill(final, short, top)


def staged_rerank(base: DataFrame, rescored: DataFrame, given: DataFrame, stage_b: int = 50, top: int = 12) -> DataFrame:
    """First stage, second stage, given order: the best ``stage_b`` by the rescored score, of those in the base, in the order given, filled up."""
    order = ranked(rescored.join(base.select(*PAIR), PAIR, "left_semi"), stage_b)
    return FU.back_fill(given, order, top)


def progressive_with_checklist(scores: DataFrame, boosts: DataFrame, evaluations: DataFrame, **how) -> DataFrame:
    """``fusion.progressive`` on scores raised by each document's checklist boost (doc_id, boost)."""
    raised = scores.join(boosts, "doc_id", "left").withColumn("score", F.round(F.col("score") * F.coalesce("boost", F.lit(1.0)), 6)).drop("boost")
    return FU.progressive(raised, evaluations, **how)


def fetch_depth(fetched: int, batch: int, available: int) -> int:
    """How deep to rank so that a batch of unseen documents is among the result."""
    return max(fetched + 2 * batch, 3 * batch, min(available, fetched + 5 * batch))


def next_batch(ranking: DataFrame, seen: DataFrame, batch: int = 12) -> DataFrame:
    """The next ``batch`` documents of each query that were not seen (query_id, doc_id); looks as deep as ``fetch_depth`` says."""
    known = seen.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n"))
    sized = ranking.join(known, "query_id", "left").join(ranking.groupBy("query_id").agg(F.count(F.lit(1)).alias("of")), "query_id")
    n = F.coalesce("n", F.lit(0))
    depth = F.greatest(n + 2 * batch, F.lit(3 * batch), F.least(F.col("of"), n + 5 * batch))
    fresh = sized.where(F.col("rank") <= depth).join(seen.select(*PAIR), PAIR, "left_anti")
    return ranked(fresh.select(*PAIR, "score"), batch)


def with_cached(queries: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contexts that are cached (query_id, context), and the queries that still need one."""
    return queries.select("query_id").join(cache, "query_id"), queries.join(cache.select("query_id"), "query_id", "left_anti")


def tracker_entry(ranking: DataFrame, names: DataFrame, top: int = 10) -> DataFrame:
    """What a search leaves in the log: its best ``top`` as an ordered array of rank, doc_id, name, score."""
    rows = ranking.where(F.col("rank") <= top).join(names.select("doc_id", "name"), "doc_id", "left")
    return rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "name", "score"))).alias("top"))
