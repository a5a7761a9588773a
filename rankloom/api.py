"""What a service would answer, as functions that return DataFrames: statistics, name search, ranking, log statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import RankingConfig
from .operators import conditions, filters, sessions, shortlist

search_doctor = filters.name_search


def stats(profiles: DataFrame) -> DataFrame:
    """One row over profiles (as ``profiles.normalise`` makes them): how many, verified, with a postcode, a gender, languages, procedures, and specialties."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return profiles.agg(
        F.count(F.lit(1)).alias("profiles"), F.count_if("verified").alias("verified"), F.count("postal_code").alias("with_postcode"), F.count("gender").alias("with_gender"),
        F.count_if(some("languages")).alias("with_languages"), F.count_if(F.col("procedure_count") > 0).alias("with_procedures"), F.count_if("blacklisted").alias("blacklisted"), F.countDistinct("specialty").alias("specialties"),
    )


def search(profiles: DataFrame, *, name: str | None = None, specialty: str | None = None, nhs: bool = False, where: Column | None = None) -> DataFrame:
    """Profiles that are not blacklisted and satisfy all that is asked."""
    found = profiles.where(filters.not_blacklisted(F.col("blacklisted")))
    if name:
        found = found.where(F.contains(F.lower("name"), F.lit(name.lower())))
    if specialty:
        found = found.where(filters.specialty_matches(F.col("specialty"), F.col("subspecialties"), F.col("clinical_expertise"), F.col("title"), specialty))
    if nhs:
        found = found.where(filters.has_nhs(F.col("nhs_base"), F.col("nhs_posts")))
    return found.where(where) if where is not None else found


def rank(queries: DataFrame, documents: DataFrame, counts, config: RankingConfig = RankingConfig(), where: Column | None = None, asked: DataFrame | None = None, catalogue: conditions.Catalogue | None = None) -> DataFrame:
    """The two-stage short list of every query, over the documents that its conditions (``asked``, by a catalogue of what documents offer) let through."""
    first = catalogue.scores(queries, asked, config) if catalogue is not None and asked is not None else None
    return shortlist.shortlist(queries, documents, counts, config, where, first)


def rank_production(queries: DataFrame, documents: DataFrame, signals: DataFrame, config: RankingConfig = RankingConfig(), top: int | None = None) -> DataFrame:
    """The production ranking of every query, its first ``top`` ranks (``top_k`` of the configuration by default)."""
    return shortlist.production(queries, documents, signals, config).where(F.col("rank") <= (top or config.top_k))


def tracker_stats(log: DataFrame, target: str, top: int = 20) -> DataFrame:
    """The most frequent targets of the log, with shares and first sightings."""
    return sessions.tally(log, target, top)
