"""Where answers come from that no expression can make: a function over batches of rows, its text parsed and checked, or the typed fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_fences
from .rewrite import default_importance

#: Takes batches of rows; gives their keys and ``answer``, a JSON text with or without a Markdown fence (null: no answer).
Provider = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

CONTEXT = "goal string, specificity string, confidence double, intent_terms array<string>, anchor_phrases array<string>, negative_terms array<string>"
EVALUATION = "fit_category string, brief_reason string"
ORDER = "ranked array<long>"
CHECKLIST = "items array<string>"
_NEED = "array<struct<name: string, importance: string, confidence: double>>"
_LISTS = ("areas", "preferred_qualifications", "patient_age_group", "languages", "description_keywords", "avoid_subspecialties", "avoid_procedures")
IDEAL = f"subspecialties {_NEED}, procedures {_NEED}, conditions {_NEED}, {', '.join(f'{c} array<string>' for c in _LISTS)}, gender_preference string"
# What an evaluation may say; what is assumed where none can be had.
TIERS = ("excellent", "good", "ill-fit")
ASSUMED, FAILED = "good", "Evaluation failed"


def ask(rows: DataFrame, keys: list[str], provider: Provider, schema: str) -> DataFrame:
    """``keys`` and ``given``: the provider's answer to every row as a struct; null where there is none or it does not parse.

    A key that the provider answers several times has one of the answers that parse.
    """
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    said = rows.mapInPandas(provider, f"{kinds}, answer string")
    parsed = said.select(*keys, F.from_json(strip_fences(F.col("answer")), schema, {"mode": "PERMISSIVE"}).alias("given"))
    # A text that is no object parses to a struct of nulls.
    names = parsed.schema["given"].dataType.names
    some = reduce(lambda a, b: a | b, (F.col("given")[n].isNotNull() for n in names))
    given = parsed.where(some).groupBy(*keys).agg(F.first("given").alias("given"))
    return rows.select(*keys).distinct().join(given, keys, "left")


def fallback_context(query_id: Column) -> list[Column]:
    """What is assumed of a query when nobody says more: an ambiguous search for a diagnosis."""
    none = F.array().cast("array<string>")
    values = {"goal": F.lit("diagnostic_workup"), "specificity": F.lit("symptom_only"), "confidence": F.lit(0.5), "intent_terms": none, "anchor_phrases": none, "negative_terms": none}
    return [query_id.cast("long").alias("query_id"), *(v.alias(n) for n, v in values.items())]


def with_context(queries: DataFrame, provider: Provider | None = None) -> DataFrame:
    """A context for every query (query_id, text): what the provider gives, field by field, else the fallback."""
    assumed = queries.select(*fallback_context(F.col("query_id")))
    if provider is None:
        return assumed
    given = ask(queries.select(F.col("query_id").cast("long").alias("query_id"), "text"), ["query_id"], provider, CONTEXT)
    fields = [c for c in assumed.columns if c != "query_id"]
    return assumed.join(given, "query_id", "left").select("query_id", *[F.coalesce(F.col("given")[c], F.col(c)).alias(c) for c in fields])


def evaluations(rows: DataFrame, provider: Provider) -> DataFrame:
    """(query_id, doc_id, tier, reason) of every row; answers that are none, or of no known tier, count as a failed evaluation."""
    given = ask(rows, ["query_id", "doc_id"], provider, EVALUATION)
    tier = F.lower(F.trim(F.col("given.fit_category")))
    known = F.coalesce(tier.isin(*TIERS), F.lit(False))
    return given.select("query_id", "doc_id", F.when(known, tier).otherwise(ASSUMED).alias("tier"), F.when(known, F.coalesce("given.brief_reason", F.lit(""))).otherwise(FAILED).alias("reason"))


def orders(rows: DataFrame, provider: Provider) -> DataFrame:
    """(query_id, doc_id, pos) for ``fusion.back_fill``: the order that a reranker gives; queries without an answer have none."""
    given = ask(rows, ["query_id"], provider, ORDER).where("given is not null")
    return given.select("query_id", F.posexplode("given.ranked").alias("pos", "doc_id")).where("doc_id is not null").select("query_id", "doc_id", "pos")


def ideals(queries: DataFrame, provider: Provider) -> DataFrame:
    """(query_id, ideal): the ideal profile as a struct, every list there; an importance of no known kind is preferred, a confidence outside 0 to 1 is 0.8."""
    given = ask(queries, ["query_id"], provider, IDEAL)
    none = F.expr(f"cast(array() as {_NEED})")
    sure = lambda x: F.when(x["confidence"].between(0, 1), x["confidence"]).otherwise(F.lit(0.8)).alias("confidence")
    need = lambda c: F.transform(F.filter(F.coalesce(F.col("given")[c], none), lambda x: F.coalesce(F.trim(x["name"]), F.lit("")) != ""), lambda x: F.struct(F.trim(x["name"]).alias("name"), default_importance(x["importance"]).alias("importance"), sure(x)))
    return given.select("query_id", F.struct(*[need(c).alias(c) for c in ("subspecialties", "procedures", "conditions")], *[F.coalesce(f"given.{c}", F.array().cast("array<string>")).alias(c) for c in _LISTS], F.col("given.gender_preference").alias("gender_preference")).alias("ideal"))


def checklists(queries: DataFrame, provider: Provider, most: int = 10) -> DataFrame:
    """(query_id, items): what a good profile should have, at most ``most`` items; none where there is no answer."""
    given = ask(queries, ["query_id"], provider, CHECKLIST)
    items = F.filter(F.transform(F.coalesce("given.items", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return given.select("query_id", F.slice(F.array_distinct(items), 1, most).alias("items"))
