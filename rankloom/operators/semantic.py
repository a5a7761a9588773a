"""Scores given for names or ids, found for profiles step by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .containment import either_way


#: Characters of a name by which it is joined.
WHOLE = 64


def resolve(profiles: DataFrame, by_id: DataFrame, by_name: DataFrame, repeated: Column | None = None) -> DataFrame:
    """(doc_id, name, specialty) -> doc_id and semantic, 0 to 1.

    by_id: (doc_id, score).  by_name: (pos, name, score), pos being the order of names.
    A score by id counts first, even 0.  Else that of the equal name (if that is given
    several times, the last, or ``repeated``, an aggregate of score and pos); if that is none or
    0, that of the first name that contains the profile's or is within it, in full or by
    last words; if that is none or 0, that of the first name that contains the specialty
    or is within it; else 0.  The steps by containment join on runs of characters, distinct
    strings only, and give each string its first name before profiles come to it.
    """
    given = stage(by_name.select("pos", "name", "score"), "names")  # read often, and its size is known then
    known = profiles.select("doc_id", "name", F.lower(F.coalesce("name", F.lit(""))).alias("low"), F.lower(F.coalesce("specialty", F.lit(""))).alias("spec")).join(by_id.select("doc_id", F.col("score").alias("s0")), "doc_id", "left")
    equal = given.groupBy("name").agg((F.max_by("score", "pos") if repeated is None else repeated).alias("s1"))
    rows = known.join(equal, "name", "left").withColumn("s1", F.coalesce("s1", F.lit(0.0)))
    open_ = rows.where("s0 is null and s1 = 0")
    last = lambda c: F.substring_index(c, " ", -1)
    several = lambda c: F.contains(F.col(c), F.lit(" "))
    names = given.select(F.lower("name").alias("key"), F.struct("pos", "score").alias("first"))

    def first_of(values: DataFrame, keys: DataFrame) -> DataFrame:
        """(a), (b, first) -> a and the first of the names whose b contains it or is within it."""
        each = keys.where("b <> ''").groupBy("b").agg(F.min("first").alias("first"))
        return either_way(values, each.select("b"), WHOLE).join(each, "b").groupBy("a").agg(F.min("first").alias("first"))

    persons = stage(open_.select("low").where("low <> ''").distinct(), "persons")
    in_full = first_of(persons.select(F.col("low").alias("a")), names.select(F.col("key").alias("b"), "first"))
    # Two names of one word each have met in full; last words are compared where either has several.
    last_words = persons.where(several("low")).select("low", last("low").alias("a"))
    by_last = last_words.join(first_of(last_words.select("a"), names.select(last("key").alias("b"), "first")), "a").select("low", "first")
    by_word = first_of(persons.where(~several("low")).select(F.col("low").alias("a")), names.where(several("key")).select(last("key").alias("b"), "first"))
    met = in_full.unionByName(by_word).withColumnRenamed("a", "low").unionByName(by_last)
    second = stage(met.groupBy("low").agg(F.min("first")["score"].alias("s2")), "by-name")
    specs = open_.select(F.col("spec").alias("a")).where("a <> ''").distinct()
    third = stage(first_of(specs, names.select(F.col("key").alias("b"), "first")).select(F.col("a").alias("spec"), F.col("first")["score"].alias("s3")), "by-specialty")
    out = rows.join(second, "low", "left").join(third, "spec", "left")
    score = F.when(F.col("s0").isNotNull(), F.col("s0")).when(F.col("s1") != 0, F.col("s1")).when(F.coalesce("s2", F.lit(0.0)) != 0, F.col("s2")).otherwise(F.coalesce("s3", F.lit(0.0)))
    return out.select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("semantic"))
