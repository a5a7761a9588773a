"""Normalising and merging records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expertise(text: Column) -> Column:
    """``Procedure: a; Condition: b; Clinical Interests: c`` as struct<procedures, conditions, interests>; the last interests count."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p))
    after = lambda prefix: F.transform(F.filter(parts, lambda p: p.startswith(prefix)), lambda p: F.trim(F.substring(p, F.lit(len(prefix) + 1), F.length(p))))
    return F.struct(after("Procedure:").alias("procedures"), after("Condition:").alias("conditions"), F.get(F.reverse(after("Clinical Interests:")), 0).alias("interests"))


def first_present(*values: Column) -> Column:
    """The first value that is neither null, blank nor the word null."""
    return F.coalesce(*[F.when((F.trim(v) != "") & (F.trim(v) != "null"), v) for v in values])


def upsert(sources: list[DataFrame], key: str) -> DataFrame:
    """Later sources replace earlier ones by key; rows without a key go; adds ``origin``, the source's place.

    Of rows that share a key within a source, the one with the least hash of all its
    values stays, so reruns agree.
    """
    rows = None
    for i, df in enumerate(sources):
        part = df.where(F.col(key).isNotNull()).withColumn("origin", F.lit(i)).withColumn("__tie", F.xxhash64(*[F.col(c) for c in df.columns]))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc("origin"), "__tie")
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__tie")


def upsert_counts(sources: list[DataFrame], key: str) -> DataFrame:
    """origin, replaced and added: the keys of each source that an earlier one has, and those that none has."""
    keys = None
    for i, df in enumerate(sources):
        part = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.lit(i).alias("origin"))
        keys = part if keys is None else keys.unionByName(part)
    each = keys.distinct()
    first = keys.groupBy("k").agg(F.min("origin").alias("first"))
    return each.join(first, "k").groupBy("origin").agg(F.count_if(F.col("origin") > F.col("first")).alias("replaced"), F.count_if(F.col("origin") == F.col("first")).alias("added"))


def insert_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All old rows and the new rows whose key is unknown; null keys are always new."""
    return old.unionByName(new.join(old.select(key).distinct(), key, "left_anti").select(*old.columns))


def canonical_names(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, names array) -> (id, names): each by its canonical spelling, the first of equal names (regardless of case)."""
    each = rows.select("id", F.posexplode("names").alias("pos", "raw"))
    named = each.join(aliases, F.lower("raw") == F.lower("variant"), "left").withColumn("name", F.coalesce("canonical", "raw"))
    first = named.groupBy("id", F.lower("name").alias("k")).agg(F.min(F.struct("pos", "name")).alias("x"))
    return first.groupBy("id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["name"]).alias("names"))


def blacklist(profiles: DataFrame, names: DataFrame, name: Column) -> DataFrame:
    """Adds ``blacklisted``: the normalised name is in names(name_key)."""
    hit = names.select("name_key").distinct().withColumn("blacklisted", F.lit(True))
    return profiles.withColumn("name_key", name).join(hit, "name_key", "left").withColumn("blacklisted", F.coalesce("blacklisted", F.lit(False)))


def remote_consultation(explicit: Column, flags: list[Column], kinds: Column, locations: Column) -> Column:
    """The explicit flag, true or false; else any flag, else a kind of consultation or a location's name that says so."""
    any_flag = F.coalesce(*[F.when(f, True) for f in flags], F.lit(False))
    says = lambda names, what: F.coalesce(F.exists(names, lambda x: F.lower(F.coalesce(x, F.lit(""))).rlike(what)), F.lit(False))
    return F.coalesce(explicit, any_flag | says(kinds, "video|telephone|telehealth|online|remote") | says(locations, "telephone|video consultation|online"))


def stable_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def volumes(completed: Column, published: Column) -> Column:
    """Procedure volumes of two sources, tagged: arrays of struct<name, volume, count> as struct<name, volume, source>; a count that is text becomes a number, nameless ones go."""
    none = F.expr("cast(array() as array<struct<name: string, volume: double, count: string>>)")
    named = lambda a: F.filter(F.coalesce(a, none), lambda x: F.coalesce(x["name"], F.lit("")) != "")
    number = lambda x: F.coalesce(x["volume"], x["count"].try_cast("double"))
    one = lambda a, source: F.transform(named(a), lambda x: F.struct(x["name"].alias("name"), number(x).alias("volume"), F.lit(source).alias("source")))
    # The tags of the two sources.
    return F.concat(one(completed, "BUPA"), one(published, "PHIN"))
