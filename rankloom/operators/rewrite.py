"""Query rewriting: aliases, concepts, term merges, safe terms, clarity, ideal profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from . import dictionary
from .containment import either_way, held_in


def expand_aliases(queries: DataFrame, aliases: DataFrame, most: int = 2) -> DataFrame:
    """Append the first alias of at most ``most`` terms that occur as whole words.

    aliases: (term, alias, low_priority, context); a low-priority entry comes last, longer
    terms first.  An entry with a context (array of words; null: no condition) needs
    any one of them among the query's words.
    """
    asked = queries.select(F.col("query_id").alias("text_id"), dictionary.words(F.col("text")).alias("words"))
    entries = aliases.withColumn("phrase_id", F.monotonically_increasing_id())
    found = dictionary.matches(asked, entries.select("phrase_id", dictionary.words(F.col("term")).alias("words"))).select(F.col("text_id").alias("query_id"), "phrase_id").distinct()
    hit = found.join(entries, "phrase_id")
    # The words of a context are one-word phrases of the same entry.
    gates = entries.where(F.size("context") > 0).select("phrase_id", F.explode("context").alias("word")).select("phrase_id", F.array(F.lower("word")).alias("words"))
    open_gates = dictionary.matches(asked, gates, 1).select(F.col("text_id").alias("query_id"), "phrase_id").distinct().withColumn("open", F.lit(True))
    hit = hit.join(open_gates, ["query_id", "phrase_id"], "left").where("context is null or open")
    order = Window.partitionBy("query_id").orderBy("low_priority", F.desc(F.length("term")), "term")
    best = hit.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    added = best.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "alias"))), lambda x: x["alias"]), " ").alias("added"))
    return queries.join(added, "query_id", "left").select("query_id", F.concat_ws(" ", "text", "added").alias("text"))


def expand_concepts(queries: DataFrame, concepts: DataFrame) -> DataFrame:
    """Append every related term of each trigger found anywhere in the query; concepts: (trigger, related)."""
    asked = queries.select("query_id", F.lower("text").alias("holder"))
    held = held_in(asked, concepts.select(F.col("trigger").alias("needle")))
    hit = asked.join(held, "holder").join(concepts, F.col("needle") == F.col("trigger"))
    added = hit.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("related")), " ").alias("added"))
    return queries.join(added, "query_id", "left").select("query_id", F.concat_ws(" ", "text", "added").alias("text"))


def specialty_of(text: Column) -> Column:
    """The specialty that a query names by itself; null if none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(None).cast("string")
    for name, patterns in reversed(C.SPECIALTY_PATTERNS.items()):
        out = F.when(reduce(lambda a, b: a | b, (low.rlike(p) for p in patterns)), name).otherwise(out)
    return out


def assemble(patient: Column, safe: Column, name: Column, n_safe: int = 4) -> Column:
    return F.trim(F.concat_ws(" ", patient, F.array_join(F.slice(safe, 1, n_safe), " "), name))


def merge_required(required: Column, synonyms: Column, most: int = 60) -> Column:
    """Required terms, then synonyms that neither contain nor are contained in one; at most ``most``."""
    free = F.filter(synonyms, lambda s: ~F.exists(required, lambda r: F.contains(s, r) | F.contains(r, s)))
    return F.slice(F.array_union(required, free), 1, most)


def required_terms(text: Column, symptoms: Column) -> Column:
    """The words of two characters or more of a query and of its symptoms, in lower case, each once."""
    words = lambda t: F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"\s+"), lambda w: F.length(w) >= 2)
    return F.array_distinct(F.concat(words(text), F.flatten(F.transform(symptoms, words))))


def append_terms(text: Column, anchors: Column, intents: Column | None = None, most: int = 10, at_most: int = 20) -> Column:
    """A query with all its anchors and, if given, the first ``most`` intent terms (never over ``at_most``)."""
    extra = [F.array_join(anchors, " ")] + ([F.array_join(F.slice(intents, 1, min(most, at_most)), " ")] if intents is not None else [])
    return F.trim(F.regexp_replace(F.concat_ws(" ", text, *extra), r"\s+", " "))


def specialty_anchors(anchors: Column, specialty: Column) -> Column:
    """A specialty's own phrases before the anchors, each once."""
    own = F.array().cast("array<string>")
    for name, phrases in C.SPECIALTY_ANCHORS.items():
        own = F.when(F.lower(F.trim(specialty)) == name, F.array(*[F.lit(p) for p in phrases])).otherwise(own)
    return F.when(F.size(own) > 0, F.array_union(own, anchors)).otherwise(anchors)


def safe_lane(terms: Column, most: int = 4) -> Column:
    """Symptoms and conditions among intent terms, by the fixed patterns, regardless of case."""
    return safe_terms(terms, [f"(?i){p}" for p in C.SAFE_PATTERNS], [f"(?i){p}" for p in C.UNSAFE_PATTERNS], most)


def safe_terms(terms: Column, allow: list[str], deny: list[str], most: int = 4) -> Column:
    """Terms that match an allowed pattern and no denied one."""
    any_of = lambda t, ps: reduce(lambda a, b: a | b, (t.rlike(p) for p in ps))
    return F.slice(F.array_distinct(F.filter(terms, lambda t: any_of(t, allow) & ~any_of(t, deny))), 1, most)


def merge_intents(clinical: Column, general: Column, subspecialties: Column) -> Column:
    """Clinical terms first, then unseen general ones, then the names of the top three subspecialties; lower case, trimmed."""
    clean = lambda a: F.filter(F.transform(a, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    return F.array_distinct(F.concat(clean(clinical), clean(general), clean(F.transform(F.slice(subspecialties, 1, 3), lambda s: s["name"]))))


def merge_anchors(first: Column, second: Column, most: int = 5) -> Column:
    """First spelling of each phrase regardless of case, at most ``most``."""
    both = F.concat(first, second)
    keep = F.filter(both, lambda x, i: ~F.exists(F.slice(both, F.lit(1), i), lambda y: F.lower(F.trim(y)) == F.lower(F.trim(x))))
    return F.slice(keep, 1, most)


def is_clear(confidence: Column, specificity: Column) -> Column:
    return (confidence >= 0.75) & specificity.isin("named_procedure", "confirmed_diagnosis")


def negatives_if_clear(negatives: Column, confidence: Column, specificity: Column) -> Column:
    return F.when(is_clear(confidence, specificity), negatives).otherwise(F.array().cast("array<string>"))


def merge_subspecialties(rows: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, name, confidence) -> the most confident spelling of each name, top ``most`` per query."""
    best = rows.groupBy("query_id", F.lower("name").alias("key")).agg(F.max("confidence").alias("confidence"))
    order = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "key")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def ideal_query(subspecialties: Column, procedures: Column, conditions: Column, keywords: Column, caps=(2, 3, 3, 5)) -> Column:
    """Query text of an ideal profile: the first few of each list."""
    return F.concat_ws(" ", *[F.array_join(F.slice(c, 1, n), " ") for c, n in zip((subspecialties, procedures, conditions, keywords), caps)])


def default_importance(value: Column) -> Column:
    return F.when(value.isin("required", "preferred", "optional"), value).otherwise(F.lit("preferred"))


def taxonomy_match(queries: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Entries (entry, names) that share a term with a query: a term of two characters or more contains a name or the reverse."""
    terms = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text"), least=2))).alias("term"))
    names = taxonomy.select("entry", F.explode("names").alias("name"))
    pairs = either_way(terms.select(F.col("term").alias("a")), names.select(F.col("name").alias("b"))).select(F.col("a").alias("term"), F.col("b").alias("name"))
    return terms.join(pairs, "term").join(names, "name").select("query_id", "entry").distinct()


def context(intents: Column, anchors: Column, safe: Column, patient: Column, variant: str = "parallel") -> Column:
    """Session context of a query, as a struct; variants differ in what enters the enriched query."""
    extra = {"algorithmic": [], "sequential": [intents], "parallel": [anchors], "parallel-v2": [anchors, F.slice(intents, 1, 12)], "goal": [F.slice(intents, 1, 20)]}[variant]
    return F.struct(patient.alias("q_patient"), safe.alias("safe_lane_terms"), intents.alias("intent_terms"), anchors.alias("anchor_phrases"), F.concat_ws(" ", patient, *[F.array_join(x, " ") for x in extra]).alias("enriched_query"))


def _named(items: Column, importance: str | None = None, most: int | None = None) -> Column:
    """Names of struct<name, importance>, of one importance if it is given, the first ``most``."""
    kept = F.filter(items, lambda x: x["importance"] == importance) if importance else items
    names = F.transform(F.slice(kept, 1, most) if most else kept, lambda x: x["name"])
    return F.coalesce(names, F.array().cast("array<string>"))


def ideal_sentence(ideal: Column) -> Column:
    """The query of an ideal profile: a sentence of what is required, then required, preferred and expertise terms.

    ideal: struct of subspecialties, procedures, conditions (arrays of struct<name,
    importance>) and areas.
    """
    areas = F.coalesce(F.slice(ideal["areas"], 1, 3), F.array().cast("array<string>"))
    joined = lambda c: F.array_join(_named(ideal[c], "required"), " and ")
    said = lambda text, before, after="": F.when(text != "", F.concat(F.lit(before), text, F.lit(after)))
    sentence = F.concat_ws(", ", said(joined("subspecialties"), "", " specialist"), said(joined("procedures"), "who performs "), said(joined("conditions"), "specializes in "), said(F.array_join(areas, ", "), "with expertise in "))
    terms = F.concat(*[_named(ideal[c], "required") for c in ("subspecialties", "procedures", "conditions")], _named(ideal["subspecialties"], "preferred", 2), _named(ideal["procedures"], "preferred", 3), areas)
    return F.trim(F.concat_ws(" ", F.nullif(sentence, F.lit("")), F.nullif(F.array_join(terms, " "), F.lit(""))))


def ideal_intents(ideal: Column) -> Column:
    """Intent terms of an ideal profile: its names in lower case and the words of its areas longer than three, each once."""
    low = lambda a: F.transform(F.filter(a, lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.lower(x))
    areas = F.coalesce(ideal["areas"], F.array().cast("array<string>"))
    words = F.filter(F.flatten(F.transform(areas, lambda a: F.split(F.lower(a), r"\s+"))), lambda w: F.length(w) > 3)
    return F.array_distinct(F.concat(*[low(_named(ideal[c])) for c in ("subspecialties", "procedures", "conditions")], words))


def ideal_anchors(ideal: Column, most: int = 5) -> Column:
    """Anchor phrases of an ideal profile: what it requires, procedures and conditions first."""
    return F.slice(F.concat(*[_named(ideal[c], "required") for c in ("procedures", "conditions", "subspecialties")]), 1, most)
