"""Reports on rankings and recommendations: why true documents were missed, which terms a context lacks, who was recommended."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from ..functions import text as T
from .analytics import TOGETHER, Within

# Fields that weigh much and little in a ranking.
HIGH_FIELDS = ("expertise_procedures", "expertise_conditions", "expertise_interests", "procedure_groups", "specialty", "subspecialties")
LOW_FIELDS = ("description", "about", "name")


def _counts(terms: list[list[str]], fields: tuple[str, ...]):
    """(__rows, __q, and lower-case texts, null ones empty) -> the rows, each with how many of its query's terms each text contains, and ``shared``.

    terms: those of each query; __q: the rows' queries, numbers within ``terms``.
    """
    needles, other = [], []
    for t in sorted({t for own in terms for t in own if t is not None}):
        (needles if re.fullmatch("[a-z0-9_]+", t) else other).append(t)
    number = {t: i for i, t in enumerate(needles + other)}
    asked = sorted(Counter((number[t], q) for q, own in enumerate(terms) for t in own if t is not None).items())
    heads = np.searchsorted(np.array([t for (t, _), _ in asked], np.int64), np.arange(len(number) + 1))
    size_of, query_of, times = np.diff(heads), np.array([q for (_, q), _ in asked], np.int64), np.array([n for _, n in asked], np.int64)
    letters = f"[a-z0-9_]{{{min(map(len, needles), default=1)},}}"  # shorter runs hold no needle

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within = Within(needles, letters)

        def by_query(found: list[list[int]]) -> np.ndarray:
            """For each document and query, how many of the query's terms are among those found."""
            each = np.array([x for own in found for x in own], np.int64)
            count = size_of[each]
            at = np.repeat(heads[each] - np.cumsum(count) + count, count) + np.arange(count.sum())
            document = np.repeat(np.repeat(np.arange(len(found)), [len(x) for x in found]), count)
            return np.bincount(document * len(terms) + query_of[at], times[at], len(found) * len(terms)).reshape(len(found), -1)

        for batch in batches:
            for part in (batch.slice(at, TOGETHER) for at in range(0, len(batch), TOGETHER)):
                rows, q = part["__rows"].flatten(), part["__q"].flatten().to_numpy()
                document = np.repeat(np.arange(len(part)), pc.list_value_length(part["__q"]).to_numpy())
                counts = {}
                for c in fields:
                    texts = part[f"__{c}"].to_pylist()
                    words = [within.words(x) for x in texts]
                    found = by_query([[*within.of(w), *(number[t] for t in other if t in x)] for w, x in zip(words, texts)])
                    counts[c] = pa.array(found[document, q].astype(np.int32))
                    if c == "text":
                        whole = by_query([[within.number[x] for x in w if x in within.number] for w in words])
                        counts["shared"] = pa.array(whole[document, q] > 0)
                made = [rows.field(i) for i in range(rows.type.num_fields)] + list(counts.values())
                yield pa.RecordBatch.from_arrays(made, names=[f.name for f in rows.type] + [c if c == "shared" else f"__{c}" for c in counts])

    return run


def overlaps(missed: DataFrame, queries: DataFrame, documents: DataFrame, high: tuple[str, ...] = HIGH_FIELDS, low: tuple[str, ...] = LOW_FIELDS, same: tuple[str, ...] = (), unknown: bool = True) -> DataFrame:
    """Adds ``overlap`` (query terms within the document's text), one count for each field, ``shared`` and ``dominant``: where matches are.

    missed: (query_id, doc_id, ...), the short list of what a ranking lacks; queries: (query_id,
    terms); documents: doc_id, text and the fields.  A term counts if it stands anywhere in
    the lower-case text, also within a longer word; ``shared`` is whether one is a whole word of it.
    Fields in ``same`` are the text itself.  Rows whose document is not there have counts of 0,
    or go (not ``unknown``).  The queries' terms are sent to the tasks, which look words up once for all
    queries of a document.
    """
    spark = missed.sparkSession
    asked = queries.select("query_id", "terms").toArrow().to_pylist()
    kind = queries.schema["query_id"].dataType.simpleString()
    coded = spark.createDataFrame([(r["query_id"], i) for i, r in enumerate(asked)], f"query_id {kind}, __n int")
    rows = missed.join(F.broadcast(coded), "query_id")
    # A document's rows are gathered before its text comes to them, so a text is shuffled once, however many queries lack it.
    gathered = rows.groupBy("doc_id").agg(F.collect_list(F.struct(F.struct(*missed.columns).alias("row"), "__n")).alias("__all"))
    fields = tuple(c for c in dict.fromkeys(("text", *high, *low)) if c not in same)
    texts = documents.select("doc_id", *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"__{c}") for c in fields])
    each = gathered.join(texts, "doc_id", "left" if unknown else "inner").select(F.col("__all")["row"].alias("__rows"), F.col("__all")["__n"].alias("__q"), *[F.coalesce(f"__{c}", F.lit("")).alias(f"__{c}") for c in fields])
    out = StructType([*missed.schema.fields, *[g for c in fields for g in ([StructField(f"__{c}", IntegerType())] + [StructField("shared", BooleanType())] * (c == "text"))]])
    made = each.mapInArrow(_counts([r["terms"] or [] for r in asked], fields), out)
    made = made.withColumns({f"overlap_{f}": F.col("__text" if f in same else f"__{f}") for f in (*high, *low)} | {"overlap": F.col("__text")})
    total = lambda fields: reduce(lambda a, b: a + b, (F.col(f"overlap_{f}") for f in fields), F.lit(0))
    dominant = F.when((total(high) > 0) & (total(low) > 0), "mixed").when(total(high) > 0, "high_only").when(total(low) > 0, "low_only").otherwise("none")
    return made.withColumn("dominant", dominant).select(*missed.columns, "overlap", *[f"overlap_{f}" for f in (*high, *low)], "shared", "dominant")


def _bucket(value: Column, edges: tuple[int, ...], start: int, missing: str) -> Column:
    """``a-b`` for each pair of neighbouring edges, ``c+`` beyond the last."""
    out, lo = F.lit(f"{edges[-1] + 1}+"), [start, *(e + 1 for e in edges[:-1])]
    for a, b in reversed(list(zip(lo, edges))):
        out = F.when(value <= b, F.lit(f"{a}-{b}")).otherwise(out)
    return F.when(value.isNull(), missing).otherwise(out)


def tendencies(rows: DataFrame, n: int = 100, edges: tuple[int, ...] | None = None) -> DataFrame:
    """(kind, bucket, n): counts of the missed by rank, by overlap and by dominant field, of ``overlaps`` of ``missing_picks`` at rank n."""
    edges = edges or ((150, 200, 300) if n <= 100 else (200, 300, 500))
    kinds = {"rank": _bucket(F.col("rank"), edges, n + 1, "none"), "overlap": _bucket(F.col("overlap"), (2, 4), 0, "none"), "dominant": F.col("dominant")}
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), b.alias("bucket")) for k, b in kinds.items()])).alias("x"))
    return each.groupBy("x.kind", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def weak_fields(rows: DataFrame, low: tuple[str, ...] = LOW_FIELDS) -> DataFrame:
    """One row: how many were missed, the mean gap to the score at the cut (of those that have a score), and for each weak field how many match in it and how often."""
    per = [f(F.col(f"overlap_{c}")).alias(f"{c}_{n}") for c in low for n, f in (("documents", lambda x: F.count_if(x > 0)), ("matches", F.sum))]
    return rows.agg(F.count(F.lit(1)).alias("missed"), F.round(F.avg(F.col("score_at") - F.col("score")), 6).alias("avg_gap"), *per)


def term_overlaps(wanted: DataFrame, said: DataFrame) -> DataFrame:
    """(query_id, terms), (query_id, terms) -> query_id, n_wanted, n_said, n_overlap, n_missing, missing (sorted, the first 30), overlap (the first 20).

    Terms count once; a query that nothing is said about lacks all its terms.
    """
    once = lambda c: F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))
    both = wanted.select("query_id", once(F.col("terms")).alias("w")).join(said.select("query_id", once(F.col("terms")).alias("s")), "query_id", "left").withColumn("s", once(F.col("s")))
    both = both.withColumn("missing", F.sort_array(F.array_except("w", "s"))).withColumn("overlap", F.sort_array(F.array_intersect("w", "s")))
    size = lambda c: F.size(c).cast("long")
    return both.select("query_id", size("w").alias("n_wanted"), size("s").alias("n_said"), size("overlap").alias("n_overlap"), size("missing").alias("n_missing"), F.slice("missing", 1, 30).alias("missing"), F.slice("overlap", 1, 20).alias("overlap"))


def missing_terms(wanted: DataFrame, said: DataFrame) -> DataFrame:
    """(term, n): in how many queries a wanted term is not said."""
    each = lambda df: df.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    return each(wanted).join(each(said), ["query_id", "term"], "left_anti").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def master_list(entries: DataFrame, contacts: DataFrame) -> DataFrame:
    """Everyone who was recommended, once: name_key, name, email, tally, location, title, phones, queries, places.

    entries: (seq, name, location, title, phone, query, places), in the order of ``seq``;
    contacts: (name_key, email).  Names are the same if they are without titles, case and
    spaces; nameless entries go.  The name as first written, the first location and title
    that are not empty, telephone numbers sorted, queries and places in the order in which
    they came first; null lists where there is nothing.  Most recommended first is left to the reader.
    """
    keyed = entries.withColumn("name_key", T.normalise_name(F.col("name"))).where("name_key <> ''")
    some = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("seq")))
    heads = keyed.groupBy("name_key").agg(F.min_by("name", "seq").alias("name"), F.count(F.lit(1)).alias("tally"), some("location").alias("location"), some("title").alias("title"))

    def first_seen(values: DataFrame, out: str) -> DataFrame:
        """(name_key, value, seq) -> the distinct values of each name by their first seq."""
        once = values.where("value is not null and value <> ''").groupBy("name_key", "value").agg(F.min("seq").alias("seq"))
        return once.groupBy("name_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]).alias(out))

    phones = keyed.where("phone <> ''").select("name_key", "phone").distinct().groupBy("name_key").agg(F.sort_array(F.collect_list("phone")).alias("phones"))
    queries = first_seen(keyed.select("name_key", F.col("query").alias("value"), F.struct("seq", F.lit(0).alias("i")).alias("seq")), "queries")
    places = first_seen(keyed.select("name_key", "seq", F.posexplode("places").alias("i", "value")).select("name_key", "value", F.struct("seq", "i").alias("seq")), "places")
    known = contacts.where("email <> ''").groupBy("name_key").agg(F.min("email").alias("email"))
    out = heads
    for more in (known, phones, queries, places):
        out = out.join(more, "name_key", "left")
    return out.select("name_key", "name", F.coalesce("email", F.lit("")).alias("email"), "tally", "location", "title", "phones", "queries", "places")


