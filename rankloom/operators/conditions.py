"""A filter of its own for every query: conditions as a table, attribute lists as bitmaps, and BM25 over what each query may see."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RankingConfig
from ..staging import stage
from .bm25 import idf, query_terms
from .containment import either_way
from .filters import CHILD_WORDS
from .index import Index

#: How a condition's value meets an attribute's, both trimmed and in lower case: as it is; one containing the other; or that, and any that speaks of
#: children for a value that does.
EQUALS, EITHER_WAY, AGE = "equals", "either_way", "age"


def _key(value: Column) -> Column:
    return F.lower(F.trim(value))


def _held(bits: Column, position: Column) -> Column:
    """Whether a bitmap has the bit at a position."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.shiftright(byte, 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (position % 8 + 1).cast("int"))) != 0


class Catalogue:
    """The attributes of an index's documents as inverted lists: for each value a bitmap in every block of 32,768 documents."""

    def __init__(self, index: Index, attributes: DataFrame):
        """attributes: (doc_id, attribute, value), as many rows as there are values; null values are none, unknown ids do not matter."""
        self.index = index
        numbers = index.rows.select("doc_id", "number")
        known = attributes.where("value is not null").select("doc_id", "attribute", _key(F.col("value")).alias("value"))
        placed = known.join(numbers, "doc_id").select("attribute", "value", F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("position"))
        self.lists = stage(placed.groupBy("attribute", "value", "bucket").agg(F.bitmap_construct_agg("position").alias("bits")), "attribute-lists")
        self.every = numbers.select(F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("position")).groupBy("bucket").agg(F.bitmap_construct_agg("position").alias("bits"))

    def matched(self, conditions: DataFrame) -> DataFrame:
        """(attribute, how, wanted) of the conditions with every ``value`` of the attribute that meets it."""
        wanted = conditions.select("attribute", "how", _key(F.col("value")).alias("wanted")).distinct()
        values = self.lists.select("attribute", "value").distinct()
        speaks = lambda c: reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in CHILD_WORDS))
        same = wanted.join(values, (wanted["attribute"] == values["attribute"]) & (F.col("wanted") == F.col("value"))).select(wanted["attribute"], "how", "wanted", "value")
        loose = wanted.where(F.col("how").isin(EITHER_WAY, AGE))
        pairs = either_way(loose.select(F.col("wanted").alias("a")), values.select(F.col("value").alias("b"))).select(F.col("a").alias("wanted"), F.col("b").alias("value"))
        near = loose.join(pairs, "wanted").join(values, ["attribute", "value"]).select("attribute", "how", "wanted", "value")
        children = loose.where((F.col("how") == AGE) & speaks(F.col("wanted"))).join(values.where(speaks(F.col("value"))), "attribute").select("attribute", "how", "wanted", "value")
        return same.unionByName(near).unionByName(children).distinct()

    def filters(self, queries: DataFrame, conditions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query_id, filter_id) of all queries, and (filter_id, bucket, bits): what each filter lets through.

        conditions: (query_id, attribute, how, value).  Several values for one attribute are
        alternatives, attributes must all be met; a query without conditions sees all.
        Queries that ask for the same share a filter.
        """
        asked = conditions.where("value is not null").select("query_id", "attribute", "how", _key(F.col("value")).alias("wanted")).distinct()
        named = asked.groupBy("query_id").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("attribute", "how", "wanted"))), lambda x: F.to_json(x)), "\n").cast("binary")).alias("filter_id"))
        of_query = stage(queries.select("query_id").distinct().join(named, "query_id", "left").select("query_id", F.coalesce("filter_id", F.lit("all")).alias("filter_id")), "query-filters")
        parts = asked.join(of_query, "query_id").select("filter_id", "attribute", "how", "wanted").distinct()
        each = parts.groupBy("filter_id").agg(F.countDistinct("attribute").alias("n"))
        met = parts.join(self.matched(conditions), ["attribute", "how", "wanted"]).select("filter_id", "attribute", "value").distinct()
        some = met.join(self.lists, ["attribute", "value"]).groupBy("filter_id", "attribute", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        both = some.groupBy("filter_id", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("met")).join(each, "filter_id").where("met = n").select("filter_id", "bucket", "bits")
        free = of_query.where("filter_id = 'all'").select("filter_id").distinct().join(self.every)  # one row, if any query has no condition
        return of_query, stage(both.unionByName(free).where(F.bitmap_count("bits") > 0), "filter-bitmaps")

    def seen(self, bitmaps: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
        """The index's documents (part, doc_id, dl, terms) with ``allowed``, the filters that let them through; those without any are left out."""
        sets = bitmaps.groupBy("bucket").agg(F.collect_list(F.struct("filter_id", "bits")).alias("sets"))
        rows = self.index.lengths(weights).withColumn("bucket", F.bitmap_bucket_number("number")).join(sets, "bucket")
        position = F.bitmap_bit_position("number")
        allowed = F.transform(F.filter("sets", lambda s: _held(s["bits"], position)), lambda s: s["filter_id"])
        return rows.select("part", "doc_id", "dl", "terms", allowed.alias("allowed")).where(F.size("allowed") > 0)

    def scores(self, queries: DataFrame, conditions: DataFrame, config: RankingConfig = RankingConfig(), weights: dict[str, int] | None = None) -> DataFrame:
        """(query_id, doc_id, score): BM25 of every query over the documents that its conditions let through.

        Number and mean length of documents and document frequencies are those of each
        filter's own documents, as if the corpus had been filtered first.
        """
        of_query, bitmaps = self.filters(queries, conditions)
        wanted = stage(query_terms(queries, config.variant == "mini").join(of_query, "query_id"), "filtered-terms")
        seen = self.seen(bitmaps, weights)
        stats = seen.select("dl", F.explode("allowed").alias("filter_id")).groupBy("filter_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.nullif(F.avg("dl"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))
        w = self.index._weights(weights)
        each = seen.select("part", "doc_id", "dl", "allowed", F.explode("terms").alias("x")).select("part", "doc_id", "dl", "allowed", "x.term", (F.col("x.n") * F.get(w, F.col("x.field"))).cast("long").alias("tf")).where("tf > 0")
        if len(self.index.fields) > 1:
            each = each.groupBy("part", "doc_id", "dl", "term").agg(F.first("allowed").alias("allowed"), F.sum("tf").alias("tf"))
        terms = wanted.select("filter_id", "term").distinct()
        df = each.join(terms, "term").where(F.array_contains("allowed", F.col("filter_id"))).groupBy("filter_id", "term").agg(F.count(F.lit(1)).cast("double").alias("df"))
        weighed = df.join(stats, "filter_id").select("filter_id", "term", "avgdl", idf(F.col("df"), F.col("n"), config.variant).alias("idf"))
        asked = stage(wanted.join(weighed, ["filter_id", "term"]).select("query_id", "filter_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "avgdl"), "filtered-asked")
        hits = each.join(asked, "term").where(F.array_contains("allowed", F.col("filter_id")))
        tf = F.col("tf").cast("double")
        gain = F.col("weight") * tf * (config.k1 + 1) / (tf + config.k1 * (1 - config.b + config.b * F.col("dl") / F.col("avgdl")))
        return hits.groupBy("part", "query_id", "doc_id").agg(F.round(F.sum(gain), 6).alias("score")).select("query_id", "doc_id", "score")


def passed(queries: DataFrame, conditions: DataFrame, catalogue: Catalogue) -> DataFrame:
    """(query_id, n): how many documents each query may see."""
    of_query, bitmaps = catalogue.filters(queries, conditions)
    counts = bitmaps.groupBy("filter_id").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    return of_query.join(counts, "filter_id", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
