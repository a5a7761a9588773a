"""An index as a table: postings by field, kept beside each other document by document, and segments that are added to it.

A row is a document: its lengths and its postings, term by term and field by field.  The
rows are dealt into parts by their ids and written bucketed by part, so whatever is
summed over the terms of a document, or of a block of neighbouring documents, is summed
where the rows are read: pairs of queries and documents are never shuffled, only each
part's best.  Texts are read once, when a segment is made.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import RankingConfig
from ..functions import text as T
from ..staging import fresh_path, stage
from .bm25 import idf, query_terms, ranked

#: Documents of a block.  They have like lengths, so a block's greatest gains are near those of each; larger blocks rule
#: little out (share of pairs that is scored at sf0.1: 0.14 with blocks of four, 0.03 with blocks of two).
BLOCK = 2
#: A query's rarest terms are those before which fewer than so many documents per rank wanted hold a rarer one.
RARE = 20
ROW = "part int, number long, doc_id long, lengths array<int>, terms array<struct<term: string, field: int, n: int>>, gone boolean"


def _counted(tokens: str, starts: str, field: int) -> Column:
    """Array of struct<term, field, n> of sorted tokens, whose runs of equal ones begin at ``starts``."""
    s, a = F.col(tokens), F.col(starts)
    return F.transform(a, lambda at, k: F.struct(F.get(s, at).alias("term"), F.lit(field).alias("field"), (F.coalesce(F.get(a, k + 1), F.size(s)) - at).alias("n")))


def rows_of(documents: DataFrame, fields: list[str], tokenise=T.tokens) -> DataFrame:
    """(doc_id, fields) -> doc_id, lengths, terms: occurrences are counted within the row, without a shuffle."""
    sorted_ = documents.select("doc_id", *[F.sort_array(tokenise(F.col(c))).alias(f"s{i}") for i, c in enumerate(fields)])
    begin = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
    runs = sorted_.select("*", *[begin(F.col(f"s{i}")).alias(f"a{i}") for i in range(len(fields))])
    return runs.select("doc_id", F.array(*[F.size(f"s{i}") for i in range(len(fields))]).alias("lengths"), F.concat(*[_counted(f"s{i}", f"a{i}", i) for i in range(len(fields))]).alias("terms"))


def _parts(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows dealt into parts and numbered, neighbours within a part having like lengths."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.aggregate("lengths", F.lit(0), lambda a, x: a + x)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(4 * n)).cast("int")).repartition(n, "part").sortWithinPartitions("part", size, "doc_id")
    return dealt.withColumn("number", F.monotonically_increasing_id()), n


def _write(rows: DataFrame, path: str) -> None:
    dealt, n = _parts(rows)
    name = "rankloom_index_" + uuid.uuid4().hex
    dealt.select("part", "number", "doc_id", "lengths", "terms", "gone").write.bucketBy(n, "part").sortBy("part").option("path", path).saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")  # segments are read by their paths; an external table's files stay


def build(documents: DataFrame, fields: list[str] | None = None, tokenise=T.tokens) -> "Index":
    """The index of all rows of ``documents`` (doc_id, fields; ``text`` alone by default).

    Null texts have no terms but count as documents.  A doc_id comes once.  No rows: an
    empty index.
    """
    fields = fields or ["text"]
    spark = documents.sparkSession
    dealt, n = _parts(rows_of(documents, fields, tokenise).withColumn("gone", F.lit(False)))
    name = "rankloom_index_" + uuid.uuid4().hex
    dealt.select("part", "number", "doc_id", "lengths", "terms", "gone").write.bucketBy(n, "part").sortBy("part").option("path", fresh_path(spark, "index")).saveAsTable(name)
    return Index(spark.table(name), fields, name)


@dataclass
class Index:
    """Rows (part, number, doc_id, lengths, terms) and the names of their fields; numbers are dense within a part."""

    rows: DataFrame
    fields: list[str]
    table: str | None = None

    def forget(self) -> None:
        """Take the table's name out of the catalogue, where it is kept for its buckets; the files have the lifetime of the shared folder."""
        if self.table:
            self.rows.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")

    def _weights(self, weights: dict[str, int] | None) -> Column:
        return F.array(*[F.lit(int((weights or {}).get(f, 1))) for f in self.fields])

    def lengths(self, weights: dict[str, int] | None = None) -> DataFrame:
        """part, block (neighbours in the order of numbers), number, doc_id, dl (all terms, each field as often as its weight says), terms."""
        dl = F.aggregate(F.zip_with("lengths", self._weights(weights), lambda a, w: a * w), F.lit(0), lambda a, x: a + x)
        return self.rows.select("part", F.floor(F.col("number") / BLOCK).alias("block"), "number", "doc_id", dl.cast("long").alias("dl"), "terms")

    def postings(self, weights: dict[str, int] | None = None, wanted: DataFrame | None = None) -> DataFrame:
        """part, block, doc_id, dl, term, tf; of the terms of ``wanted`` (term) only, if it is given."""
        each = self.lengths(weights).select("part", "block", "doc_id", "dl", F.explode("terms").alias("x")).select("part", "block", "doc_id", "dl", "x.term", (F.col("x.n") * F.get(self._weights(weights), F.col("x.field"))).alias("n"))
        each = each.join(wanted.select("term").distinct(), "term", "left_semi") if wanted is not None else each
        if len(self.fields) == 1:
            return each.where("n > 0").select("part", "block", "doc_id", "dl", "term", F.col("n").cast("long").alias("tf"))
        return each.where("n > 0").groupBy("part", "block", "doc_id", "dl", "term").agg(F.sum("n").alias("tf"))

    def statistics(self, weights: dict[str, int] | None = None) -> DataFrame:
        """One row: n documents and their mean length (1 if it is 0)."""
        return self.lengths(weights).agg(F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.nullif(F.avg("dl"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))

    def asked(self, queries: DataFrame, config: RankingConfig, weights: dict[str, int] | None = None) -> DataFrame:
        """Written once, so that Spark knows how large it is: (query_id, term, weight, avgdl, df) of the queries' terms that the index has."""
        wanted = stage(query_terms(queries, config.variant == "mini"), "index-terms")
        df = self.postings(weights, wanted).groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
        stats = self.statistics(weights)
        rows = wanted.join(df, "term").join(F.broadcast(stats))  # one row
        return stage(rows.select("query_id", "term", (F.col("qtf") * idf(F.col("df"), F.col("n"), config.variant)).alias("weight"), "avgdl", "df"), "index-asked")

    def gains(self, asked: DataFrame, config: RankingConfig, weights: dict[str, int] | None = None) -> DataFrame:
        """part, block, query_id, doc_id, term, gain: what each term of ``asked`` adds to each score."""
        tf = F.col("tf").cast("double")
        gain = F.col("weight") * tf * (config.k1 + 1) / (tf + config.k1 * (1 - config.b + config.b * F.col("dl") / F.col("avgdl")))
        return self.postings(weights).join(asked, "term").select("part", "block", "query_id", "doc_id", "term", gain.alias("gain"))

    def scores(self, queries: DataFrame, config: RankingConfig = RankingConfig(), weights: dict[str, int] | None = None) -> DataFrame:
        """(query_id, doc_id, score) as ``bm25`` has them; summed part by part."""
        gains = self.gains(self.asked(queries, config, weights), config, weights)
        return gains.groupBy("part", "query_id", "doc_id").agg(F.round(F.sum("gain"), 6).alias("score")).select("query_id", "doc_id", "score")

    def floors(self, asked: DataFrame, config: RankingConfig, k: int, weights: dict[str, int] | None = None) -> DataFrame:
        """(query_id, floor): the k-th best score among the documents that hold a query's rarest terms, a score that the k best reach at least."""
        before = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
        rare = stage(asked.withColumn("before", F.coalesce(F.sum("df").over(before), F.lit(0.0))).where(F.col("before") < RARE * k).drop("before"), "index-rare")
        held = self.postings(weights).join(rare.select("query_id", "term"), "term").select("part", "block", "query_id", "doc_id").distinct()
        best = ranked(self.exact(held, asked, config, weights), k)
        return stage(best.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor")), "index-floors")

    def exact(self, pairs: DataFrame, asked: DataFrame, config: RankingConfig, weights: dict[str, int] | None = None) -> DataFrame:
        """Scores of ``pairs`` (part, block, query_id, doc_id) alone."""
        own = self.gains(asked, config, weights).join(pairs, ["part", "block", "query_id", "doc_id"], "left_semi")
        return own.groupBy("part", "query_id", "doc_id").agg(F.round(F.sum("gain"), 6).alias("score")).select("query_id", "doc_id", "score")

    def survivors(self, asked: DataFrame, floors: DataFrame, config: RankingConfig, weights: dict[str, int] | None = None) -> DataFrame:
        """(part, block, query_id): blocks whose terms' greatest gains add up to the query's floor; of queries without a floor, all."""
        bound = self.gains(asked, config, weights).groupBy("part", "block", "query_id", "term").agg(F.max("gain").alias("gain")).groupBy("part", "block", "query_id").agg(F.sum("gain").alias("bound"))
        # Scores are rounded to six places, sums differ in their last digits.
        return bound.join(floors, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") + 1e-5 >= F.col("floor"))).select("part", "block", "query_id")

    def topk(self, queries: DataFrame, k: int = 10, config: RankingConfig = RankingConfig(), weights: dict[str, int] | None = None) -> DataFrame:
        """The k best documents of every query, exactly: (query_id, doc_id, score, rank).

        Floors come from the rarest terms, blocks that cannot reach them are passed over,
        and only documents of the other blocks are scored, those below the floor left out.
        """
        asked = self.asked(queries, config, weights)
        # Written, so that Spark sees how few they are before it plans the join with the postings.
        kept = stage(self.survivors(asked, self.floors(asked, config, k, weights), config, weights), "index-survivors")
        gains = self.gains(asked, config, weights).join(kept, ["part", "block", "query_id"], "left_semi")
        scores = gains.groupBy("part", "query_id", "doc_id").agg(F.round(F.sum("gain"), 6).alias("score")).select("query_id", "doc_id", "score")
        return ranked(scores, k)

    def work(self, queries: DataFrame, k: int = 10, config: RankingConfig = RankingConfig(), weights: dict[str, int] | None = None) -> DataFrame:
        """One row: pairs that share a term, blocks of pairs, and the pairs and blocks that ``topk`` scores."""
        asked = self.asked(queries, config, weights)
        kept = self.survivors(asked, self.floors(asked, config, k, weights), config, weights).withColumn("kept", F.lit(1))
        pairs = self.gains(asked, config, weights).groupBy("part", "block", "query_id").agg(F.countDistinct("doc_id").alias("pairs"))
        return pairs.join(kept, ["part", "block", "query_id"], "left").agg(F.sum("pairs").alias("pairs"), F.sum(F.col("pairs") * F.coalesce("kept", F.lit(0))).alias("scored"), F.count(F.lit(1)).alias("blocks"), F.sum(F.coalesce("kept", F.lit(0))).alias("kept_blocks"))


class Segments:
    """An index that is kept: segments in a folder, each written once, and a manifest of those that count.

    A change writes its segment first and its line of the manifest last; until then, or if
    it fails, readers see the former state.  Of a document that several segments
    have, the last counts; a segment may say that documents are gone.
    """

    def __init__(self, spark: SparkSession, path: str, fields: list[str] | None = None, tokenise=T.tokens):
        self.spark, self.path, self.fields, self.tokenise = spark, path.rstrip("/"), fields or ["text"], tokenise

    def manifest(self) -> tuple[int, list[str]]:
        """The latest version and its segments, oldest first; (0, []) before the first."""
        lines = self.spark.read.schema("version long, segments array<string>").json(f"{self.path}/manifest").orderBy(F.desc("version")).limit(1).collect() if self._begun() else []
        return (lines[0]["version"], list(lines[0]["segments"])) if lines else (0, [])

    def _begun(self) -> bool:
        from pyspark.errors import AnalysisException

        try:
            self.spark.read.text(f"{self.path}/manifest").schema
        except AnalysisException:  # nothing there yet
            return False
        return True

    def _swap(self, version: int, segments: list[str]) -> None:
        self.spark.createDataFrame([(version, segments)], "version long, segments array<string>").coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def _add(self, rows: DataFrame, keep: list[str]) -> None:
        version, _ = self.manifest()
        name = f"segment-{version + 1}-{uuid.uuid4().hex[:8]}"
        _write(rows, f"{self.path}/{name}")
        self._swap(version + 1, [*keep, name])

    def upsert(self, documents: DataFrame) -> None:
        """New documents, and new versions of those that are there already; a doc_id comes once."""
        self._add(rows_of(documents, self.fields, self.tokenise).withColumn("gone", F.lit(False)), self.manifest()[1])

    def delete(self, ids: DataFrame) -> None:
        """Documents (doc_id) that are gone; unknown ids do not matter."""
        none = F.expr("cast(array() as array<struct<term: string, field: int, n: int>>)")
        self._add(ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr("cast(array() as array<int>)").alias("lengths"), none.alias("terms"), F.lit(True).alias("gone")), self.manifest()[1])

    def merge(self) -> None:
        """One segment of the documents that count."""
        self._add(self.open().rows.select("doc_id", "lengths", "terms", F.lit(False).alias("gone")), [])

    def open(self) -> Index:
        """The index of the documents that count now."""
        parts = [(i, self.spark.read.schema(ROW).parquet(f"{self.path}/{s}")) for i, s in enumerate(self.manifest()[1])]
        out, later = None, None
        for i, rows in reversed(parts):
            live = rows.withColumn("number", F.col("number") + F.lit(i % 8192 << 50))  # numbers of segments are told apart
            live = live if later is None else live.join(later, "doc_id", "left_anti")
            out = live if out is None else out.unionByName(live)
            ids = rows.select("doc_id")
            later = ids if later is None else later.unionByName(ids)
        out = out if out is not None else self.spark.createDataFrame([], ROW)
        return Index(out.where("not gone").drop("gone"), self.fields)
