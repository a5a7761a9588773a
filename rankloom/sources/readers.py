"""Readers and writers for the formats that profiles, questions and chats come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_quotes
from ..staging import stage

WRAPPERS = ("records", "practitioners", "dietitians", "profiles")


def json_records(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """Records of JSON files that hold an array, or an object with the array under one of WRAPPERS.

    The file is read as text and parsed against the record's schema, so nothing is
    inferred.  A file is one row of one task; ``json_stream`` reads large ones in splits.
    """
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    rows = T.ArrayType(record)
    wrapped = T.StructType([T.StructField(w, rows) for w in WRAPPERS])
    inside = F.from_json("v", wrapped)
    either = F.when(F.col("v").startswith("["), F.from_json("v", rows)).otherwise(F.coalesce(*[inside[w] for w in WRAPPERS]))
    return whole.select(F.explode(either).alias("r")).select("r.*")


def json_lines(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    return spark.read.schema(record).json(path)


def csv_records(spark: SparkSession, path: str, schema: T.StructType, key: list[str]) -> DataFrame:
    """Quoted, multi-line CSV; short rows are padded, long ones cut; rows with none of the key columns go."""
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    return rows.where(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in key]).isNotNull())


def questions(spark: SparkSession, path: str, most: int = 20) -> DataFrame:
    """specialty (from the file's name), n and question: one per line, wrapping quotes stripped, the first ``most``.

    Lines under 30 characters, marker lines and headings of up to four plain words are left out.
    """
    lines = spark.read.text(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1).alias("specialty"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), strip_quotes(F.col("value")).alias("question"),
    )
    q = F.col("question")
    marker = q.rlike(r"(?i)^[\"']?practical,?\s+intent-heavy[\"']?$")
    heading = q.rlike(r"(?i)^[\"']?[a-z\s&-]+[\"']?$") & (F.size(F.split(q, r"\s+")) <= 4)
    first = Window.partitionBy("specialty").orderBy("block", "line")
    return lines.where((F.length(q) >= 30) & ~marker & ~heading).withColumn("n", F.row_number().over(first)).where(F.col("n") <= most).select("specialty", "n", "question")


def chats(spark: SparkSession, path: str) -> DataFrame:
    """session (the directory) and text of every chat file below a path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("session"), F.col("value").alias("text"))


def profiles_with_canonical(profiles: DataFrame, canonical: DataFrame, order: str = "seq") -> DataFrame:
    """Left join with canonical rows (canonical_id, legacy_ids, checklist) on any legacy id, or on the canonical id where it is no one's legacy id.

    Of rows that claim the same id, the last by ``order`` wins, then the last in its list.
    """
    ids = canonical.select(F.posexplode("legacy_ids").alias("pos", "doc_id"), "canonical_id", "checklist", order, F.lit(1).alias("kind"))
    own = canonical.select(F.lit(-1).alias("pos"), F.col("canonical_id").alias("doc_id"), "canonical_id", "checklist", order, F.lit(0).alias("kind"))
    last = ids.unionByName(own).groupBy("doc_id").agg(F.max_by(F.struct("canonical_id", "checklist"), F.struct("kind", order, "pos")).alias("c"))
    return profiles.join(last, "doc_id", "left").select(profiles["*"], "c.canonical_id", "c.checklist")


def lookup(spark: SparkSession, path: str, value: T.DataType = T.StringType(), key: str = "key") -> DataFrame:
    """(key, value) of JSON files that hold one object used as a table: aliases, centroids, lexicons."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", T.MapType(T.StringType(), value))).alias(key, "v"))
    return rows.select(key, "v.*") if isinstance(value, T.StructType) else rows.withColumnRenamed("v", "value")


def _running(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before, in the order of split and place, file by file.

    Only the totals of the splits meet file by file; a window stays within one split.
    """
    totals = rows.groupBy("file", "split").agg(F.sum(value).alias("t"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", "split", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "split").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(bases, ["file", "split"]).withColumn(out, F.col(out) + F.col("base")).drop("base")


def json_stream(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """Records of JSON files of any size: an array, or an object with the array under one of WRAPPERS (and no other array of objects beside it).

    A file is read in splits, cut behind every closing brace.  Whether a piece begins
    within a string is told by the parity of all quotes before it, how deep it lies by
    the braces and brackets outside strings, which record it belongs to by the records that
    have ended: three prefix sums over splits.  Pieces of a record meet wherever the splits
    cut it.  A file of one line splits as well as one of many.
    """
    read = spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), "value")
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    count = lambda c, chars: (F.length(c) - F.length(F.translate(c, chars, ""))).cast("long")
    pieces = _running(stage(read.withColumn("quotes", count(bare, '"')), "json-pieces"), "quotes", "before")
    within = F.col("before") % 2 == 1
    outside = F.regexp_replace(F.regexp_replace(F.concat(F.when(within, '"').otherwise(""), bare), r'"[^"]*"', ""), r'(?s)".*\z', "")
    closed = (F.col("before") + F.col("quotes")) % 2 == 0  # the brace behind the piece is outside strings
    pieces = pieces.withColumn("outside", outside).withColumn("closed", closed).withColumn("step", count(F.col("outside"), "{[") - count(F.col("outside"), "}]") - F.when(F.col("closed"), 1).otherwise(0))
    pieces = _running(pieces.drop("outside"), "step", "depth").withColumn("depth", F.col("depth") + F.col("step"))
    first = pieces.groupBy("file").agg(F.min_by("value", F.struct("split", "place")).alias("head")).select("file", F.when(F.col("head").rlike(r"^[\s\uFEFF]*\["), 1).otherwise(2).alias("level"))
    ends = pieces.join(F.broadcast(first), "file").withColumn("end", F.when(F.col("closed") & (F.col("depth") == F.col("level")), 1).otherwise(0))  # one row for each file
    numbered = _running(ends, "end", "number")
    whole = numbered.groupBy("file", "number").agg(F.max("end").alias("ended"), F.sort_array(F.collect_list(F.struct("split", "place", "value"))).alias("p")).where("ended = 1")
    text = F.array_join(F.transform("p", lambda x: F.concat(x["value"], F.lit("}"))), "")
    opening = rf'(?s)^[\s\uFEFF]*(?:\[|\{{.*?"(?:{"|".join(WRAPPERS)})"\s*:\s*\[(?=\s*\{{))'
    text = F.when(F.col("number") == 0, F.regexp_replace(text, opening, "")).otherwise(F.regexp_replace(text, r"^\s*,", ""))
    return whole.select(F.from_json(text, record).alias("r")).select("r.*")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with doubled quotes."""
    df.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def as_json(*columns) -> Column:
    return F.to_json(F.struct(*columns))


def append(df: DataFrame, path: str) -> None:
    """Atomic append: Spark's commit protocol makes the rows visible together."""
    df.write.mode("append").parquet(path)
