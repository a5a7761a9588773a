"""Readers and writers as registered queries: each writes files into the shared folder and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import readers as RD
from .base import Book, shared_dir, table, view

BOOK = Book()
add = BOOK.add
L = lambda s: F.lit(s)
RECORD = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())])


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/files/{name}-{uuid.uuid4().hex}"


@add("csv_scan", """SELECT c_custkey::VARCHAR AS id, c_name || ' "x", ' || c_mktsegment || chr(10) || 'end' AS name FROM customer WHERE c_custkey % 3 <> 0""")
def _(spark, sf):
    path, k = folder(spark, "csv"), F.col("c_custkey")
    name = F.concat("c_name", L(' "x", '), "c_mktsegment", L("\nend"))
    RD.write_csv(table(spark, sf, "customer").select(F.when(k % 3 != 0, k.cast("string")).alias("id"), F.when(k % 3 != 0, name).alias("name")), path)
    return RD.csv_records(spark, path, RECORD, ["id", "name"])


@add("json_scan", "SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer")
def _(spark, sf):
    path, k = folder(spark, "json"), F.col("part")
    rows = table(spark, sf, "customer").select((F.col("c_custkey") % 6).alias("part"), RD.as_json(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name")).alias("r"))
    listed = rows.groupBy("part").agg(F.concat(L("["), F.array_join(F.collect_list("r"), ","), L("]")).alias("a"))
    wrapped = F.when(k < 2, F.col("a")).when(k < 4, F.concat(L('{"total": 1, "records": '), "a", L("}"))).otherwise(F.concat(L('{"profiles": '), "a", L("}")))
    listed.select("part", wrapped.alias("value")).repartition("part").write.partitionBy("part").text(path)
    return RD.json_records(spark, path, RECORD).select("id", "name")


@add("json_stream_scan", """SELECT c_custkey::VARCHAR AS id, '}"{' || c_name || chr(92) || '"]' || chr(10) || c_mktsegment AS name FROM customer""")
def _(spark, sf):
    path, k = folder(spark, "stream"), F.col("c_custkey")
    name = F.concat(L('}"{'), "c_name", L('\\"]\n'), "c_mktsegment")
    # One array over the lines of one file: a first line, one for each record, a last line.
    rows = table(spark, sf, "customer").select(k.alias("place"), F.concat(F.when(k == F.lit(0), "").otherwise(","), RD.as_json(k.cast("string").alias("id"), F.struct(F.array(name).alias("all")).alias("more"), name.alias("name"))).alias("value"))
    ends = spark.createDataFrame([(-1, '{"total_records": 3, "by": {"who": "x]"}, "records": [{"id": null, "name": "none"}'), (1 << 62, "]}")], "place long, value string")
    rows.unionByName(ends).repartition(1).sortWithinPartitions("place").select("value").write.text(path)
    return RD.json_stream(spark, path, RECORD).where("id is not null").select("id", "name")


@add("json_lines_scan", "SELECT s_suppkey::VARCHAR AS id, s_name AS name FROM supplier")
def _(spark, sf):
    path = folder(spark, "lines")
    RD.write_json(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name")), path)
    return RD.json_lines(spark, path, RECORD)


@add("chat_files_scan", "SELECT 'conv=' || conv_id::VARCHAR AS session, md5(string_agg(replace(coalesce(text, ''), chr(10), ' ') || chr(10), '' ORDER BY turn, role)) AS digest FROM conversations GROUP BY conv_id")
def _(spark, sf):
    path = folder(spark, "chats")
    said = table(spark, sf, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", F.regexp_replace(F.coalesce("text", L("")), "\n", " ").alias("value"))
    said.repartition("conv").sortWithinPartitions("conv", "turn", "role").select("conv", "value").write.partitionBy("conv").text(path)
    return RD.chats(spark, path).where(F.col("session").startswith("conv=")).select("session", F.md5(F.col("text").cast("binary")).alias("digest"))


#: Lines of a bank of questions: whole texts, some in quotes, with headings, markers and short lines between them.
LINES = """SELECT item_id, 0 AS k, concat(CASE item_id % 3 WHEN 0 THEN '"' WHEN 1 THEN '“' ELSE '' END, replace(coalesce(text, ''), chr(10), ' '), CASE item_id % 3 WHEN 0 THEN '"' WHEN 1 THEN '”' ELSE '' END) AS value FROM benchmark
UNION ALL SELECT item_id, 1, CASE item_id % 4 WHEN 0 THEN 'Practical, intent-heavy' WHEN 1 THEN 'Gastroenterology hepatobiliary medicine services' WHEN 2 THEN 'too short a line' ELSE '' END FROM benchmark"""


@add("question_bank", f"""WITH l AS ({LINES}), q AS (SELECT item_id, k, trim(CASE WHEN k = 0 AND item_id % 3 < 2 THEN value[2:-2] ELSE value END) AS question FROM l)
SELECT n::INT AS n, question FROM (SELECT question, row_number() OVER (ORDER BY item_id, k) AS n FROM q WHERE len(question) >= 30 AND NOT (k = 1 AND item_id % 4 IN (0, 1))) WHERE n <= 20""")
def _(spark, sf):
    path = folder(spark, "questions")
    view(spark, sf, LINES).repartition(1).sortWithinPartitions("item_id", "k").select("value").write.text(path)
    return RD.questions(spark, path).select("n", "question")


@add("lookup_scan", "SELECT 'D' || n_nationkey::VARCHAR AS district, 499e-1 + n_nationkey AS lat, n_regionkey::DOUBLE AS lon FROM nation")
def _(spark, sf):
    path = folder(spark, "lookup")
    place = F.struct((F.col("n_nationkey") + 49.9).alias("lat"), F.col("n_regionkey").cast("double").alias("lon"))
    whole = table(spark, sf, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(L("D"), F.col("n_nationkey").cast("string")), place)))).alias("value"))
    whole.coalesce(1).write.text(path)
    return RD.lookup(spark, path, T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]), "district")


@add("append_log", "SELECT event_id, user_id FROM events")
def _(spark, sf):
    path, events = folder(spark, "log"), table(spark, sf, "events").select("event_id", "user_id")
    for part in (0, 1):
        RD.append(events.where(F.col("event_id") % 2 == part), path)
    return spark.read.schema(events.schema).parquet(path)


@add("canonical_profiles", "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 6 = 0 THEN 'b' WHEN c_custkey % 3 = 0 THEN 'c' WHEN c_custkey % 2 = 0 THEN 'a' END || (c_custkey // 6)::VARCHAR AS checklist FROM customer")
def _(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    name = lambda letter: F.concat(L(letter), F.floor(k / 6).cast("string"))
    rows = [c.where(cond).select(F.concat(L(letter), k.cast("string")).alias("canonical_id"), F.array(k).alias("legacy_ids"), name(letter).alias("checklist"), L(seq).alias("seq")) for letter, seq, cond in (("a", 1, k % 2 == 0), ("b", 3, k % 6 == 0), ("c", 2, k % 3 == 0))]
    canonical = rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("legacy_ids", F.transform("legacy_ids", lambda x: x.cast("string")))
    return RD.profiles_with_canonical(c.select(k.cast("string").alias("doc_id")), canonical).select(F.col("doc_id").cast("long").alias("doc_id"), "checklist")
