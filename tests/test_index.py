"""The index as a table, against rankings of a corpus as it is."""

import re

import pytest
from pyspark.sql import functions as F

from rankloom.config import RankingConfig
from rankloom.operators import index, shortlist
from rankloom.operators.bm25 import bm25, ranked

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect())


def test_topk_equals_the_whole_ranking_and_scores_a_tenth_of_the_pairs(spark, queries):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    built = index.build(docs)
    assert rows(built.topk(queries, 10)) == rows(ranked(bm25(queries, docs), 10))
    work = built.work(queries, 10).first()
    assert 0 < work.scored <= work.pairs / 10


def test_pairs_are_not_shuffled(spark, corpus, queries):
    plan = ranked(index.build(corpus).scores(queries), 10)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange \w+\(([^)]*)\)", plan.split("Initial Plan")[0])
    assert exchanges and all("doc_id" not in e for e in exchanges)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "knee surgery knee"), (2, None), (3, ""), (4, "hip"), (5, "ab")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "knee hip hip"), (2, None), (3, "unknown words")], "query_id long, text string")
    built = index.build(docs)
    for k in (1, 3):
        for variant in ("production", "local", "mini"):
            config = RankingConfig(variant=variant)
            assert rows(built.topk(queries, k, config)) == rows(ranked(bm25(queries, docs, config), k))
    assert index.build(docs.limit(0)).topk(queries, 3).count() == 0 == built.topk(queries.limit(0), 3).count()


def test_fields_and_weights(spark, queries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    asked = queries.withColumn("text", F.concat("text", F.lit(" src1 src7 en")))
    built = index.build(docs, ["text", "lang", "source"])
    for weights in ({"text": 1, "lang": 3, "source": 2}, {"text": 2, "lang": 0, "source": 5}):
        assert rows(built.topk(asked, 10, weights=weights)) == rows(ranked(bm25(asked, docs, fields=weights), 10))


def test_segments_rank_like_an_index_built_afresh(spark, corpus, queries, tmp_path):
    store = index.Segments(spark, str(tmp_path / "store"))
    assert store.open().topk(queries, 5).count() == 0
    store.upsert(corpus.where("doc_id < 120"))
    store.upsert(corpus.where("doc_id >= 100").withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.reverse("text")).otherwise(F.col("text"))))
    store.delete(corpus.where("doc_id % 7 = 0").select("doc_id"))
    store.upsert(corpus.where("doc_id % 14 = 0"))
    now = corpus.withColumn("text", F.when((F.col("doc_id") >= 100) & (F.col("doc_id") % 2 == 0) & (F.col("doc_id") % 14 != 0), F.reverse("text")).otherwise(F.col("text"))).where("doc_id % 7 <> 0 or doc_id % 14 = 0")
    want = rows(ranked(bm25(queries, now), 8))
    assert rows(ranked(store.open().scores(queries), 8)) == want and rows(store.open().topk(queries, 8)) == want
    version, segments = store.manifest()
    assert (version, len(segments)) == (4, 4)
    store.merge()
    assert store.manifest()[0] == 5 and len(store.manifest()[1]) == 1
    assert rows(store.open().topk(queries, 8)) == want


def test_a_failed_writer_leaves_the_former_state(spark, corpus, queries, tmp_path):
    store = index.Segments(spark, str(tmp_path / "store"))
    store.upsert(corpus)
    before = rows(store.open().topk(queries, 3))
    bad = corpus.withColumn("text", F.when(F.col("doc_id") == 5, F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        store.upsert(bad)
    assert store.manifest()[0] == 1 and rows(store.open().topk(queries, 3)) == before


def test_no_text_is_shuffled_by_the_production_ranker(spark, corpus, queries):
    signals = corpus.select("doc_id", F.lit(1.0).alias("quality"), F.lit(1.0).alias("proximity"), F.lit(0.5).alias("semantic"))
    df = shortlist._with_bonus(queries, corpus, signals, RankingConfig(), None, 3)  # what is written once and then scaled
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    inputs = re.findall(r"\(\d+\) (?:BroadcastExchange|Exchange)\n(?:Input \[\d+\]: \[([^\]]*)\])", plan)
    assert inputs
    for columns in inputs:
        assert not {c.split("#")[0].strip() for c in columns.split(",")} & {"text", "body", "w", "terms", "s0"}
