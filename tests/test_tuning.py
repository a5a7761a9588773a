"""Tuning: a document is one row of the statistics, whatever asks for it, and tasks keep only their best."""

import random

import numpy as np
import pytest

from rankloom.config import RankingConfig
from rankloom.operators import index, tuning
from rankloom.operators.best import Best
from rankloom.operators.bm25 import bm25, ranked, repeats


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40))) if i % 9 else None, rng.choice(words)) for i in range(200)]
    docs += [(200 + i, "word1 word2", "word3") for i in range(60)]  # equal scores
    queries = [(i, " ".join(rng.choices(words + ["unheard"], k=6))) for i in range(20)] + [(20, "unheard"), (21, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, title string"), spark.createDataFrame(queries, "query_id long, text string")


def test_statistics_have_a_row_for_each_document(case):
    docs, queries = case
    for made in (index.build(docs, ["text", "title"]), tuning.occurrences(docs, ["text", "title"])):
        stats = tuning.statistics(made, queries)
        assert stats.rows.count() == docs.count()
        assert set(stats.of(queries.where("query_id < 3")).asked["query_id"].to_pylist()) == {0, 1, 2}


@pytest.mark.parametrize("together", [1, 1 << 19])
def test_configurations_without_an_index_equal_scoring_each(spark, case, together, monkeypatch):
    docs, queries = case
    monkeypatch.setattr(tuning, "TOGETHER", together)
    fields = ["text", "title"]
    configs = tuning.draws(spark, {"k1": (1.0, 2.0), "b": (0.5, 0.9), "text": (1.0, 3.0), "title": (0.3, 4.0)}, 3)
    stats = tuning.statistics(tuning.occurrences(docs, fields), queries)
    for asked, ids in ((stats, list(range(22))), (stats.of(queries.where("query_id % 5 = 2")), [2, 7, 12, 17])):
        got = {}
        for r in tuning.rank_configs(asked, configs, fields, 7).collect():
            got[r.config, r.query_id, r["rank"]] = (r.doc_id, round(r.score, 5))
        want = {}
        for c in configs.collect():
            scores = bm25(queries, docs, RankingConfig(k1=c.k1, b=c.b), repeats({"text": c.text, "title": c.title}))
            want |= {(c.config, r.query_id, r["rank"]): (r.doc_id, round(r.score, 5)) for r in ranked(scores, 7).collect() if r.query_id in ids}
        assert got == want


def test_nobody_asks(spark, case):
    docs, _ = case
    none = spark.createDataFrame([(1, "unheard"), (2, "")], "query_id long, text string")
    configs = tuning.draws(spark, {"k1": (1.0, 2.0), "b": (0.5, 0.9), "text": (1.0, 3.0)}, 2)
    for q in (none, none.limit(0), none.where("query_id = 2")):
        assert tuning.rank_configs(tuning.statistics(tuning.occurrences(docs, ["text"]), q), configs, ["text"]).count() == 0
    assert tuning.rank_configs(tuning.statistics(tuning.occurrences(docs.limit(0), ["text"]), none), configs, ["text"]).count() == 0


def test_best_of_each_key():
    rng = np.random.default_rng(3)
    key, score, ids = rng.integers(0, 5, 400), rng.integers(0, 4, 400) / 2, rng.permutation(400)
    best = Best(6, 4)
    for part in np.array_split(np.arange(400), 23):
        best.add(key[part], score[part], ids[part])
    got = sorted(zip(*(x.tolist() for x in best.rows())))
    want = [x for k in range(5) for x in sorted(zip(key.tolist(), ids.tolist(), score.tolist()), key=lambda x: (-x[2], x[1])) if x[0] == k]
    assert got == sorted(x for k in range(5) for x in [w for w in want if w[0] == k][:4])


def test_progressive_scores_once(spark, tmp_path):
    """The short list that all rounds read is made once, whatever is asked of the result."""
    from pyspark.sql import functions as F

    from rankloom.operators import fusion

    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    scores = spark.range(100).select((F.col("id") % 4).alias("query_id"), "id", F.col("id").cast("double").alias("score")).withColumnRenamed("id", "doc_id").mapInArrow(counting, "query_id long, doc_id long, score double")
    tiers = spark.range(100).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "excellent").otherwise("good").alias("tier"))
    assert fusion.progressive(scores, tiers).count() == 4 * 12
    assert seen.value == 100
