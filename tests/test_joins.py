"""Best matches of a day, quantiles, filters for each query, the evaluator's loop and providers, against plain versions."""

import json
import random
import statistics as st

import pytest
from pyspark.sql import functions as F

from rankloom.operators import conditions, fusion, index, progressive, providers, quantiles, sessions, tuning
from rankloom.operators.bm25 import bm25, ranked


def test_best_match_of_a_day_equals_comparing_all(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    pick = lambda: sorted(set(rng.choices(words, weights=[1 / (i + 1) for i in range(40)], k=rng.randint(0, 12))))
    left, right = [(i, i % 3, pick()) for i in range(60)], [(i, i % 3 if i % 9 else None, pick()) for i in range(90)]
    right += [(1000 + i, 1, right[1][2]) for i in range(40)]  # many equal ones, on a hot day
    want = {}
    for i, day, a in left:
        found = []
        for j, other, b in right:
            if day == other and a and b:
                s = round(len(set(a) & set(b)) / len(set(a) | set(b)), 6)
                if s >= 0.08:
                    found.append((-s, j))
        if found:
            want[i] = (min(found)[1], -min(found)[0])
    frames = spark.createDataFrame(left, "left_id int, day int, a array<string>"), spark.createDataFrame(right, "right_id int, day int, b array<string>")
    assert {r.left_id: (r.right_id, r.similarity) for r in sessions.best_same_day(*frames).collect()} == want


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_order_statistics_are_exact(spark, accuracy):
    rng = random.Random(9)
    groups = {"a": [rng.gauss(0, 1) for _ in range(3001)], "b": [float(rng.randint(0, 4)) for _ in range(2000)], "c": [7.0], "d": [1.0, 2.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)], "grp string, value double")
    sizes = rows.groupBy("grp").agg(F.count("value").alias("n"))
    wanted = [(g, f"{at}", at) for g, vs in groups.items() for at in {0, len(vs) // 4, len(vs) // 2, len(vs) - 1}]
    got = quantiles.order_statistics(rows, spark.createDataFrame(wanted, "grp string, name string, at long"), sizes, accuracy).collect()
    assert {(r.grp, r.name): r.x for r in got} == {(g, n): sorted(groups[g])[at] for g, n, at in wanted}


def test_study_statistics(spark):
    groups = {"a": [float(x % 17) for x in range(200)], "b": [5.0], "c": [1.0, 2.0, 2.0, 9.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("c", None), ("z", None)], "grp string, value double")
    got = {r.grp: r for r in quantiles.study_statistics(rows).collect()}
    for g, vs in groups.items():
        best = [v for v in vs if sum(o > v for o in vs) <= 0.25 * (len(vs) - 1)]
        worst = [v for v in vs if sum(o < v for o in vs) <= 0.25 * (len(vs) - 1)]
        r = got[g]
        assert (r.n, r.median, r.least, r.most) == (len(vs) + (g == "c"), st.median(vs), min(vs), max(vs))
        assert r.mean == pytest.approx(st.mean(vs)) and r.top == pytest.approx(st.mean(best)) and r.bottom == pytest.approx(st.mean(worst))
        assert (r.sd is None) == (len(vs) == 1) and (r.sd is None or r.sd == pytest.approx(st.stdev(vs)))
    assert (got["z"].n, got["z"].mean, got["z"].median, got["z"].top) == (1, None, None, None)
    assert "Window" not in quantiles.study_statistics(rows)._jdf.queryExecution().executedPlan().toString()


DOCS = [(i, f"knee surgery {'hip' if i % 2 else 'hand'} {'word ' * (i % 5)}") for i in range(40)] + [(40, None)]


def test_every_query_has_a_corpus_of_its_own(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    offers = [(i, "insurer", v) for i in range(41) for v in (["Big Health Ltd", "Axo"] if i % 3 == 0 else ["axo "] if i % 3 == 1 else [])] + [(i, "group", "Paediatrics" if i % 4 == 0 else "Adults") for i in range(41)] + [(99, "insurer", "axo"), (1, "insurer", None)]
    asks = [(1, "insurer", "either_way", " big health "), (2, "insurer", "equals", "AXO"), (2, "group", "age", "young children"), (3, "insurer", "equals", "nobody"), (4, "group", "equals", "adults"), (4, "group", "equals", "paediatrics"), (5, "group", "equals", None), (7, "insurer", "either_way", "big health")]
    queries = spark.createDataFrame([(q, "hip surgery word word") for q in range(1, 8)], "query_id long, text string")
    allowed = {1: lambda i: i % 3 == 0, 2: lambda i: i % 3 in (0, 1) and i % 4 == 0, 3: lambda i: False, 4: lambda i: True, 5: lambda i: True, 6: lambda i: True, 7: lambda i: i % 3 == 0}
    catalogue = conditions.Catalogue(index.build(docs), spark.createDataFrame(offers, "doc_id long, attribute string, value string"))
    asked = spark.createDataFrame(asks, "query_id long, attribute string, how string, value string")
    got = {(r.query_id, r.doc_id): r.score for r in catalogue.scores(queries, asked).collect()}
    want = {}
    for q, f in allowed.items():
        part = docs.where(F.col("doc_id").isin([i for i, _ in DOCS if f(i)]))
        want |= {(r.query_id, r.doc_id): r.score for r in bm25(queries.where(F.col("query_id") == q), part).collect()}
    assert got == want and len(got) > 100
    assert {r.query_id: r.n for r in conditions.passed(queries, asked, catalogue).collect()} == {q: sum(f(i) for i, _ in DOCS) for q, f in allowed.items()}


def loop_inputs(spark):
    docs = spark.createDataFrame([(i, "knee " * (1 + i % 7) + "hip " * (i % 3)) for i in range(90)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "knee"), (2, "hip"), (3, "knee hip"), (4, "nothing")], "query_id long, text string")
    return docs, queries, bm25(queries, docs)


def test_loop_equals_the_closed_form(spark):
    docs, queries, scores = loop_inputs(spark)
    tiers = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "excellent").when(F.col("doc_id") % 5 == 1, "ill-fit").otherwise("good").alias("tier"))
    given = queries.select("query_id").crossJoin(tiers.where("doc_id % 3 <> 0")).withColumn("reason", F.lit("because"))
    known = tiers.withColumn("tier", F.when(F.col("doc_id") % 3 == 0, "good").otherwise(F.col("tier")))
    results, searches = progressive.progressive(scores, progressive.by_table(given))
    want = fusion.progressive(scores, known).select("query_id", "doc_id", "tier", "rank")
    assert sorted(map(tuple, results.select("query_id", "doc_id", "tier", "rank").collect())) == sorted(map(tuple, want.collect()))
    assert {r.query_id for r in searches.collect()} == {1, 2, 3}
    assert all(r.reason == ("because" if r.doc_id % 3 else "Evaluation failed") for r in results.collect())


def test_stop_reasons(spark):
    docs, queries, scores = loop_inputs(spark)
    say = lambda tier: lambda rows: rows.select("query_id", "doc_id", F.lit(tier).alias("tier"), F.lit("").alias("reason"))
    reason = lambda **how: {(r.stop_reason, r.rounds_used, r.reviewed) for r in progressive.progressive(scores.where("query_id = 1"), how.pop("tier"), **how)[1].collect()}
    assert reason(tier=say("excellent")) == {("top-k-excellent", 1, 12)}
    assert reason(tier=say("good")) == {("max-profiles-reviewed", 3, 30)}
    assert reason(tier=say("good"), rounds=2) == {("max-iterations", 2, 24)}
    assert reason(tier=say("good"), most=1000, rounds=20) == {("no-more-profiles", 8, 90)}
    assert reason(tier=say("unheard of"), batch=30, whole_batches=True) == {("max-profiles-reviewed", 1, 30)}
    results, _ = progressive.progressive(scores.where("query_id = 1"), say("ill-fit"), batch=20, most=30, whole_batches=True)
    assert [r.tier for r in results.orderBy("rank").collect()] == ["good"] * 10 + ["ill-fit"] * 2
    assert progressive.progressive(scores.limit(0), say("good"))[0].count() == 0


def test_a_search_goes_on_behind_its_last_finished_round(spark, tmp_path):
    docs, queries, scores = loop_inputs(spark)
    asked = []

    def evaluator(rows):
        asked.extend((r.query_id, r.doc_id) for r in rows.collect())
        if len(asked) > 40 and not asked.count("failed"):
            asked.append("failed")
            raise RuntimeError("service down")
        return rows.select("query_id", "doc_id", F.lit("good").alias("tier"), F.lit("").alias("reason"))

    with pytest.raises(RuntimeError):
        progressive.progressive(scores, evaluator, path=str(tmp_path / "loop"))
    # The first round asked about 12 documents of three queries; the second failed as a whole.
    begun = asked.index("failed")
    results, searches = progressive.progressive(scores, evaluator, path=str(tmp_path / "loop"))
    again = asked[begun + 1 :]
    assert begun > 36 and not set(asked[:36]) & set(again) and len(again) == len(set(again)) == 90 - 36
    assert {r.reviewed for r in searches.collect()} == {30} and results.count() == 36


def answering(texts):
    def provider(batches):
        for b in batches:
            yield b.assign(answer=[texts.get(int(q)) for q in b["query_id"]])[["query_id", "answer"]]

    return provider


def test_providers_parse_check_and_fall_back(spark):
    queries = spark.createDataFrame([(i, "q") for i in range(1, 7)], "query_id long, text string")
    said = answering({1: json.dumps({"goal": "surgery", "confidence": 0.9, "intent_terms": ["a", "b"]}), 2: "```json\n{\"goal\": \"x\"}\n```", 3: "no", 4: "[1, 2]", 5: None})
    got = {r.query_id: r for r in providers.with_context(queries, said).collect()}
    assert len(got) == 6 and (got[1].goal, got[1].confidence, got[1].intent_terms, got[1].anchor_phrases) == ("surgery", 0.9, ["a", "b"], [])
    assert got[2].goal == "x" and got[2].confidence == 0.5
    assert {got[i].goal for i in (3, 4, 5, 6)} == {"diagnostic_workup"}
    order = providers.orders(queries, answering({1: '{"ranked": [5, 3, null, 5]}', 2: "{}"})).collect()
    assert sorted(map(tuple, order)) == [(1, 3, 1), (1, 5, 0), (1, 5, 3)]
    ideal = {r.query_id: r.ideal for r in providers.ideals(queries, answering({1: '{"procedures": [{"name": " knee ", "importance": "must"}, {"name": ""}], "areas": ["x"]}'})).collect()}
    assert [tuple(x) for x in ideal[1].procedures] == [("knee", "preferred", 0.8)] and ideal[1].areas == ["x"] and ideal[2].subspecialties == []
    lists = {r.query_id: r["items"] for r in providers.checklists(queries, answering({1: '{"items": ["a", " a ", "", "b", "c"]}'}), 2).collect()}
    assert lists[1] == ["a", "b"] and lists[2] == []


def test_tuning_equals_scoring_each_configuration(spark):
    docs = spark.createDataFrame([(i, f"knee {'hip ' * (i % 4)}", "ortho" if i % 2 else "cardio knee") for i in range(30)], "doc_id long, text string, title string")
    queries = spark.createDataFrame([(1, "knee hip"), (2, "ortho knee")], "query_id long, text string")
    configs = tuning.draws(spark, {"k1": (1.0, 2.0), "b": (0.5, 0.9), "text": (1.0, 3.0), "title": (0.3, 4.0)}, 5)
    got = {(r.config, r.query_id, r["rank"]): (r.doc_id, r.score) for r in tuning.rank_configs(tuning.statistics(index.build(docs, ["text", "title"]), queries), configs, ["text", "title"], 8).collect()}
    from rankloom.config import RankingConfig
    from rankloom.operators.bm25 import repeats

    for c in configs.collect():
        assert 1 <= c.k1 <= 2 and 0.5 <= c.b <= 0.9
        for r in ranked(bm25(queries, docs, RankingConfig(k1=c.k1, b=c.b), repeats({"text": c.text, "title": c.title})), 8).collect():
            assert got[c.config, r.query_id, r["rank"]] == (r.doc_id, r.score)


@pytest.mark.parametrize("parts", [1, 7])
def test_positions_within_groups(spark, parts):
    from rankloom.operators import positions

    rng = random.Random(12)
    rows = [("hot", rng.randint(0, 50)) for _ in range(200)] + [("b", 3), ("b", 1), (None, 2), (None, None), ("c", None)]
    got = positions.numbered(spark.createDataFrame(rows, "grp string, v int").repartition(3), "grp", "v", parts).collect()
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        mine = sorted((r.position, r.v) for r in got if r.grp == g)
        values = sorted((v for k, v in rows if k == g), key=lambda v: (v is not None, v or 0))
        assert [p for p, _ in mine] == list(range(1, len(values) + 1)) and [v for _, v in mine] == values
        assert {r.of for r in got if r.grp == g} == {len(values)}
