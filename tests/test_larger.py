"""What larger tables and repeated values brought to light: results against SQL or plain versions, and the shape of the work."""

import duckdb
import pytest
from pyspark.sql import functions as F

from rankloom.operators import analytics as AN
from rankloom.plans import catalogue


def against_sql(spark, folder, name, **tables):
    """The rows of a registered query and of its SQL over ``tables`` (name -> SELECT)."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, str(folder))
    cur = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in cur.description]
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    return order(df.select(*columns).collect()), order(cur.fetchall())


def below_joins(df):
    """The optimised plan, from its first join on."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan[plan.index("Join") :]


def test_context_of_a_query_that_begins_with_a_word_twice(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "context_variants", benchmark="select i as item_id, ['and and offer ornt', 'der der die', 'one two three'][i] as text from range(1, 4) t(i)")
    assert got == want and any(r[3] == "and and offer" for r in got)


def test_latest_by_phone_meets_one_row_of_each_number(spark):
    left = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, 6), (5, 7)], "left_id long, phone long")
    right = spark.createDataFrame([(i, 5 + i % 2, i // 4) for i in range(40)] + [(99, None, 99)], "right_id long, phone long, seen long")
    found = AN.latest_by_phone(left, right)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 38), (2, 38), (4, 39)]
    assert "Aggregate [phone" in below_joins(found)


def test_same_day_matches_over_many_blocks(spark):
    import random

    from rankloom.operators.sessions import best_same_day

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    some = lambda: rng.sample(words[: rng.choice((8, 40))], rng.randint(0, 6))
    left, right = ([(i, rng.choice((1, 2, None)), some()) for i in range(n)] for n in (60, 150))
    got = best_same_day(spark.createDataFrame(left, "left_id long, day int, a array<string>"), spark.createDataFrame(right, "right_id long, day int, b array<string>"), side=16)
    assert "CoGroup" in got._jdf.queryExecution().optimizedPlan().toString() and not [c for c in got.columns if c in ("a", "b")]
    want = {}
    for i, d, a in left:
        all_ = [(-round(len(set(a) & set(b)) / len(set(a) | set(b)), 6), j) for j, e, b in right if d is not None and d == e and a and b]
        best = min(all_, default=(0, 0))
        if best[0] <= -0.08:
            want[i] = (best[1], -best[0])
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == want


def test_bm25_shuffles_no_pairs_and_keeps_the_best(spark):
    from rankloom.operators.bm25 import bm25, ranked

    docs = spark.createDataFrame([(i, f"common word{i % 7} {'rare ' * (i % 3)}") for i in range(400)] + [(1000, None)], "doc_id long, text string").repartition(5)
    q = spark.createDataFrame([(1, "common rare"), (2, "word3 word3 absent"), (3, "nothing here")], "query_id long, text string")
    all_, best = bm25(q, docs), bm25(q, docs, top=5)
    assert "Aggregate" not in all_._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(ranked(best, 5)) == rows(ranked(all_, 5)) and all_.count() == 400 + 57 and best.count() < all_.count()


def test_files_of_the_index_have_few_shards(spark):
    from rankloom.llm import lexical

    docs = spark.createDataFrame([(i, "a b") for i in range(100)], "doc_id long, text string").coalesce(1)
    index = lexical.build_index(docs, shard_documents=10)
    assert index.count() == 10 and len(index.inputFiles()) == 5


def test_missed_rows_are_gathered_before_texts(spark):
    from rankloom.operators import reports as RP

    missed = spark.createDataFrame([(1, 7), (2, 7), (1, 8)], "query_id long, doc_id long")
    q = spark.createDataFrame([(1, ["ab", "x"]), (2, ["zz"])], "query_id long, terms array<string>")
    docs = spark.createDataFrame([(7, "CAB zz", None)], "doc_id long, text string, name string")
    found = RP.overlaps(missed, q, docs, ("name",), ("text",))
    assert sorted((r.query_id, r.doc_id, r.overlap, r.overlap_name, r.dominant) for r in found.collect()) == [(1, 7, 1, 0, "low_only"), (1, 8, 0, 0, "none"), (2, 7, 1, 0, "low_only")]
    assert "collect_list" in found._jdf.queryExecution().optimizedPlan().toString()


def test_only_the_truth_of_a_ranking_is_gathered(spark):
    from rankloom.operators import metrics as M

    ranking = spark.createDataFrame([(q, d, d + 1) for q in (1, 2) for d in range(50)], "query_id long, doc_id long, rank int")
    truth = spark.createDataFrame([(1, 4), (1, 4), (1, 20), (1, 99), (3, 7)], "query_id long, doc_id long")
    found = M.judged(ranking, truth)
    assert sorted(tuple(r) for r in found.select("query_id", "doc_id", "rank", "hit", "n_true").collect()) == [(1, 4, 5, 1, 3), (1, 20, 21, 1, 3), (3, None, None, 0, 1)]
    assert "ShuffledHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.query_id: r.mrr for r in M.at_k(found).collect()} == {1: 0.2, 3: 0.0}
    assert [tuple(r) for r in M.rank_buckets(found).orderBy("bucket").collect()] == [("1-10", 1, 5.0, 0.5), ("11-50", 1, 21.0, 0.5)]


def test_metrics_agree_with_sql(spark, tmp_path):
    tables = {
        "documents": "select i as doc_id, case when i % 9 = 0 then null else 'common word' || (i % 7) || repeat(' rare', (i % 3)::int) end as text from range(1, 300) t(i)",
        "benchmark": "select i as item_id, ['common rare', 'word3 word3', 'absent', 'word5 rare'][i] as text from range(1, 5) t(i)",
        "labels": "select i as doc_id, (i % 5 = 0)::int as quality, (i % 10 = 0)::int as toxic from range(1, 300) t(i) where i % 4 <> 2",
    }
    for name in ("mrr", "metric_means", "rank_buckets", "position_metrics", "recall_by_n"):
        got, want = against_sql(spark, tmp_path, name, **tables)
        assert got == want and got


def test_scaling_shuffles_no_scores_and_makes_them_once(spark, tmp_path):
    tables = {
        "documents": "select i as doc_id, case when i % 9 = 0 then null else 'common word' || (i % 7) || repeat(' rare', (i % 3)::int) end as text from range(1, 300) t(i)",
        "benchmark": "select i as item_id, ['common rare', 'word3 word3', 'absent', 'word5 rare'][i] as text from range(1, 5) t(i)",
    }
    got, want = against_sql(spark, tmp_path, "minmax_normalise", **tables)
    assert got == want and got
    plan = catalogue.QUERIES["minmax_normalise"](spark, str(tmp_path))._jdf.queryExecution()
    assert "MapInArrow" not in plan.toString() and "SortMergeJoin" not in plan.executedPlan().toString() and "BroadcastHashJoin" in plan.executedPlan().toString()


def test_hybrid_joins_only_what_may_be_among_the_best(spark, tmp_path):
    from rankloom.operators.bm25 import floors, ranked

    tables = {
        "documents": "select i as doc_id, case when i % 9 = 0 then null else 'common word' || (i % 7) || repeat(' rare', (i % 3)::int) || repeat(' filler', (i % 40)::int) end as text from range(1, 400) t(i)",
        "benchmark": "select i as item_id, ['common rare', 'word3 word3', 'absent', 'word5 rare'][i] as text from range(1, 5) t(i)",
        "embeddings": "select i as vec_id, case when i % 11 = 0 then null else [(((i * 37) % 100) / 250 - 0.05)::float, 1] end as embedding from range(1, 400, 2) t(i)",
    }
    got, want = against_sql(spark, tmp_path, "hybrid_semantic_bm25", **tables)
    assert got == want and len(got) == 30
    plan = catalogue.QUERIES["hybrid_semantic_bm25"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "floor" in plan
    scores = spark.createDataFrame([(1, i, i / 200) for i in range(201)] + [(2, 1, 1.0)], "query_id long, doc_id long, x double")
    low = {r.query_id: r.floor for r in floors(scores, "x", 10, 0.3).collect()}
    assert list(low) == [1] and 0.6 < low[1] <= 0.955 - 0.3
    kept = scores.where(f"query_id = 1 and x >= {low[1]}")
    worst = lambda df: [tuple(r) for r in ranked(df.select("query_id", "doc_id", F.round(F.col("x") + F.when(F.col("x") > 0.95, 0.0).otherwise(0.3), 6).alias("score")), 10).collect()]
    assert kept.count() < 80 and worst(kept) == worst(scores.where("query_id = 1"))


def test_two_short_lists_are_made_once(spark, tmp_path):
    tables = {
        "documents": "select i as doc_id, case when i % 9 = 0 then null else 'common word' || (i % 7) || repeat(' rare', (i % 3)::int) || repeat(' filler', (i % 40)::int) end as text from range(1, 400) t(i)",
        "benchmark": "select i as item_id, ['common rare', 'word3 word3', 'absent', 'word5 rare'][i] as text from range(1, 5) t(i)",
    }
    for name in ("rerank_backfill", "rrf_fusion", "bm25_local_topk", "bm25_merged_config"):
        got, want = against_sql(spark, tmp_path, name, **tables)
        assert got == want and got
    plan = catalogue.QUERIES["rerank_backfill"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "SortMergeJoin" not in plan


def test_whole_rankings_are_dealt_out_within_a_query(spark, monkeypatch):
    from rankloom.operators import bm25 as BM

    rows = [(q, d, float(d % s)) for q, s in ((1, 5), (2, 1), (None, 40)) for d in range(500)] + [(3, 7, -1.0)]
    scores = spark.createDataFrame(rows, "query_id long, doc_id long, score double").repartition(3)
    monkeypatch.setattr(BM, "DEALT", 100)
    got = BM.ranked_whole(scores)
    assert got.dtypes == BM.ranked(scores).dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, BM.ranked(scores).collect()))
    held = [spark.read.parquet(f).count() for f in got.inputFiles()]  # a file is what a task sorted
    assert len(held) > 10 and max(held) < 400 and sum(held) == 1501
    assert "row_number" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert BM.ranked_whole(scores.where("false")).count() == 0


def test_no_task_makes_all_pairs_of_the_truth(spark, tmp_path, monkeypatch):
    from rankloom.operators import bm25 as BM
    from rankloom.plans import evaluation as EV

    tables = {
        "documents": "select i as doc_id, case when i % 9 = 0 then null else 'common word' || (i % 7) || repeat(' rare', (i % 3)::int) end as text from range(1, 600) t(i)",
        "benchmark": "select i as item_id, ['common rare', 'word3 word3', 'absent', 'word5 rare'][i] as text from range(1, 5) t(i)",
        "labels": "select i as doc_id, (i % 5 = 0)::int as quality, (i % 10 = 0)::int as toxic from range(1, 600) t(i) where i % 4 <> 2",
    }
    monkeypatch.setattr(BM, "DEALT", 150)
    for name in ("mrr", "rank_buckets"):
        got, want = against_sql(spark, tmp_path, name, **tables)
        assert got == want and got
    each = EV.truth(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(each) > 5 and max(r["count"] for r in each) <= 150
    # Hits are written, sizes are sent to them: no join gathers the hits of a query.
    plan = catalogue.QUERIES["rank_buckets"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number" not in plan and "rightHint=(strategy=broadcast)" in plan


def test_what_reads_whole_rankings_or_the_truth_agrees_with_sql_when_dealt_out(spark, tmp_path, monkeypatch):
    from rankloom.operators import bm25 as BM

    tables = {
        "documents": "select i as doc_id, case when i % 9 = 0 then null else 'common word' || (i % 7) || repeat(' rare', (i % 3)::int) || repeat(' trash', (i % 4)::int) end as text, 'de' as lang, 'common' as source from range(1, 600) t(i)",
        "benchmark": "select i as item_id, ['common rare', 'word3 word3', 'absent', 'word5 rare'][i] as text from range(1, 5) t(i)",
        "labels": "select i as doc_id, (i % 5 = 0)::int as quality, (i % 10 = 0)::int as toxic from range(1, 600) t(i) where i % 4 <> 2",
    }
    monkeypatch.setattr(BM, "DEALT", 150)
    for name in ("missing_picks", "missed_tendencies", "score_at_rank", "penalty_ab", "fetch_next_batch"):
        got, want = against_sql(spark, tmp_path, name, **tables)
        assert got == want and got
        plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan or name == "score_at_rank"


def test_missed_tendencies_rank_only_the_first_and_agree_with_sql(spark, tmp_path, monkeypatch):
    from rankloom.plans import evaluation as EV

    tables = {
        "documents": "select i as doc_id, case when i % 9 = 0 then null when i % 7 = 0 then 'uncommon wordy' else 'Common word' || (i % 7) || repeat(' rare', (i % 3)::int) end as text, case when i % 5 > 0 then 'rare' end as lang, 'src' || (i % 3) as source from range(1, 700) t(i)",
        "benchmark": "select i as item_id, ['common rare common', 'word3 src1 word3', 'absent', null][i] as text from range(1, 5) t(i)",
        "labels": "select i as doc_id, (i % 5 > 0)::int as quality, (i % 10 = 0)::int as toxic from range(1, 800) t(i)",  # the last are of no document
    }
    monkeypatch.setattr(EV, "ranked_whole", lambda scores: pytest.fail("a whole ranking is made"))
    got, want = against_sql(spark, tmp_path, "missed_tendencies", **tables)
    assert got == want and {b for k, b, _ in got if k == "rank"} == {"none", "21-50", "51-100", "101+"}


def test_overlaps_look_a_text_up_once_for_all_queries(spark):
    from rankloom.operators import reports as RP

    asked = {1: ["abc", "bcd", "abc", "a-b"], 2: ["b_1", "", "zz"], 3: [], 4: None}
    bodies = {7: "xABCd b_1x a-b", 8: None, 9: "abc abcd zz", 10: ""}
    pairs = [(q, d, f"{q}.{d}") for q in asked for d in (*bodies, 99)] + [(1, 7, "again")]
    docs = spark.createDataFrame([(d, t, "ZZ abc", t) for d, t in bodies.items()], "doc_id long, text string, name string, about string")
    missed, q = spark.createDataFrame(pairs, "query_id long, doc_id long, more string"), spark.createDataFrame(list(asked.items()), "query_id long, terms array<string>")
    count = lambda q, text: sum(t in text for t in asked[q] or [])
    for unknown in (True, False):
        found = RP.overlaps(missed, q, docs, ("name",), ("about",), same=("about",), unknown=unknown)
        assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
        got = sorted((r.query_id, r.doc_id, r.more, r.overlap, r.overlap_about, r.overlap_name, r.shared) for r in found.collect())
        low = lambda d: (bodies.get(d) or "").lower()
        assert got == sorted((q, d, m, count(q, low(d)), count(q, low(d)), count(q, "zz abc") if d in bodies else count(q, ""), bool(set(low(d).split()) & {"abc", "zz", "b_1", "bcd"} & set(asked[q] or []))) for q, d, m in pairs if unknown or d in bodies)


def test_semantic_scores_of_repeated_names_agree_with_sql(spark, tmp_path):
    customer = "select i as c_custkey, 'Customer#' || lpad((i % 1200)::varchar, 9, '0') as c_name, ['HOUSEHOLD', 'BUILDING', 'OTHER'][i % 3 + 1] as c_mktsegment from range(0, 3600) t(i)"
    got, want = against_sql(spark, tmp_path, "semantic_resolve", customer=customer)
    assert got == want and len(got) == 3600 and len({s for _, s in got}) > 5


@pytest.mark.parametrize("longest", [1, 2, 64])
def test_needles_that_begin_alike_meet_only_what_holds_them(spark, longest):
    import random

    from rankloom.operators import containment as CT

    rng = random.Random(longest)
    some = lambda: "same" + "".join(rng.choices("ab ", k=rng.randint(0, 6)))
    a, b = ([some()[rng.choice((0, 0, 4)) :] for _ in range(80)] + [None, ""] for _ in range(2))
    frame = lambda values, c: spark.createDataFrame([(x,) for x in values], f"{c} string")
    pairs = CT.either_way(frame(a, "a"), frame(b, "b"), longest)
    want = {(x, y) for x in a for y in b if x and y and (x in y or y in x)}
    assert sorted(tuple(r) for r in pairs.collect()) == sorted(want)


def test_semantic_scores_join_whole_names_and_give_strings_their_first_name(spark):
    import random

    from rankloom.operators import semantic as SE

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abC", k=rng.randint(1, 4)))
    name = lambda: " ".join(word() for _ in range(rng.choice((1, 1, 2, 3))))
    people = [(i, name() if i % 13 else None, rng.choice([None, "", "zed", "yy", word()])) for i in range(150)] + [(200 + i, "aab bca", "zed") for i in range(50)]
    scored = [(i, rng.choice((0.0, 0.5, 1.5))) for i in range(0, 150, 7)]
    named = [(i, x, rng.choice((0.0, 0.25, 0.75))) for i, x in enumerate([*(name() + name() for _ in range(25)), "zedyy", "Zed", "aab bca", "aab bca", None, ""])]

    def plain(doc, own, spec):
        low, spec, ids = (own or "").lower(), (spec or "").lower(), dict(scored)
        if doc in ids:
            return min(1.0, ids[doc])
        if equal := [s for _, x, s in named if x == own and x is not None]:
            if equal[-1]:
                return equal[-1]
        meet = lambda a, b: a != "" and b != "" and (a in b or b in a)
        keys = [(x.lower(), s) for _, x, s in named if x]
        end = lambda x: x.rsplit(" ", 1)[-1]
        second = next((s for k, s in keys if meet(low, k) or meet(end(low), end(k))), 0.0)
        return second or next((s for k, s in keys if meet(spec, k)), 0.0)

    made = SE.resolve(spark.createDataFrame(people, "doc_id long, name string, specialty string"), spark.createDataFrame(scored, "doc_id long, score double"), spark.createDataFrame(named, "pos long, name string, score double"))
    # Strings are resolved apart and written: what is left joins rows one to one, without a gathering by profile.
    assert "min(" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: r.semantic for r in made.collect()} == {p[0]: plain(*p) for p in people} and made.count() == len(people)
