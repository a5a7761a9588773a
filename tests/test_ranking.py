import math

import pytest
from pyspark.sql import functions as F

from rankloom.config import RankingConfig
from rankloom.functions import geo, text
from rankloom.operators import boosts, dictionary, filters, fusion, locations, metrics, rescore, rewrite, sessions
from rankloom.operators.bm25 import bm25, ranked

DOCS = [(1, "knee surgery knee"), (2, "hip surgery café"), (3, ""), (4, "knee surgery knee"), (5, None), (6, "heart_valve repair")]


def plain_bm25(query, docs, k1=1.5, b=0.75):
    import re

    tok = lambda t: [w for w in re.sub(r"[^a-z0-9_\s]", " ", (t or "").lower()).split() if len(w) > 2]
    all_docs = {i: tok(t) for i, t in docs}
    avg = sum(map(len, all_docs.values())) / len(all_docs)
    out = {}
    for q in tok(query):
        df = sum(q in t for t in all_docs.values())
        idf = max(0.0, math.log((len(all_docs) - df + 0.5) / (df + 0.5) + 1))
        for i, t in all_docs.items():
            if tf := t.count(q):
                out[i] = out.get(i, 0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
    return {i: round(s, 6) for i, s in out.items()}


@pytest.mark.parametrize("query", ["knee knee surgery", "unknown", "", "caf heart_valve"])
def test_bm25_matches_plain_code(spark, query):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    q = spark.createDataFrame([(1, query)], "query_id long, text string")
    assert {r.doc_id: r.score for r in bm25(q, docs).collect()} == plain_bm25(query, DOCS)


def test_ties_go_to_the_smaller_id_and_fields_weigh(spark):
    docs = spark.createDataFrame([(1, "knee", "x y"), (2, "zzz", "knee")], "doc_id long, text string, title string")
    q = spark.createDataFrame([(1, "knee")], "query_id long, text string")
    top = ranked(bm25(q, docs, RankingConfig(variant="mini"), {"text": 1, "title": 3}))
    assert [r.doc_id for r in top.orderBy("rank").collect()] == [2, 1]


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bm25(spark.createDataFrame([(1, "knee")], "query_id long, text string"), none).count() == 0


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_tier_edges(spark):
    at = lambda v: value(spark, boosts.at_least(F.lit(v), ((4.8, 1.3), (4.5, 1.2), (4.0, 1.1))))
    assert [at(v) for v in (4.8, 4.79, 4.5, 4.0, 3.99)] == [1.3, 1.2, 1.2, 1.1, 1.0]
    near = lambda v: value(spark, boosts.proximity(F.lit(v)))
    assert [near(v) for v in (1.0, 1.01, 18.0, 18.1)] == [1.6, 1.5, 1.05, 1.0]
    assert [value(spark, rescore.negative_delta(F.lit(n))) for n in range(6)] == [0, -1, -2, -2, -3, -3]


def test_phrases_and_quotes(spark):
    assert value(spark, text.phrases(F.lit("total knee, an replacement"))) == ["total knee,", "knee, replacement", "total knee, replacement"]
    assert value(spark, text.strip_quotes(F.lit('"“Why?”"'))) == "Why?"
    assert value(spark, text.strip_fences(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert str(value(spark, text.chat_day(F.lit("2/14/24, 9:05:00")))) == "2024-02-14"
    assert value(spark, text.chat_day(F.lit("9:05, 14/2/2024"))) is None


def test_geography(spark):
    assert value(spark, geo.district(F.lit("sw1a 1aa"))) == "SW1A"
    assert value(spark, geo.match_postcode(F.lit("N1 9GU"), F.lit("n1")))
    assert abs(value(spark, geo.haversine(F.lit(51.5), F.lit(-0.1), F.lit(48.85), F.lit(2.35))) - 213.5) < 2


def test_filters_keep_what_they_should(spark):
    assert value(spark, filters.not_blacklisted(F.lit(None).cast("boolean")))
    assert value(spark, filters.insured_by(F.array(F.lit("")), "axa"))
    assert not value(spark, filters.insured_by(F.lit(None).cast("array<string>"), "axa"))
    assert value(spark, filters.inferred_gender(F.lit("Dr"), F.lit("she said her"))) == "female"
    assert value(spark, filters.inferred_gender(F.lit("Dr"), F.lit("she said he"))) is None
    assert value(spark, filters.gender_allows(F.lit(None).cast("string"), "male"))


def test_rewriting(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    assert value(spark, rewrite.merge_required(arr("hip"), arr("hips", "knee"))) == ["hip", "knee"]
    assert value(spark, rewrite.merge_anchors(arr("Hip", "knee"), arr("hip", "toe"))) == ["Hip", "knee", "toe"]


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 3, 1), (1, 2, 2)], "query_id long, doc_id long, rank int")
    rows = lambda x, y: [tuple(r) for r in fusion.reciprocal_rank(x, y).orderBy("rank").select("doc_id", "score").collect()]
    assert rows(a, b) == rows(b, a)


def test_metrics_golden(spark):
    ranking = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate("abcde")], "query_id long, doc_id string, rank int")
    truth = spark.createDataFrame([(1, "b"), (1, "c"), (1, "z"), (2, "q")], "query_id long, doc_id string")
    got = {r.query_id: r for r in metrics.at_k(metrics.judged(ranking, truth)).collect()}
    assert (got[1].precision_3, got[1].recall_5, got[1].mrr) == (0.666667, 0.666667, 0.5)
    assert got[1].ndcg_12 == round((1 / math.log2(3) + 1 / 2) / (1 + 1 / math.log2(3) + 1 / 2), 6)
    assert got[2].mrr == 0


def test_messages_drop_blanks(spark):
    chat = "[1/2/24, 9:00:00] Ann: hello\nthere [1/2/24, 9:01:00] Bob: \n[9:02, 3/1/2024] Ann: bye"
    assert [m["body"] for m in value(spark, sessions.messages(F.lit(chat)))] == ["hello\nthere", "bye"]


def test_plan_stays_in_the_jvm(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    plan = bm25(spark.createDataFrame([(1, "knee")], "query_id long, text string"), docs)._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("LogicalRDD", "") and "Cartesian" not in plan


def test_second_stage_golden(spark):
    n = F.lit
    # (10 x 1.4 x 1.15 x 1.05 + min(5 x 0.2, 0.6) + 3) x 1.3 x 0.85
    assert value(spark, F.round(rescore.multiplicative(n(10.0), n(2), n(2), n(1), n(5), n(4), n(0.3), n(3)), 9)) == round((10 * 1.4 * 1.15 * 1.05 + 0.6 + 3) * 1.3 * 0.85, 9)
    assert value(spark, rescore.multiplicative(n(0.0), n(0), n(0), n(0), n(1), n(1), n(0.0), n(0))) == pytest.approx(1.2)
    # 2 + 3 + 2 x 0.5 + 0.4 + 2 + 0.5 - 2
    assert value(spark, rescore.tiered(n(1), n(7), n(2), n(2), n(2), n(0.9), n(2))) == pytest.approx(6.9)
    terms = F.array(*[n(t) for t in ("Angina", "PCI", "knee", "chest pain", "knee")])
    assert [value(spark, c) for c in rescore.term_classes(terms)] == [["angina", "chest pain"], ["pci"], ["knee", "knee"]]


def test_checklist_takes_the_first_set_that_has_it(spark):
    n = F.lit
    ratio, boost = rescore.checklist(F.array(n("knee"), n("hip")), [n("kneecap repair"), n("knee pain"), n("")])
    assert (value(spark, ratio), value(spark, boost)) == (0.25, 1.0)  # a part of the first goes before the whole word of the second
    ratio, boost = rescore.checklist(F.array(n(" Knee "), n("hip repair clinic")), [n(""), n("knee pain"), n("hip")])
    assert (value(spark, ratio), round(value(spark, boost), 6)) == (0.75, 1.15)
    assert value(spark, rescore.checklist(F.array().cast("array<string>"), [n("x")])[1]) == 1.0


def test_ideal_profile_golden(spark):
    texts = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    need = lambda *v: F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("importance")) for a, b in v])
    profile = F.struct(texts("Hip Surgery").alias("subspecialties"), texts("hip", "replacement").alias("procedures"), texts("arthritis").alias("conditions"), F.lit("Hips and knees").alias("expertise"), F.lit("kind").alias("description"), texts("frcs").alias("qualifications"), texts("Adults").alias("age_groups"), texts("french").alias("languages"), F.lit("female").alias("gender"))
    ideal = F.struct(need(("hip", "required"), ("spine", "required")).alias("subspecialties"), need(("Hip Replacement", "preferred")).alias("procedures"), need(("arthritis", "optional")).alias("conditions"), texts("HIPS").alias("areas"), texts("Kind", "rude").alias("keywords"), texts("hand").alias("avoid_subspecialties"), texts("replacement").alias("avoid_procedures"), texts("FRCS").alias("qualifications"), texts("adults").alias("age_groups"), texts("French").alias("languages"), F.lit("Female").alias("gender"))
    assert value(spark, rescore.ideal_match(profile, ideal)) == 5 - 2 + 2 + 1.5 + 2 + 1 - 2 + 1 + 0 + 1 + 1
    nothing = F.struct(*[F.lit(None).cast("array<string>").alias(c) for c in ("subspecialties", "procedures", "conditions", "qualifications", "age_groups", "languages")], *[F.lit(None).cast("string").alias(c) for c in ("expertise", "description", "gender")])
    assert value(spark, rescore.ideal_match(nothing, ideal)) == 0


def test_places_in_addresses(spark):
    at = lambda a: value(spark, locations.parse_city(F.lit(a)))
    assert [at("1 Road, Camden, London"), at("Greater Manchester Hospital\nUK"), at("Bath Road, Slough"), at("nowhere"), at(None)] == ["camden", "manchester", "slough", None, None]
    match = lambda a, p, h, c: value(spark, locations.match_city(F.lit(a).cast("string"), F.lit(p).cast("string"), F.lit(h).cast("string"), c))
    assert match("Soho", None, None, "London") and match(None, "EC1A 1BB", None, "london") and not match("Leeds", "M1 1AA", None, "london")
    assert match("Leeds, York", None, None, "york") and match(None, None, "York Clinic", "york") and not match("Yorkville", None, None, "leeds")


def test_centre_of_an_unknown_district(spark):
    cen = spark.createDataFrame([("B70", 1.0, 1.0), ("B90", 2.0, 2.0), ("BA77", 3.0, 3.0)], "district string, lat double, lon double")
    assert locations.centre_of(cen, "b77 1bz") == (1.0, 1.0) and locations.centre_of(cen, "B90") == (2.0, 2.0) and locations.centre_of(cen, "ZZ1") is None


def test_distance_join_equals_all_pairs(spark):
    import random

    rng = random.Random(4)
    rows = lambda n, name: spark.createDataFrame([(i, rng.uniform(49, 60.9), rng.uniform(-8, 2)) for i in range(n)], f"{name} long, lat double, lon double")
    a, b = rows(120, "left_id"), rows(90, "right_id")
    every = a.crossJoin(b.select("right_id", F.col("lat").alias("la"), F.col("lon").alias("lo"))).where(geo.haversine(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo")) <= 40)
    assert {(r.left_id, r.right_id) for r in locations.distance_join(a, b, 40).collect()} == {(r.left_id, r.right_id) for r in every.collect()}


def test_fetch_depth():
    from rankloom.operators.shortlist import fetch_depth

    assert [fetch_depth(0, 12, 1000), fetch_depth(0, 12, 20), fetch_depth(100, 12, 110)] == [60, 36, 124]


def test_event_time_windows(spark, tmp_path):
    import datetime as dt

    from rankloom.streaming import tracker

    rows = [("a", dt.datetime(2024, 1, d)) for d in (1, 2, 20, 21)]
    spark.createDataFrame(rows, "who string, ts timestamp").write.parquet(str(tmp_path / "in"))
    log = tracker.read_log(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    out = tracker.windowed_tally(log, "who").writeStream.format("memory").queryName("weeks").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert sum(r.n for r in spark.table("weeks").collect()) == 4


def test_configuration():
    c = RankingConfig().merged(k1=1.2, b=None)
    assert (c.k1, c.b, c.stage_a_size()) == (1.2, 0.75, 150)


def test_phrase_hits_equal_looking_everywhere(spark):
    import random

    from rankloom.operators.phrases import phrase_hits

    rng = random.Random(8)
    words = ["heart", "art", "pain", "painful", "Knee,", "an", "x", "chest", "(chest"]
    text = lambda n: rng.choice(["", " "]) + "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n"]) for _ in range(n))
    q = spark.createDataFrame([(i, text(rng.randint(0, 7))) for i in range(30)], "query_id long, text string")
    d = spark.createDataFrame([(i, text(rng.randint(0, 40))) for i in range(40)] + [(99, None)], "doc_id long, text string")
    got = {(r.query_id, r.doc_id): r.phrases for r in phrase_hits(q, d).collect()}
    every = q.crossJoin(d.withColumnRenamed("text", "body")).select("query_id", "doc_id", text_count(F.col("text"), F.col("body")).alias("n")).where("n > 0").collect()
    assert got == {(r.query_id, r.doc_id): r.n for r in every} and got


def text_count(query, body):
    return text.count_contained(text.phrases(query), F.lower(body))


# Chat blocks: golden rows by the format's own rules

BLOCK = """1. Mr Oliver Example

📍 Hospital One / Hospital Two (Bristol)

Consultant Gynaecologist – Lead of a Centre

Why he may be a good fit:
First line.
Second line.

a stray line
Best for:
those who
ask

🔗 https://example.org/a?b=c more"""


@pytest.mark.parametrize(
    "block,want",
    [
        (BLOCK, (1, "Mr Oliver Example", "Hospital One / Hospital Two (Bristol)", "Consultant Gynaecologist – Lead of a Centre", "First line. Second line.", "those who ask", "https://example.org/a?b=c")),
        ("12)  Dr A\n📍\n\n\nBest for: x\ny\n🔗 none\nWHY SHE MAY BE A GOOD FIT: a\nbest FOR: b", (12, "Dr A", "", None, "a", "b", None)),
        ("2. B\n📍 P\nWhy ever not\n🔗https://e.org", (2, "B", "P", None, None, None, "https://e.org")),
        ("3. C\n📍 P\n📍 T\nWhy he may be a good fit: one\n📍 two\n🔗 https://e.org", (3, "C", "P", "📍 T", "one 📍 two", None, "https://e.org")),
        ("4. D\r\nWhy she may be a good fit:\r\n\r\nlost\r\n Best for: \r\n kept ", (4, "D", None, None, None, "kept", None)),
        ("5.E\nno blank after the number", None),
        ("hello", None),
        ("", None),
    ],
)
def test_recommendation_blocks(spark, block, want):
    found = value(spark, sessions.recommendation(F.lit(block)))
    assert (tuple(found) if found else None) == want


def test_messages_of_both_stamp_forms(spark):
    chat = "[21:03, 11/02/2026] Jack: 1. A\n📍 P\n[2/13/26, 19:15:29] DocMap:2. B"
    assert [tuple(m) for m in value(spark, sessions.messages(F.lit(chat)))] == [("21:03, 11/02/2026", "1. A\n📍 P"), ("2/13/26, 19:15:29", "2. B")]


# Filters: wishes that only partly equal what a profile says


def test_wishes_that_contain_or_are_contained(spark):
    groups = lambda *g: F.array(*[F.lit(x) for x in g])
    assert value(spark, filters.treats_age(groups("Paediatrics"), "young children"))
    assert value(spark, filters.treats_age(groups("Child health"), "Pediatric care"))
    assert not value(spark, filters.treats_age(groups("Paediatrics"), "infants"))
    assert value(spark, filters.treats_age(groups("Adults"), "older adults"))
    assert value(spark, filters.speaks(groups("English"), ["English (fluent)"])) and value(spark, filters.speaks(groups("English (basic)"), ["english"]))
    assert not value(spark, filters.speaks(groups("Urdu"), ["English"]))
    assert value(spark, filters.inferred_gender(F.lit(None).cast("string"), F.lit("She prides herself on care"))) == "female"


# Dictionaries


def plain_matches(texts, phrases):
    return sorted((t, p, i, len(ws)) for t, words in texts for p, ws in phrases for i in range(len(words)) if ws and words[i : i + len(ws)] == ws)


def test_dictionary_equals_plain_search(spark):
    import random

    rng = random.Random(5)
    texts = [(i, rng.choices("abcd", k=rng.randint(0, 25))) for i in range(30)]
    phrases = [(i, rng.choices("abcd", k=rng.randint(1, 4))) for i in range(25)] + [(100, ["a", "b"]), (101, ["a", "b"]), (102, [])]
    frame = spark.createDataFrame(texts, "text_id int, words array<string>"), spark.createDataFrame(phrases, "phrase_id int, words array<string>")
    hits = dictionary.matches(*frame, 4)
    assert sorted(map(tuple, hits.collect())) == plain_matches(texts, phrases)
    assert sorted(map(tuple, dictionary.matches(*frame, 2).collect())) == plain_matches(texts, [p for p in phrases if len(p[1]) <= 2])
    assert "NestedLoop" not in hits._jdf.queryExecution().toString() and "Cartesian" not in hits._jdf.queryExecution().toString()
    chosen = dictionary.leftmost_longest(hits.withColumn("priority", -F.col("phrase_id"))).collect()
    got = {}
    for r in chosen:
        got.setdefault(r.text_id, []).append((r.start, r.size, r.phrase_id))
    for t, words in texts:
        want, at = [], 0
        while at < len(words):
            here = [(len(ws), p) for p, ws in phrases if ws and words[at : at + len(ws)] == ws]
            if here:
                size, p = max(here)
                want.append((at, size, p))
            at += here and max(here)[0] or 1
        assert sorted(got.get(t, [])) == want


def test_aliases_take_any_word_of_a_context(spark):
    aliases = spark.createDataFrame([("echo", "echocardiogram", True, ["cardiac", "heart"]), ("af", "atrial fibrillation", False, None), ("svt", "supraventricular tachycardia", False, None)], "term string, alias string, low_priority boolean, context array<string>")
    queries = spark.createDataFrame([(1, "Echo of the Heart"), (2, "echo"), (3, "AF/SVT cardiac echo"), (4, None), (5, "echoes, heartless")], "query_id int, text string")
    got = {r.query_id: r.text for r in rewrite.expand_aliases(queries, aliases).collect()}
    assert got == {1: "Echo of the Heart echocardiogram", 2: "echo", 3: "AF/SVT cardiac echo supraventricular tachycardia atrial fibrillation", 4: "", 5: "echoes, heartless"}
