"""Kept records, the log's tally across restarts, and places in what patients say."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import analytics
from rankloom.sources.store import Store
from rankloom.streaming import tracker


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_store_equals_a_dictionary(spark, tmp_path):
    rng = random.Random(4)
    store, want = Store(spark, str(tmp_path / "s"), "id string, v long", "id", 8), {}
    assert rows(store.read()) == [] and store.delete(spark.createDataFrame([("x",)], "id string")) == 1
    for step in range(4):
        part = {str(rng.randint(0, 60)): rng.randint(0, 999) for _ in range(25)}
        frame = spark.createDataFrame([*part.items(), (None, 1)], "id string, v long")
        if step == 2:
            store.insert_new(frame)
            want = part | want
        else:
            store.upsert(frame)
            want |= part
        gone = [str(rng.randint(0, 60)) for _ in range(5)]
        store.delete(spark.createDataFrame([(g,) for g in gone], "id string"))
        want = {k: v for k, v in want.items() if k not in gone}
        assert rows(store.read()) == sorted(want.items(), key=str)
    store.delete(store.read().select("id"))
    assert store.read().count() == 0


def test_a_small_change_rewrites_few_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "id long, v string", "id", 32)
    store.upsert(spark.range(1000).select("id", F.lit("old").alias("v")))
    before = store.manifest()[1]
    assert store.upsert(spark.createDataFrame([(7, "new"), (2000, "new")], "id long, v string")) <= 2
    after = store.manifest()[1]
    assert 1 <= sum(before.get(b) != f for b, f in after.items()) <= 2
    assert store.read().where("v = 'new'").count() == 2 and store.read().count() == 1001
    broken = spark.range(1000).select("id", F.when(F.col("id") == 500, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).alias("v"))
    with pytest.raises(Exception, match="broken"):
        store.upsert(broken)
    assert store.manifest()[1] == after and store.read().where("v = 'old'").count() == 999


def test_tally_goes_on_after_a_restart_and_counts_once(spark, tmp_path):
    rng = random.Random(6)
    made = [(i, rng.choice("abc"), i * 10) for i in range(200)]
    frame = lambda part: spark.createDataFrame(part, "event_id long, who string, ts long")
    log = str(tmp_path / "log")
    frame(made[:120]).write.mode("append").parquet(log)
    stream = lambda: tracker.running_tally(spark.readStream.schema("event_id long, who string, ts long").parquet(log), "who", "event_id")
    first = tracker.drain(stream(), str(tmp_path / "out"), ["who"], "log")
    batch = lambda part: sorted((w, sum(p[1] == w for p in part), min(p[2] for p in part if p[1] == w), max(p[2] for p in part if p[1] == w)) for w in "abc")
    columns = ["who", "n", "first_seen", "last_seen"]
    assert rows(first.select(*columns)) == batch(made[:120])
    frame(made[100:]).write.mode("append").parquet(log)  # twenty events come again
    again = tracker.drain(stream(), str(tmp_path / "out"), ["who"], "log")
    assert rows(again.select(*columns)) == batch(made)
    shares = {r.who: r.percent for r in tracker.with_shares(again).collect()}
    assert shares == {w: round(100 * n / 200, 2) for w, n, _, _ in batch(made)}


@pytest.mark.parametrize(
    "text,want",
    [
        ("I am based in Leeds and work", [("Leeds", 1)]),
        ("based in Bridgend south Wales but no", [("Bridgend south Wales", 1)]),
        ("live in Milton Keynes, mostly", [("Milton Keynes", 2)]),
        ("live in High Wycombe, mostly", []),
        ("Location: South Wales,", [("South Wales", 3)]),
        ("near Cardiff (the city)", [("Cardiff", 4)]),
        ("coming from Kent, FROM KENT.", [("Kent", 5)]),
        ("Swansea, or so", [("Swansea", 7)]),
        ("Laura Smith, of course", []),
        ("in the clinic, in Sheffield, in Manchester", []),
        ("in january", []),
        (None, []),
        ("", []),
    ],
)
def test_places_of_each_way_of_naming_them(spark, text, want):
    found = spark.range(1).select(analytics.places_said(F.lit(text).cast("string")).alias("p")).first()["p"]
    assert [(p.place, p.pattern) for p in found] == want


def test_whole_words_spare_places_that_hold_a_refused_word(spark):
    found = spark.range(1).select(analytics.places_said(F.lit("in Sheffield, in He Said"), whole_words=True).alias("p")).first()["p"]
    assert [p.place for p in found] == ["Sheffield"]
