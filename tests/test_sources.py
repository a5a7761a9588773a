import json

import pytest

from pyspark.sql import types as T

from rankloom.sources import readers

REC = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())])


def test_json_shapes(spark, tmp_path):
    for i, s in enumerate(('{"records":[{"id":"1","name":"a"}]}', '[{"id":"2","name":"b"}]', '{"profiles":[{"id":"3"}]}')):
        (tmp_path / f"{i}.json").write_text(s)
    assert sorted(r.id for r in readers.json_records(spark, str(tmp_path), REC).collect()) == ["1", "2", "3"]


def test_csv_quotes_and_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,name\n1,"a ""b""\nc"\n,\n2\n')
    rows = readers.csv_records(spark, str(tmp_path / "x.csv"), REC, ["id", "name"]).orderBy("id").collect()
    assert [(r.id, r.name) for r in rows] == [("1", 'a "b"\nc'), ("2", None)]


def test_questions_and_chats(spark, tmp_path):
    (tmp_path / "q").mkdir()
    lines = ['"“Who can mend my hip after a second fall?”"', "", "Who can mend my hip?", "Practical, intent-heavy", "Musculoskeletal rehabilitation & recovery", "# Which surgeon sees children with hip pain?"]
    (tmp_path / "q" / "hips.csv").write_text("\n".join(lines) + "\n")
    got = readers.questions(spark, str(tmp_path / "q")).orderBy("n").collect()
    assert [(r.specialty, r.question) for r in got] == [("hips", "Who can mend my hip after a second fall?"), ("hips", lines[-1])]
    (tmp_path / "c" / "s1").mkdir(parents=True)
    (tmp_path / "c" / "s1" / "chat.txt").write_text("a\nb")
    assert [tuple(r) for r in readers.chats(spark, str(tmp_path / "c")).collect()] == [("s1", "a\nb")]


def test_append_and_exports(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b"')], REC)
    for _ in range(2):
        readers.append(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    readers.write_csv(df, str(tmp_path / "out"))
    assert '"a ""b"""' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert df.select(readers.as_json("id", "name")).first()[0] == '{"id":"1","name":"a \\"b\\""}'


def test_lookups(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"Bldg": "Building", "Mach": "Machines"}')
    (tmp_path / "c.json").write_text('{"SW1": {"lat": 51.5, "lon": -0.1}}')
    assert sorted(tuple(r) for r in readers.lookup(spark, str(tmp_path / "a.json")).collect()) == [("Bldg", "Building"), ("Mach", "Machines")]
    place = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
    assert [tuple(r) for r in readers.lookup(spark, str(tmp_path / "c.json"), place, "district").collect()] == [("SW1", 51.5, -0.1)]


AWKWARD = [{"id": "1", "name": 'a}b{c]"d\\'}, {"id": "2", "more": {"x": [{"y": "}"}, {}], "z": "\\\\"}, "name": "é\u2028\n}{"}, {"id": None, "name": ""}, {}, {"name": "{\"id\": 5}", "id": "6"}]


@pytest.mark.parametrize("form", ["array", "records", "profiles"])
@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("split", ["200b", "128m"])
def test_json_streams_are_cut_anywhere(spark, tmp_path, form, indent, split):
    rows = AWKWARD * 4
    whole = rows if form == "array" else {"total_records": 5, "by": {"who": "[x", "records": [1]}, form: rows, "end": {"ok": True}}
    for n in range(2):
        (tmp_path / f"{n}.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=n == 0), encoding="utf-8-sig" if n else "utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = sorted(((r.id, r.name) for r in readers.json_stream(spark, str(tmp_path), REC).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(((r.get("id"), r.get("name")) for r in rows * 2), key=str)



def test_the_last_canonical_row_wins(spark):
    profiles = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "doc_id string")
    canonical = spark.createDataFrame([("z", ["a", "b"], "first", 1), ("y", ["a"], "second", 2), ("c", ["q"], "own", 3), ("b", ["r"], "own b", 4)], "canonical_id string, legacy_ids array<string>, checklist string, seq int")
    got = {r.doc_id: r.checklist for r in readers.profiles_with_canonical(profiles, canonical).collect()}
    assert got == {"a": "second", "b": "first", "c": "own", "d": None}


def test_write_json(spark, tmp_path):
    readers.write_json(spark.createDataFrame([("1", "a")], REC), str(tmp_path / "j"))
    assert readers.json_lines(spark, str(tmp_path / "j"), REC).count() == 1
