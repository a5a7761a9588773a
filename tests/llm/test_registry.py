"""Every registered query of the subpackage that SQL can state, against DuckDB."""

import duckdb
import pytest

from rankloom.llm import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = con.execute(registry.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(tuple(plain(v) for _, v in sorted(zip(names, row))) for row in cur.fetchall())


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")) == list(range(1, 14))


def test_pseudonyms_follow_the_key(spark):
    first = {r.doc_id: r.text for r in registry.QUERIES["op4_pseudonyms"](spark, SF).collect()}
    spark.conf.set("spark.rankloom.pii.key", "another")
    try:
        second = {r.doc_id: r.text for r in registry.QUERIES["op4_pseudonyms"](spark, SF).collect()}
    finally:
        spark.conf.unset("spark.rankloom.pii.key")
    assert first != second
