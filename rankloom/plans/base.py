"""How queries are registered, and the stand-ins that map domain entities onto the test tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..staging import shared_dir as shared_dir  # used by the modules of queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Book:
    """Queries and their SQL by name."""

    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str):
        def keep(f):
            self.queries[name] = f
            self.oracles[name] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, **given: DataFrame) -> DataFrame:
    """A stand-in's SQL over the test tables; the same text serves as the oracle's subquery.  ``given`` has tables that are dealt out otherwise."""
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    plain = sql.replace("{", "{{").replace("}", "}}")
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", plain)
    return spark.sql(text, **{t: given[t] if t in given else table(spark, sf_dir, t) for t in used})


#: Practitioners: suppliers with quality signals that cross every tier, and the place of their nation.
PRACTITIONERS = """
SELECT s_suppkey AS doc_id, s_name AS name, n_name AS locality, r_name AS region, n_nationkey AS nation,
       3e0 + (s_suppkey % 21) * 1e-1 AS rating, (s_suppkey * 7) % 130 AS reviews, s_suppkey % 30 AS years, s_acctbal > 0 AS verified,
       499e-1 + 4e-1 * n_nationkey AS lat, -75e-1 + 35e-2 * n_nationkey AS lon,
       chr(CAST(65 + n_nationkey AS INT)) || CAST(s_suppkey % 20 + 1 AS VARCHAR(9)) || ' ' || CAST(s_suppkey % 9 + 1 AS VARCHAR(9)) || 'AB' AS postcode,
       CASE s_suppkey % 5 WHEN 0 THEN 'Mr' WHEN 1 THEN 'Mrs' WHEN 2 THEN 'Dr' WHEN 3 THEN NULL ELSE 'Miss' END AS title
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

#: Queries and corpus of the text ranking.
QUERIES = "SELECT item_id AS query_id, text FROM benchmark"
TOKENS = r"list_filter(string_split_regex(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda x: len(x) > 2)"


def bm25_sql(queries: str = QUERIES, corpus: str = "SELECT doc_id, text FROM documents", variant: str = "production", k1: float = 1.5, b: float = 0.75) -> str:
    """Common table expressions that end in ``scores`` (query_id, doc_id, score)."""
    x = "(n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)"
    idf = {"production": f"greatest(0::DOUBLE, ln({x} + 1))", "local": f"greatest(0::DOUBLE, ln({x}))", "mini": f"ln({x} + 1)"}[variant]
    qtf = "1" if variant == "mini" else "count(*)"
    return f"""
q AS ({queries}),
corpus AS ({corpus}),
tok AS (SELECT doc_id, {TOKENS.format("text")} AS t FROM corpus),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM tok),
post AS (SELECT doc_id, dl, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
qt AS (SELECT query_id, term, {qtf} AS qtf FROM (SELECT query_id, unnest({TOKENS.format("text")}) AS term FROM q) GROUP BY ALL),
w AS (SELECT term, {idf} AS idf FROM (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term), stats),
scores AS (
  SELECT query_id, doc_id, round(sum(qtf * idf * tf * ({k1} + 1)::DOUBLE / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / avgdl))), 6) AS score
  FROM post JOIN qt USING (term) JOIN w USING (term), stats GROUP BY query_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores)"""
