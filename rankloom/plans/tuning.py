"""Searches over the ranker's parameters as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tuning as TU
from ..staging import stage
from .base import TOKENS, Book, table, view
from .evaluation import TRUTH
from .ranking import COUNTS_SQL, FIELDED, NAMING, counted

BOOK = Book()
add = BOOK.add

# Tuning of the ranker's own parameters, on documents with three fields

TUNED = ["specialty", "description", "name"]
TUNING_RANGES = TU.BM25_RANGES | {f: TU.FIELD_RANGES[f] for f in TUNED}


def draws_sql(ranges, n):
    one = lambda k, lo, hi: f"round({lo}::DOUBLE + {hi - lo}::DOUBLE * (('0x' || substr(md5('tune/' || i || '/{k}'), 1, 8))::BIGINT)::DOUBLE / 4294967296::DOUBLE, 6) AS {k}"
    return f"c AS (SELECT i AS config, {', '.join(one(k, *r) for k, r in ranges.items())} FROM range({n}) t(i))"


NDCG_SQL = f"""truth AS (SELECT DISTINCT * FROM ({TRUTH})), nt AS (SELECT query_id, count(*) AS n_true FROM truth GROUP BY query_id),
m AS (SELECT config, r.query_id, round(sum(CASE WHEN t.doc_id IS NOT NULL THEN 1 / log2(r.rank + 1) ELSE 0 END) / any_value(list_sum(list_transform(range(1, least(n_true, 12) + 1), lambda i: 1 / log2(i + 1)))), 9) AS ndcg FROM r JOIN nt USING (query_id) LEFT JOIN truth t ON t.query_id = r.query_id AND t.doc_id = r.doc_id GROUP BY config, r.query_id)"""


def tuned_sql(n):
    return f"""{draws_sql(TUNING_RANGES, n)}, q AS ({NAMING}), d AS ({FIELDED}), tok AS (SELECT doc_id, {TOKENS.format('specialty')} AS a, {TOKENS.format('description')} AS t, {TOKENS.format('name')} AS s FROM d),
means AS (SELECT count(*)::DOUBLE AS n, avg(len(a)) AS ma, avg(len(t)) AS mt, avg(len(s)) AS ms FROM tok),
post AS (SELECT doc_id, term, count(*) FILTER (f = 0) AS na, count(*) FILTER (f = 1) AS nt, count(*) FILTER (f = 2) AS ns FROM (SELECT doc_id, 0 AS f, unnest(a) AS term FROM tok UNION ALL SELECT doc_id, 1, unnest(t) FROM tok UNION ALL SELECT doc_id, 2, unnest(s) FROM tok) GROUP BY ALL),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format('text')}) AS term FROM q) GROUP BY ALL),
w AS (SELECT term, greatest(0::DOUBLE, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)) AS idf FROM (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term), means),
g AS (SELECT *, greatest(1, floor(specialty + 0.5)) AS ra, greatest(1, floor(description + 0.5)) AS rt, greatest(1, floor(name + 0.5)) AS rs FROM c),
h AS (SELECT config, query_id, post.doc_id, qtf * idf AS weight, k1, b, na * ra + nt * rt + ns * rs AS tf, len(a) * ra + len(t) * rt + len(s) * rs AS dl, ma * ra + mt * rt + ms * rs AS avgdl FROM post JOIN qt USING (term) JOIN w USING (term) JOIN tok ON tok.doc_id = post.doc_id, means, g),
sc AS (SELECT config, query_id, doc_id, round(sum(weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))), 6) AS score FROM h GROUP BY ALL),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 12), {NDCG_SQL}"""


def tuned_statistics(spark, sf):
    return TU.statistics(TU.occurrences(view(spark, sf, FIELDED), TUNED), view(spark, sf, NAMING))


@add("tune_bm25_fields", f"WITH {tuned_sql(50)} SELECT config, k1, b, specialty, description, name, round(avg(ndcg), 6) AS ndcg FROM c JOIN m USING (config) GROUP BY ALL")
def _(spark, sf):
    configs = TU.draws(spark, TUNING_RANGES, 50)
    found = TU.ndcg(TU.rank_configs(tuned_statistics(spark, sf), configs, TUNED), view(spark, sf, TRUTH))
    return configs.join(found.groupBy("config").agg(F.round(F.avg("ndcg"), 6).alias("ndcg")), "config")


@add("tune_halving", f"""WITH {tuned_sql(16)}, p AS (SELECT item_id AS query_id, CASE WHEN item_id % 4 = 3 THEN 'holdout' ELSE 'train' END AS split, row_number() OVER (PARTITION BY item_id % 4 = 3 ORDER BY md5(item_id::VARCHAR), item_id) AS place FROM benchmark), n AS (SELECT count(*) AS n FROM p WHERE split = 'train'),
r1 AS (SELECT *, row_number() OVER (ORDER BY train DESC, config) AS i FROM (SELECT config, round(avg(ndcg), 9) AS train FROM m JOIN p USING (query_id), n WHERE split = 'train' AND place <= ceil(n / 4e0) GROUP BY config)),
r2 AS (SELECT *, row_number() OVER (ORDER BY train DESC, config) AS i FROM (SELECT config, round(avg(ndcg), 9) AS train FROM m JOIN p USING (query_id), n WHERE split = 'train' AND place <= ceil(n / 2e0) AND config IN (SELECT config FROM r1 WHERE i <= 8) GROUP BY config)),
r3 AS (SELECT config, round(avg(ndcg), 9) AS train FROM m JOIN p USING (query_id) WHERE split = 'train' AND config IN (SELECT config FROM r2 WHERE i <= 4) GROUP BY config),
x AS (SELECT config, 0 AS rounds_survived, train FROM r1 WHERE i > 8 UNION ALL SELECT config, 1, train FROM r2 WHERE i > 4 UNION ALL SELECT config, 3, train FROM r3), o AS (SELECT config, round(avg(ndcg), 9) AS holdout FROM m JOIN p USING (query_id) WHERE split = 'holdout' AND config IN (SELECT config FROM r3) GROUP BY config)
SELECT x.config, rounds_survived, round(train, 6) AS train, round(holdout, 6) AS holdout FROM x LEFT JOIN o ON x.config = o.config""")
def _(spark, sf):
    stats, truth = tuned_statistics(spark, sf), view(spark, sf, TRUTH)
    cases = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 4 == 3, "holdout").otherwise("train").alias("split"))
    evaluate = lambda configs, ids: TU.ndcg(TU.rank_configs(stats.of(ids), configs, TUNED), truth)
    found = TU.halving(evaluate, TU.draws(spark, TUNING_RANGES, 16), cases)
    return found.select("config", "rounds_survived", F.round("train", 6).alias("train"), F.round("holdout", 6).alias("holdout"))


TIER_POINTS = """CASE WHEN high >= 2 THEN high_signal_2 WHEN high = 1 THEN high_signal_1 ELSE 0 END + CASE WHEN pathway >= 3 THEN pathway_3 WHEN pathway = 2 THEN pathway_2 WHEN pathway = 1 THEN pathway_1 ELSE 0 END + procedure_per_match * procedure
 + least(anchor_per_match * anchor, anchor_cap) + CASE WHEN safe >= 3 THEN safe_lane_3_or_more WHEN safe = 2 THEN safe_lane_2 WHEN safe = 1 THEN safe_lane_1 ELSE 0 END + least(subspecialty_factor * sub, subspecialty_cap) + CASE WHEN neg >= 4 THEN negative_4 WHEN neg >= 2 THEN negative_2 WHEN neg = 1 THEN negative_1 ELSE 0 END"""


@add("tune_rescoring", f"""WITH {COUNTS_SQL}, {draws_sql(TU.RESCORE_RANGES, 30)}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY tier DESC, score DESC, doc_id) AS rank FROM (SELECT config, query_id, doc_id, score, round({TIER_POINTS}, 6) AS tier FROM k, c)) WHERE rank <= 12), {NDCG_SQL}
SELECT config, round(avg(ndcg), 6) AS ndcg FROM m GROUP BY config""")
def _(spark, sf):
    counts = counted(spark, sf).select("query_id", "doc_id", "score", "high", "pathway", "procedure", "anchor", "safe", F.col("sub").alias("subspecialty"), F.col("neg").alias("negative"))
    found = TU.ndcg(TU.rescore_configs(stage(counts, "tuning-counts"), TU.draws(spark, TU.RESCORE_RANGES, 30)), view(spark, sf, TRUTH))
    return found.groupBy("config").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"))

