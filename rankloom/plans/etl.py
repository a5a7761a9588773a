"""Merging, chat logs and the tracker as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import merge as MG
from ..operators import sessions as S
from ..sources.store import Store
from ..staging import fresh_path
from ..streaming import tracker
from .base import TOKENS, Book, shared_dir, table, view

BOOK = Book()
add = BOOK.add
L = lambda s: F.lit(s)

#: Three generations of records: base, and two that replace part of it.
GENERATIONS = """g AS (SELECT c_custkey AS id, c_mktsegment AS v, 0 AS origin FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, lower(c_mktsegment), 1 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT CASE WHEN c_custkey % 25 <> 0 THEN c_custkey END, c_name, 2 FROM customer WHERE c_custkey % 5 = 0)"""


def generations(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return [c.where(k % 2 == 0).select(k.alias("id"), F.col("c_mktsegment").alias("v")), c.where(k % 3 == 0).select(k.alias("id"), F.lower("c_mktsegment").alias("v")), c.where(k % 5 == 0).select(F.when(k % 25 != 0, k).alias("id"), F.col("c_name").alias("v"))]


@add("upsert_precedence", f"WITH {GENERATIONS} SELECT id, v, origin FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY origin DESC) AS n FROM g WHERE id IS NOT NULL) WHERE n = 1")
def _(spark, sf):
    return MG.upsert(generations(spark, sf), "id").select("id", "v", "origin")


@add("store_changes", f"WITH {GENERATIONS}, w AS (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY origin DESC) AS n FROM g WHERE id IS NOT NULL), k AS (SELECT id, v FROM w WHERE n = 1 AND id % 7 <> 0) SELECT id, v FROM k UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT id FROM k)")
def _(spark, sf):
    store = Store(spark, fresh_path(spark, "store"), "id long, v string", "id", 16)
    for generation in generations(spark, sf):
        store.upsert(generation)
    store.delete(table(spark, sf, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("id")))
    store.insert_new(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v")))
    return store.read()


@add("insert_new_only", f"WITH {GENERATIONS} SELECT id, v FROM g WHERE origin = 0 UNION ALL SELECT id, v FROM g WHERE origin = 2 AND (id IS NULL OR id NOT IN (SELECT id FROM g WHERE origin = 0))")
def _(spark, sf):
    base, _, new = generations(spark, sf)
    return MG.insert_new(base, new, "id")


@add("insurer_canonical", """WITH r AS (SELECT c_custkey AS id, [c_mktsegment, 'Bldg', lower(c_mktsegment), 'plan ' || (c_nationkey % 3)::VARCHAR] AS names FROM customer), a(variant, canonical) AS (VALUES ('bldg', 'Building'), ('MACHINERY', 'Machines'), ('plan 1', 'Plan One')),
e AS (SELECT id, unnest(names) AS raw, generate_subscripts(names, 1) AS pos FROM r), n AS (SELECT id, pos, coalesce(canonical, raw) AS name FROM e LEFT JOIN a ON lower(raw) = lower(variant)),
f AS (SELECT id, lower(name) AS k, min(pos) AS pos, arg_min(name, pos) AS name FROM n GROUP BY id, lower(name)) SELECT id, string_agg(name, '|' ORDER BY pos) AS names FROM f GROUP BY id""")
def _(spark, sf):
    names = F.array("c_mktsegment", L("Bldg"), F.lower("c_mktsegment"), F.concat(L("plan "), (F.col("c_nationkey") % 3).cast("string")))
    aliases = spark.createDataFrame([("bldg", "Building"), ("MACHINERY", "Machines"), ("plan 1", "Plan One")], "variant string, canonical string")
    return MG.canonical_names(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), names.alias("names")), aliases).select("id", F.array_join("names", "|").alias("names"))


@add("volume_union", "SELECT s_suppkey AS id, 'a' AS src, s_acctbal AS volume FROM supplier UNION ALL SELECT s_suppkey, 'b', TRY_CAST(right(s_name, 3) AS DOUBLE) FROM supplier")
def _(spark, sf):
    tagged = F.array(F.struct(L("a").alias("src"), F.col("s_acctbal").alias("volume")), F.struct(L("b").alias("src"), F.expr("try_cast(right(s_name, 3) as double)").alias("volume")))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(tagged).alias("x")).select("id", "x.src", "x.volume")


@add("constant_patch", "SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'patched' ELSE lang END AS specialty FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.when(F.array_contains(F.array(L("src1"), L("src2")), F.col("source")), "patched").otherwise(F.col("lang")).alias("specialty"))


@add("profile_card", "SELECT p_partkey AS doc_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS idx, left(p_name, 12) AS short, format('{:.2f} GBP', round(p_retailprice, 2)) AS fee FROM part")
def _(spark, sf):
    from pyspark.sql import Window

    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("idx"), F.substring("p_name", 1, 12).alias("short"), F.format_string("%.2f GBP", F.round("p_retailprice", 2)).alias("fee"))


@add("patient_text", "SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS digest FROM conversations WHERE role = 'user' GROUP BY conv_id")
def _(spark, sf):
    return S.patient_text(table(spark, sf, "conversations")).select("conv_id", F.md5(F.col("patient_text").cast("binary")).alias("digest"))


#: A chat log of each conversation: every turn as a message with a recommendation, parts of which are missing or in another order here and there.
CHAT = """SELECT conv_id, turn, concat('[21:03, 11/02/2026] Jack: ', CAST(turn + 1 AS VARCHAR(9)), CASE WHEN turn % 2 = 0 THEN '. ' ELSE ')  ' END, 'Dr ', coalesce(role, ''), chr(10), chr(10),
  CASE WHEN conv_id % 5 <> 4 THEN concat('📍 Ward ', CAST(turn AS VARCHAR(9)), chr(10)) ELSE '' END, CASE WHEN conv_id % 3 <> 0 THEN concat(chr(10), ' Consultant ', role, chr(10)) ELSE '' END, chr(10),
  CASE WHEN turn % 3 = 0 THEN 'Why she may be a good fit: ' WHEN turn % 3 = 1 THEN concat('why HE may be a good fit:', chr(10)) ELSE concat('Best for: ', chr(10)) END, replace(coalesce(text, ''), '. ', concat('.', chr(10))), chr(10),
  CASE WHEN conv_id % 2 = 0 THEN chr(10) ELSE '' END, CASE WHEN turn % 3 <> 2 THEN concat('Best for: ', chr(10), 'those who', chr(10), 'ask') ELSE '' END, chr(10), '🔗 ', CASE WHEN conv_id % 7 <> 0 THEN concat('https://x/', CAST(conv_id AS VARCHAR(20)), ' now') ELSE 'none' END) AS chat FROM conversations"""


@add("chat_block_parse", rf"""WITH RECURSIVE chats AS ({CHAT}), bodies AS (SELECT conv_id, turn, unnest(list_filter(list_transform(string_split_regex(chat, '\[[^\]]+\]\s*[^:]+:\s*'), lambda b: regexp_replace(b, '^[\s\x0B\p{{Z}}\x{{FEFF}}]+|[\s\x0B\p{{Z}}\x{{FEFF}}]+$', '', 'g')), lambda b: b <> '')) AS body FROM chats),
blocks AS (SELECT row_number() OVER () AS b, conv_id, turn, list_transform(string_split_regex(body, '\r?\n'), lambda x: regexp_replace(x, '^[\s\x0B\p{{Z}}\x{{FEFF}}]+|[\s\x0B\p{{Z}}\x{{FEFF}}]+$', '', 'g')) AS lines FROM bodies),
walk(b, i, mode, location, title, why, best, link) AS (
  SELECT b, 1, '', NULL::VARCHAR, NULL::VARCHAR, ''::VARCHAR, ''::VARCHAR, NULL::VARCHAR FROM blocks WHERE regexp_matches(lines[1], '^\d+[.)]\s+.+$')
  UNION ALL
  SELECT b, i + 1, CASE kind WHEN 'place' THEN 'place' WHEN 'wait' THEN 'place' WHEN 'why' THEN 'why' WHEN 'why on' THEN 'why' WHEN 'best' THEN 'best' WHEN 'best on' THEN 'best' ELSE '' END,
    CASE kind WHEN 'place' THEN trim(x[2:]) ELSE location END, CASE kind WHEN 'title' THEN x ELSE title END,
    CASE kind WHEN 'why' THEN trim(regexp_replace(x, '(?i)^why (he|she) may be a good fit:', '')) WHEN 'why on' THEN trim(why || ' ' || x) ELSE why END,
    CASE kind WHEN 'best' THEN trim(regexp_replace(x, '(?i)^best for:', '')) WHEN 'best on' THEN trim(best || ' ' || x) ELSE best END,
    CASE kind WHEN 'link' THEN nullif(regexp_extract(x, '🔗\s*(https?:\S+)', 1), '') ELSE link END
  FROM (SELECT w.*, lines[i + 1] AS x, CASE
      WHEN mode = 'place' AND lines[i + 1] = '' THEN 'wait'
      WHEN mode = 'place' AND NOT starts_with(lines[i + 1], 'Why ') AND NOT starts_with(lines[i + 1], 'Best for') AND NOT starts_with(lines[i + 1], '🔗') THEN 'title'
      WHEN mode = 'why' AND lines[i + 1] <> '' AND NOT regexp_matches(lines[i + 1], '(?i)^best for:') AND NOT starts_with(lines[i + 1], '🔗') THEN 'why on'
      WHEN mode = 'best' AND lines[i + 1] <> '' AND NOT starts_with(lines[i + 1], '🔗') THEN 'best on'
      WHEN starts_with(lines[i + 1], '📍') THEN 'place' WHEN regexp_matches(lines[i + 1], '(?i)^why (he|she) may be a good fit:') THEN 'why' WHEN regexp_matches(lines[i + 1], '(?i)^best for:') THEN 'best'
      WHEN starts_with(lines[i + 1], '🔗') THEN 'link' ELSE '' END AS kind
    FROM walk w JOIN blocks USING (b) WHERE i < len(lines)))
SELECT conv_id, turn, regexp_extract(lines[1], '^(\d+)[.)]\s+(.+)$', 1)::INT AS rank, regexp_extract(lines[1], '^(\d+)[.)]\s+(.+)$', 2) AS name, location, title, nullif(why, '') AS why, nullif(best, '') AS best_for, link FROM walk JOIN blocks USING (b) WHERE i = len(lines)""")
def _(spark, sf):
    m = view(spark, sf, CHAT).select("conv_id", "turn", F.explode(S.messages(F.col("chat"))).alias("m"))
    return m.select("conv_id", "turn", S.recommendation(F.col("m.body")).alias("r")).where("r is not null").select("conv_id", "turn", "r.*")


@add("same_day_best_jaccard", f"""WITH c AS (SELECT conv_id AS left_id, conv_id % 31 AS day, list_distinct({TOKENS.format('text')}) AS a FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id)), d AS (SELECT doc_id AS right_id, doc_id % 31 AS day, list_distinct({TOKENS.format('text')}) AS b FROM documents),
s AS (SELECT left_id, right_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM c JOIN d USING (day))
SELECT left_id, right_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY similarity DESC, right_id) AS n FROM s WHERE similarity >= 0.08) WHERE n = 1""")
def _(spark, sf):
    left = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text")).select(F.col("conv_id").alias("left_id"), (F.col("conv_id") % 31).alias("day"), F.array_distinct(T.tokens(F.col("text"))).alias("a"))
    right = table(spark, sf, "documents").select(F.col("doc_id").alias("right_id"), (F.col("doc_id") % 31).alias("day"), F.array_distinct(T.tokens(F.col("text"))).alias("b"))
    return S.best_same_day(left, right)


@add("log_backfill", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'old' END AS first_entry FROM events")
def _(spark, sf):
    new = F.when(F.col("event_id") % 2 == 0, F.array("event_type"))
    return table(spark, sf, "events").select("event_id", F.get(S.migrate_log(new, F.array(L("old"))), 0).alias("first_entry"))


@add("tracker_tally", "SELECT user_id, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, round(100e0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM events GROUP BY user_id")
def _(spark, sf):
    events = table(spark, sf, "events")
    log = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    folder = shared_dir(spark)
    return tracker.with_shares(tracker.drain(tracker.running_tally(log, "user_id"), f"{folder}/tracker", ["user_id"]))


@add("windowed_tally", "SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS start, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    events = table(spark, sf, "events")
    log = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    # The table's stamps have no zone: they are taken as UTC, whatever the session's zone, and given back so.
    log = log.withColumn("ts", F.convert_timezone(L("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp"))
    counts = tracker.drain(tracker.windowed_tally(log, "user_id"), f"{shared_dir(spark)}/tracker", ["w", "user_id"])
    return counts.select(F.convert_timezone(F.current_timezone(), L("UTC"), F.col("w.start").cast("timestamp_ntz")).alias("start"), "user_id", "n")


@add("page_text", r"SELECT page_id, len(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')))::BIGINT AS n_chars FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(F.trim(F.regexp_replace(F.regexp_replace("html", r"<[^>]*>", " "), r"\s+", " "))).cast("long").alias("n_chars"))


@add("json_export", """SELECT event_id, '{"event_id":' || event_id::VARCHAR || ',"event_type":"' || event_type || '"}' AS line FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("line"))
