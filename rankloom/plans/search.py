"""Filters, scalar functions and joins as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import text as T
from ..operators import filters as FL
from ..operators import merge as MG
from .base import PRACTITIONERS, Book, table, view

BOOK = Book()
add = BOOK.add
L = lambda s: F.lit(s)

#: Customers with the lists that the attribute filters look at.
MEMBERS = "SELECT c_custkey AS doc_id, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation, c_acctbal AS balance FROM customer"


def members(spark, sf):
    m = view(spark, sf, MEMBERS)
    return m.withColumns({
        "insurers": F.when(F.col("doc_id") % 7 != 0, F.array(F.lower("segment"), F.concat(L("plan "), F.col("nation").cast("string")))),
        "groups": F.when(F.col("doc_id") % 5 != 0, F.array(F.when(F.col("doc_id") % 2 == 0, "Adults").otherwise("Children"), F.when(F.col("doc_id") % 3 == 0, "Paediatrics").otherwise("Older adults"))),
        "languages": F.array(F.when(F.col("doc_id") % 3 == 0, "French").otherwise("English"), F.when(F.col("doc_id") % 4 == 0, "German (basic)").otherwise("Urdu")),
        "gender": F.when(F.col("doc_id") % 4 == 0, "Male ").when(F.col("doc_id") % 4 == 1, "female"),
    })


MEMBERS_SQL = f"""m AS (SELECT *,
  CASE WHEN doc_id % 7 <> 0 THEN [lower(segment), 'plan ' || nation::VARCHAR] END AS insurers,
  CASE WHEN doc_id % 5 <> 0 THEN [CASE WHEN doc_id % 2 = 0 THEN 'Adults' ELSE 'Children' END, CASE WHEN doc_id % 3 = 0 THEN 'Paediatrics' ELSE 'Older adults' END] END AS groups,
  [CASE WHEN doc_id % 3 = 0 THEN 'French' ELSE 'English' END, CASE WHEN doc_id % 4 = 0 THEN 'German (basic)' ELSE 'Urdu' END] AS languages,
  CASE doc_id % 4 WHEN 0 THEN 'Male ' WHEN 1 THEN 'female' END AS gender FROM ({MEMBERS}))"""


@add("filter_blacklist", "SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT coalesce(l.toxic = 1, false)")
def _(spark, sf):
    flags = table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 1).alias("blacklisted"))
    return table(spark, sf, "documents").join(flags, "doc_id", "left").where(FL.not_blacklisted(F.col("blacklisted"))).select("doc_id", "source")


@add("filter_language_any", f"WITH {MEMBERS_SQL} SELECT doc_id, name FROM m WHERE len(list_filter(languages, lambda x: contains(lower(x), 'german') OR contains('german', lower(x)) OR contains(lower(x), 'french (fluent)') OR contains('french (fluent)', lower(x)))) > 0")
def _(spark, sf):
    return members(spark, sf).where(FL.speaks(F.col("languages"), ["German", "french (fluent)"])).select("doc_id", "name")


@add("filter_bidirectional_contains", f"WITH {MEMBERS_SQL} SELECT doc_id, segment FROM m WHERE coalesce(len(list_filter(insurers, lambda x: contains(lower(x), 'building') OR contains('building', lower(x)))) > 0, false)")
def _(spark, sf):
    return members(spark, sf).where(FL.insured_by(F.col("insurers"), " Building ")).select("doc_id", "segment")


@add("filter_age_group", f"WITH {MEMBERS_SQL} SELECT doc_id FROM m WHERE coalesce(len(list_filter(groups, lambda g: contains(lower(g), 'young children') OR contains('young children', lower(g)) OR regexp_matches(lower(g), 'child|paediatric|pediatric'))) > 0, false)")
def _(spark, sf):
    return members(spark, sf).where(FL.treats_age(F.col("groups"), "Young children ")).select("doc_id")


@add("filter_composite", f"""WITH {MEMBERS_SQL} SELECT doc_id, name FROM m
WHERE coalesce(len(list_filter(insurers, lambda x: contains(lower(x), 'machinery') OR contains('machinery', lower(x)))) > 0, false)
  AND coalesce(lower(trim(gender)) = 'female', false)
  AND coalesce(len(list_filter(groups, lambda g: contains(lower(g), 'adults') OR contains('adults', lower(g)))) > 0, false)
  AND len(list_filter(languages, lambda x: contains(lower(x), 'english') OR contains('english', lower(x)) OR contains(lower(x), 'urdu') OR contains('urdu', lower(x)))) > 0""")
def _(spark, sf):
    wanted = FL.composite(F.col("insurers"), F.col("gender"), F.col("groups"), F.col("languages"), insurance="machinery", wanted_gender="Female", age="adults", wanted_languages=["English", "Urdu"])
    return members(spark, sf).where(wanted).select("doc_id", "name")


@add("infer_class_from_pronouns", r"""WITH t AS (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_]+') AS w FROM documents),
c AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('he', 'him', 'his', 'himself'))) AS he, len(list_filter(w, lambda x: x IN ('she', 'her', 'hers', 'herself'))) AS she FROM t)
SELECT doc_id, CASE WHEN he >= 2 AND he > she THEN 'male' WHEN she >= 2 AND she > he THEN 'female' END AS gender FROM c""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", FL.inferred_gender(F.lit(None).cast("string"), F.col("text")).alias("gender"))


@add("filter_gender_inferred", f"WITH p AS ({PRACTITIONERS}) SELECT doc_id, title FROM p WHERE title IS NULL OR title NOT IN ('Mrs', 'Miss')")
def _(spark, sf):
    gender = FL.inferred_gender(F.col("title"), F.lit(""))
    return view(spark, sf, PRACTITIONERS).where(FL.gender_allows(gender, "male")).select("doc_id", "title")


@add("filter_specialty_terms", r"""WITH n AS (SELECT p_partkey AS doc_id, p_brand, trim(regexp_replace(lower(p_type), '[^a-z0-9\s]', ' ', 'g')) AS own, p_size % 4 = 0 AS has_subs, trim(regexp_replace(lower(p_name), '[^a-z0-9\s]', ' ', 'g')) AS sub, CASE WHEN p_size % 3 = 0 THEN lower(p_name) || ' promoted' ELSE '' END AS expertise, CASE WHEN p_size % 7 = 0 THEN 'steelworker' END AS title FROM part)
SELECT doc_id FROM n WHERE contains(own, 'promo  steel') OR contains('promo  steel', own) OR (has_subs AND (contains(sub, 'promo') OR contains(sub, 'steel'))) OR contains(expertise, 'promo') OR contains(expertise, 'steel') OR coalesce(contains(title, 'promo') OR contains(title, 'steel'), false)""")
def _(spark, sf):
    c = F.col
    match = FL.specialty_matches(c("p_type"), F.when(c("p_size") % 4 == 0, F.array("p_name")), F.when(c("p_size") % 3 == 0, F.concat("p_name", L(" Promoted"))).otherwise(""), F.when(c("p_size") % 7 == 0, "Steelworker"), "Promo, Steel")
    return table(spark, sf, "part").where(match).select(c("p_partkey").alias("doc_id"))


HAV = "3958.8::DOUBLE * 2 * atan2(sqrt({h}), sqrt(1 - {h}))".format(h="(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))")
CENTRE = {"lat1": "51.5::DOUBLE", "lon1": "-0.5::DOUBLE", "lat2": "lat", "lon2": "lon"}


def miles():
    return G.haversine(F.lit(51.5), F.lit(-0.5), F.col("lat"), F.col("lon"))


@add("haversine_matrix", f"WITH p AS (SELECT n_name, 499e-1 + 4e-1 * n_nationkey AS lat, -75e-1 + 35e-2 * n_nationkey AS lon FROM nation) SELECT a.n_name AS a, b.n_name AS b, round({HAV.format(lat1='a.lat', lon1='a.lon', lat2='b.lat', lon2='b.lon')}, 4) AS miles FROM p a JOIN p b ON a.n_name < b.n_name")
def _(spark, sf):
    p = view(spark, sf, "SELECT n_name, 499e-1 + 4e-1 * n_nationkey AS lat, -75e-1 + 35e-2 * n_nationkey AS lon FROM nation")
    a, b = p.alias("a"), p.alias("b")
    d = G.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return a.join(b, F.col("a.n_name") < F.col("b.n_name")).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"), F.round(d, 4).alias("miles"))


@add("radius_filter", f"WITH p AS ({PRACTITIONERS}) SELECT doc_id, round({HAV.format(**CENTRE)}, 4) AS miles FROM p WHERE {HAV.format(**CENTRE)} <= 300")
def _(spark, sf):
    return view(spark, sf, PRACTITIONERS).withColumn("m", miles()).where("m <= 300").select("doc_id", F.round("m", 4).alias("miles"))


@add("nearest_district", r"""WITH s AS (SELECT s_suppkey AS doc_id, chr((65 + s_nationkey)::INT) AS area, (s_suppkey * 13 % 60)::INT AS num FROM supplier),
c AS (SELECT chr((65 + n_nationkey)::INT) AS area, k AS num FROM nation, (SELECT unnest([1, 9, 25, 47]) AS k))
SELECT doc_id, area, arg_min(c.num, abs(c.num - s.num) * 1000 + c.num)::INT AS nearest FROM s JOIN c USING (area) GROUP BY doc_id, area""")
def _(spark, sf):
    s = view(spark, sf, "SELECT s_suppkey AS doc_id, chr(CAST(65 + s_nationkey AS INT)) AS area, CAST(s_suppkey * 13 % 60 AS INT) AS num FROM supplier")
    c = view(spark, sf, "SELECT chr(CAST(65 + n_nationkey AS INT)) AS area FROM nation").select("area", F.explode(F.array(*[F.lit(k) for k in (1, 9, 25, 47)])).alias("centre"))
    return s.join(c, "area").groupBy("doc_id", "area").agg(F.min(F.struct(F.abs(F.col("centre") - F.col("num")), "centre")).alias("x")).select("doc_id", "area", F.col("x.centre").alias("nearest"))


@add("location_any_all", f"""WITH p AS ({PRACTITIONERS}), loc AS (SELECT doc_id, locality, postcode, lat, lon FROM p UNION ALL SELECT doc_id + 1, locality, postcode, lat, lon FROM p)
SELECT DISTINCT doc_id FROM p WHERE doc_id IN (SELECT doc_id FROM loc WHERE upper(replace(postcode, ' ', '')) LIKE 'H1%' AND {HAV.format(**CENTRE)} <= 400)""")
def _(spark, sf):
    p = view(spark, sf, PRACTITIONERS)
    locations = p.select("doc_id", "postcode", "lat", "lon").unionByName(p.select((F.col("doc_id") + 1).alias("doc_id"), "postcode", "lat", "lon"))
    return FL.where_any_location(p, locations, G.match_postcode(F.col("postcode"), L("H1")) & (miles() <= 400)).select("doc_id")


@add("postcode_parse", f"""WITH p AS ({PRACTITIONERS}), c AS (SELECT doc_id, postcode, upper(replace(postcode, ' ', '')) AS c FROM p)
SELECT doc_id, c AS compact, left(c, len(c) - 3) AS district, regexp_extract(c, '^[A-Z]+') AS area, regexp_extract(upper('at ' || postcode || ' near'), '\\b[A-Z]{{1,2}}[0-9][A-Z0-9]?\\s*[0-9][A-Z]{{2}}\\b') AS found FROM c""")
def _(spark, sf):
    pc = F.col("postcode")
    return view(spark, sf, PRACTITIONERS).select("doc_id", G.compact(pc).alias("compact"), G.district(pc).alias("district"), G.area(pc).alias("area"), G.find_postcode(F.concat(L("at "), pc, L(" near"))).alias("found"))


@add("name_search", f"WITH {MEMBERS_SQL} SELECT doc_id, name, count(*) OVER () AS total FROM m WHERE contains(lower(name), '00001') ORDER BY doc_id LIMIT 100")
def _(spark, sf):
    return FL.name_search(members(spark, sf).withColumn("alternatives", F.array("segment")), "00001", 100).select("doc_id", "name", "total")


@add("name_normalise", f"""WITH p AS ({PRACTITIONERS}), t AS (SELECT doc_id, coalesce(title || '. ', '') || name AS raw FROM p)
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(trim(raw)), '^(dr|mr|mrs|ms|miss|prof|professor)\\.?\\s+', ''), '\\s+', ' ', 'g')) AS name_key FROM t""")
def _(spark, sf):
    raw = F.concat(F.coalesce(F.concat("title", L(". ")), L("")), "name")
    return view(spark, sf, PRACTITIONERS).select("doc_id", T.normalise_name(raw).alias("name_key"))


@add("phone_quote_slug", r"""SELECT c_custkey AS doc_id, '+' || regexp_replace('(0' || c_custkey::VARCHAR || ') 55-' || c_nationkey::VARCHAR, '[^0-9]', '', 'g') AS phone,
regexp_replace(trim('"“' || c_mktsegment || '”"'), '^["''“”‘’\s]+|["''“”‘’\s]+$', '', 'g') AS bare, regexp_replace(regexp_replace(lower(trim(c_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM customer""")
def _(spark, sf):
    phone = F.concat(L("(0"), F.col("c_custkey").cast("string"), L(") 55-"), F.col("c_nationkey").cast("string"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), T.normalise_phone(phone).alias("phone"), T.strip_quotes(F.concat(L('"“'), "c_mktsegment", L('”"'))).alias("bare"), T.slug(F.col("c_name")).alias("slug"))


@add("expertise_parse", r"""WITH e AS (SELECT p_partkey AS doc_id, list_transform(string_split('Procedure: ' || p_name || '; Condition: ' || p_type || ';Clinical Interests: ' || p_brand || '; Procedure: second', ';'), lambda x: trim(x)) AS parts FROM part)
SELECT doc_id, array_to_string(list_transform(list_filter(parts, lambda x: starts_with(x, 'Procedure:')), lambda x: trim(substr(x, 11))), '|') AS procedures,
array_to_string(list_transform(list_filter(parts, lambda x: starts_with(x, 'Condition:')), lambda x: trim(substr(x, 11))), '|') AS conditions, trim(substr(list_filter(parts, lambda x: starts_with(x, 'Clinical Interests:'))[-1], 20)) AS interests FROM e""")
def _(spark, sf):
    text = F.concat(L("Procedure: "), "p_name", L("; Condition: "), "p_type", L(";Clinical Interests: "), "p_brand", L("; Procedure: second"))
    e = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), MG.expertise(text).alias("e"))
    return e.select("doc_id", F.array_join("e.procedures", "|").alias("procedures"), F.array_join("e.conditions", "|").alias("conditions"), F.col("e.interests").alias("interests"))


@add("json_props_extract", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@add("md5_ids", "SELECT page_id, md5(url || '|' || page_id::VARCHAR) AS id FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(F.concat("url", L("|"), F.col("page_id").cast("string")).cast("binary")).alias("id"))


@add("url_coalesce", r"SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 THEN '' END || NULL, CASE WHEN page_id % 3 = 1 THEN url END, regexp_extract(html, 'https?://[^\s\"''<>]+')) AS url FROM pages")
def _(spark, sf):
    none = F.when(F.col("page_id") % 3 == 0, " ").otherwise("null")
    found = F.regexp_extract("html", r"https?://[^\s\"'<>]+", 0)
    return table(spark, sf, "pages").select("page_id", F.coalesce(MG.first_present(none, F.when(F.col("page_id") % 3 == 1, F.col("url")), found), L("")).alias("url"))


@add("nhs_filter", "SELECT s_suppkey AS doc_id FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
def _(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.when(F.col("s_suppkey") % 2 == 0, "base").otherwise(" ").alias("base"), F.when(F.col("s_suppkey") % 3 == 0, F.array(L("post"))).alias("posts"))
    return s.where(FL.has_nhs(F.col("base"), F.col("posts"))).select("doc_id")


@add("specialty_from_query", r"SELECT item_id AS query_id, CASE WHEN regexp_matches(lower(text), '\bth[a-z]*(ing|tion)\b') THEN 'a' WHEN regexp_matches(lower(text), 'que|eau') THEN 'b' END AS specialty FROM benchmark")
def _(spark, sf):
    t = F.lower("text")
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.when(t.rlike(r"(?<![a-z0-9_])th[a-z]*(ing|tion)(?![a-z0-9_])"), "a").when(t.rlike("que|eau"), "b").alias("specialty"))


@add("remote_consultation", "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 2 = 0 ELSE c_custkey % 3 = 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_nationkey IN (4, 6) END AS remote FROM customer")
def _(spark, sf):
    k = F.col("c_custkey")
    remote = MG.remote_consultation(F.when(k % 5 == 0, k % 2 == 0), [k % 3 == 0], F.array(F.when(F.col("c_mktsegment") == "BUILDING", "Video call").when(F.col("c_mktsegment") == "MACHINERY", "Telehealth").otherwise("in person")), F.array(F.when(F.col("c_nationkey") == 4, "Online clinic").when(F.col("c_nationkey") == 5, "Remote valley").when(F.col("c_nationkey") == 6, "Video consultation").when(F.col("c_nationkey") == 7, "Video hire").otherwise("Main site")))
    return table(spark, sf, "customer").select(k.alias("doc_id"), remote.alias("remote"))


@add("left_anti_unseen", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@add("left_semi_valid", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@add("name_map_last_wins", "WITH k AS (SELECT lower(trim(c_mktsegment)) || '/' || (c_nationkey % 5)::VARCHAR AS name_key, c_custkey AS id, c_custkey AS pos FROM customer UNION ALL SELECT lower(c_name), c_custkey, c_custkey FROM customer) SELECT name_key, arg_max(id, pos) AS id FROM k GROUP BY name_key")
def _(spark, sf):
    keys = F.array(F.concat(F.lower(F.trim("c_mktsegment")), L("/"), (F.col("c_nationkey") % 5).cast("string")), F.lower("c_name"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.explode(keys).alias("name_key"))
    return c.groupBy("name_key").agg(F.max_by("id", "id").alias("id"))


@add("fuzzy_fallback_join", """WITH w AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE split_part(p_type, ' ', 1) END AS wanted FROM part), t AS (SELECT p_type AS name, min(p_partkey) AS pos FROM part GROUP BY p_type),
x AS (SELECT id, wanted, arg_min(t.name, (CASE WHEN t.name = wanted THEN 0 ELSE 1000000000 END) + t.pos) AS name FROM w LEFT JOIN t ON t.name = wanted OR contains(lower(t.name), lower(wanted)) GROUP BY id, wanted) SELECT id, wanted, name FROM x""")
def _(spark, sf):
    part = table(spark, sf, "part")
    w = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.split_part("p_type", L(" "), L(1))).alias("wanted"))
    names = part.groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("pos"))
    exact = w.join(names.select("name"), F.col("wanted") == F.col("name"))
    # Only the distinct names that have no equal go through containment.
    rest = w.join(names.select(F.col("name").alias("wanted")), "wanted", "left_anti")
    some = rest.select("wanted").distinct().join(names, F.contains(F.lower("name"), F.lower("wanted"))).groupBy("wanted").agg(F.min_by("name", "pos").alias("name"))
    return exact.select("id", "wanted", "name").unionByName(rest.join(some, "wanted", "left").select("id", "wanted", "name"))


@add("blacklist_by_name", f"""WITH p AS ({PRACTITIONERS}), n AS (SELECT DISTINCT lower(trim(name)) AS k FROM p WHERE doc_id % 9 = 0) SELECT doc_id, lower(trim(name)) IN (SELECT k FROM n) AS blacklisted FROM p""")
def _(spark, sf):
    p = view(spark, sf, PRACTITIONERS)
    bad = p.where("doc_id % 9 = 0").select(T.normalise_name(F.concat(L("Dr. "), "name")).alias("name_key"))
    return MG.blacklist(p, bad, T.normalise_name(F.col("name"))).select("doc_id", "blacklisted")


@add("expansion_validate", r"""WITH t AS (SELECT item_id AS query_id, list_transform(string_split_regex(text, '\s+'), lambda x: lower(trim(x))) AS w FROM benchmark),
c AS (SELECT query_id, list_filter(w, lambda x: x <> '' AND NOT regexp_matches(x, '[{}\[\]:"]') AND x NOT IN ('the', 'and', 'de', 'la')) AS w FROM t),
n AS (SELECT query_id, w, len(w) AS n_all FROM c),
d AS (SELECT query_id, list_distinct(w) AS d FROM n) SELECT query_id, least(len(d), 50) + (CASE WHEN list_contains(d, 'required-term') THEN 0 ELSE 1 END) AS n FROM d""")
def _(spark, sf):
    out = FL.valid_expansion(F.split("text", r"\s+"), F.array(L("required-term")), ("the", "and", "de", "la"))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.size(out).cast("long").alias("n"))
