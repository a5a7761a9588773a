"""First and second ranking stage, rewriting and fusion as registered queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .. import api
from ..config import GENERIC_TERMS, PELVIC_SPECIALTIES, PELVIC_WORDS, RankingConfig
from ..functions import text as T
from ..operators import analytics as AN
from ..operators import boosts as B
from ..operators import conditions as CO
from ..operators import dictionary as DI
from ..operators import fusion as FU
from ..operators import index as IX
from ..operators import positions as PO
from ..operators import profiles as PR
from ..operators import progressive as PG
from ..operators import rescore as RS
from ..operators import rewrite as RW
from ..operators import shortlist as SL
from ..operators.bm25 import bm25, floors, min_max, ranked
from ..operators.phrases import bonuses
from ..staging import fresh_path, stage
from .base import PRACTITIONERS, QUERIES, TOKENS, Book, bm25_sql, table, view
from .search import HAV, CENTRE, miles

BOOK = Book()
add = BOOK.add
L = lambda s: F.lit(s)
DOCS = "SELECT doc_id, text FROM documents"
TOP = "SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= {n}"


def inputs(spark, sf):
    return view(spark, sf, QUERIES), view(spark, sf, DOCS)


def out(df):
    return df.select("query_id", "doc_id", "score", "rank")


@add("bm25_topk", f"WITH {bm25_sql()} {TOP.format(n=10)}")
def _(spark, sf):
    q, docs = inputs(spark, sf)
    return out(ranked(IX.build(docs).scores(q), 10))


@add("bm25_local_topk", f"WITH {bm25_sql(variant='local')} {TOP.format(n=10)}")
def _(spark, sf):
    return out(ranked(bm25(*inputs(spark, sf), RankingConfig(variant="local"), top=10), 10))


@add("bm25_dedup_terms", f"WITH {bm25_sql(variant='mini', k1=1.2, b=0.8)} SELECT query_id, doc_id, score, rank FROM ranked WHERE score > 0 AND rank <= 10")
def _(spark, sf):
    return out(ranked(bm25(*inputs(spark, sf), RankingConfig(variant="mini", k1=1.2, b=0.8), top=10).where("score > 0"), 10))


@add("bm25_merged_config", f"WITH {bm25_sql(k1=1.2)} {TOP.format(n=12)}")
def _(spark, sf):
    config = RankingConfig().merged(k1=1.2, b=None, top_n=None, top_k=12)
    return out(ranked(bm25(*inputs(spark, sf), config, top=config.top_k), config.top_k))


@add("bm25_field_weighted", f"WITH {bm25_sql(corpus='''SELECT doc_id, coalesce(text, '') || ' ' || lang || ' ' || lang || ' ' || lang || ' ' || source || ' ' || source AS text FROM documents''', queries='''SELECT item_id AS query_id, text || ' src1 src7' AS text FROM benchmark''')} {TOP.format(n=10)}")
def _(spark, sf):
    q = view(spark, sf, "SELECT item_id AS query_id, text || ' src1 src7' AS text FROM benchmark")
    return out(ranked(bm25(q, table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), fields={"text": 1, "lang": 3, "source": 2}, top=10), 10))


@add("bm25_filtered_corpus", f"WITH {bm25_sql(corpus='''SELECT d.doc_id, text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang = 'en' AND NOT coalesce(toxic = 1, false)''')} {TOP.format(n=10)}")
def _(spark, sf):
    q, _ = inputs(spark, sf)
    bad = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    docs = table(spark, sf, "documents").where("lang = 'en'").join(bad, "doc_id", "left_anti").select("doc_id", "text")
    return out(ranked(bm25(q, docs, top=10), 10))


VOLUME_SQL = f"""g AS (SELECT l_suppkey AS doc_id, lower(p_type) AS name, l_quantity AS n FROM lineitem JOIN part ON l_partkey = p_partkey),
v AS (SELECT doc_id, sum(CASE WHEN contains(name, 'promo') OR contains(name, 'brushed') THEN n ELSE 0 END) AS relevant, sum(n) AS total FROM g GROUP BY doc_id)"""


def volumes(spark, sf):
    terms = B.meaningful(F.array(*[L(t) for t in ("promo", "brushed", "surgery", "tin")]))
    g = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").join(table(spark, sf, "part").select("p_partkey", F.lower("p_type").alias("name")), F.col("l_partkey") == F.col("p_partkey"))
    relevant = F.exists(terms, lambda t: F.contains(F.col("name"), t))
    return g.groupBy(F.col("l_suppkey").alias("doc_id")).agg(F.sum(F.when(relevant, F.col("l_quantity")).otherwise(0.0)).alias("relevant"), F.sum("l_quantity").alias("total"))


@add("volume_relevance", f"WITH {VOLUME_SQL} SELECT doc_id, relevant::DOUBLE AS relevant, total::DOUBLE AS total, round(relevant / nullif(total, 0), 6) AS ratio FROM v")
def _(spark, sf):
    return volumes(spark, sf).withColumn("ratio", F.round(F.col("relevant") / F.nullif("total", L(0.0)), 6))


TIERS_SQL = """(CASE WHEN rating >= 4.8e0 THEN 1.3e0 WHEN rating >= 4.5e0 THEN 1.2e0 WHEN rating >= 4e0 THEN 1.1e0 ELSE 1e0 END
 * CASE WHEN reviews >= 100 THEN 1.2e0 WHEN reviews >= 50 THEN 1.15e0 WHEN reviews >= 20 THEN 1.1e0 ELSE 1e0 END
 * CASE WHEN years >= 20 THEN 1.15e0 WHEN years >= 10 THEN 1.1e0 ELSE 1e0 END * CASE WHEN verified THEN 1.1e0 ELSE 1e0 END)"""


@add("quality_boost", f"""WITH p AS ({PRACTITIONERS}), {VOLUME_SQL} SELECT p.doc_id, round({TIERS_SQL}, 6) AS quality,
round(CASE WHEN relevant >= 150 THEN 2.5e0 WHEN relevant >= 100 THEN 2.2e0 WHEN relevant >= 75 THEN 2e0 WHEN relevant >= 50 THEN 1.7e0 WHEN relevant >= 30 THEN 1.5e0 WHEN relevant >= 20 THEN 1.4e0
 WHEN relevant >= 10 THEN 1.3e0 WHEN relevant >= 5 THEN 1.2e0 WHEN relevant >= 1 THEN 1.1e0 WHEN relevant > 0 THEN 1e0 WHEN total > 0 THEN 0.85e0 ELSE 1e0 END, 6) AS volume FROM p LEFT JOIN (SELECT doc_id, relevant / 100 AS relevant, total FROM v) v ON p.doc_id = v.doc_id""")
def _(spark, sf):
    p = view(spark, sf, PRACTITIONERS).join(volumes(spark, sf), "doc_id", "left")
    quality = B.quality(F.col("rating"), F.col("reviews"), F.col("years"), F.col("verified"))
    return p.select("doc_id", F.round(quality, 6).alias("quality"), F.round(B.volume(F.col("relevant") / 100, F.col("total")), 6).alias("volume"))


PROX_SQL = "CASE WHEN d <= 1 THEN 1.6e0 WHEN d <= 2 THEN 1.5e0 WHEN d <= 3 THEN 1.4e0 WHEN d <= 5 THEN 1.3e0 WHEN d <= 8 THEN 1.2e0 WHEN d <= 12 THEN 1.1e0 WHEN d <= 18 THEN 1.05e0 ELSE 1e0 END"


@add("proximity_boost", f"WITH p AS ({PRACTITIONERS}), m AS (SELECT doc_id, {HAV.format(**CENTRE)} / 40 AS d FROM p) SELECT doc_id, round(d, 4) AS miles, {PROX_SQL} AS boost FROM m")
def _(spark, sf):
    return view(spark, sf, PRACTITIONERS).withColumn("d", miles() / 40).select("doc_id", F.round("d", 4).alias("miles"), B.proximity(F.col("d")).alias("boost"))


PHRASES_SQL = r"""qw AS (SELECT query_id, lower(trim(text)) AS q, list_filter(string_split_regex(lower(trim(text)), '\s+'), lambda x: len(x) > 2) AS w FROM q),
ph AS (SELECT query_id, q, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS p FROM qw)"""
PHRASE_SQL = "(CASE WHEN contains(lower(d.text), q) THEN 2e0 ELSE 0e0 END + len(list_filter(p, lambda x: contains(lower(d.text), x))))"


SIZE = RankingConfig().stage_a_size()


def shortlist(spark, sf, config=RankingConfig()):
    """The first stage's short list of every query, with both texts for the checks that follow."""
    q, docs = inputs(spark, sf)
    top = ranked(bm25(q, docs, config, top=SIZE), SIZE)
    return top.join(docs.withColumnRenamed("text", "body"), "doc_id").join(q.withColumnRenamed("text", "query"), "query_id")


@add("phrase_bonus", f"WITH {bm25_sql()}, {PHRASES_SQL} SELECT r.query_id, r.doc_id, {PHRASE_SQL} AS bonus FROM ranked r JOIN documents d USING (doc_id) JOIN ph USING (query_id) WHERE rank <= {SIZE}")
def _(spark, sf):
    q, docs = inputs(spark, sf)
    top = ranked(bm25(q, docs, top=SIZE), SIZE).select("query_id", "doc_id")
    return top.join(bonuses(q, docs, 3), ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("bonus", L(0.0)).alias("bonus"))


MINMAX_SQL = "CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1e0 END"


@add("minmax_normalise", f"WITH {bm25_sql()} SELECT query_id, doc_id, round({MINMAX_SQL}, 6) AS score FROM scores WINDOW w AS (PARTITION BY query_id)")
def _(spark, sf):
    return min_max(stage(bm25(*inputs(spark, sf)), "bm25-scores")).select("query_id", "doc_id", F.round("scaled", 6).alias("score"))


SEM_SQL = """c AS (SELECT label, list_transform(range(1, 65), lambda i: 0) AS z FROM embeddings GROUP BY label),
e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY label, i),
s AS (SELECT m.label AS query_id, e.vec_id AS doc_id, round(least(1e0, greatest(0e0, sum(m.x * e.x))), 6) AS score FROM e JOIN m USING (i) GROUP BY 1, 2)"""


#: Labels whose means travel in one row, about.
LABELS = 256


def semantic(spark, sf):
    """Similarity of every vector to the mean vector of each label, clamped to 0..1."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", "embedding")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    dot = F.aggregate(F.zip_with("embedding", "mean", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    # The labels are the query set: every vector meets them in blocks of at most so many, a row for each block.
    block = F.pmod(F.xxhash64("label"), F.greatest(L(1), F.ceil(F.col("labels") / LABELS)))
    sized = means.join(F.broadcast(means.agg(F.count(L(1)).alias("labels"))))
    every = sized.groupBy(block.alias("b")).agg(F.collect_list(F.struct(F.col("label").alias("query_id"), "mean")).alias("m"))
    pairs = e.drop("label").crossJoin(every.select("m")).select("*", F.explode("m").alias("x")).select("*", "x.query_id", "x.mean")
    return pairs.select("query_id", "doc_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot)), 6).alias("score"))


@add("semantic_topk", f"WITH {SEM_SQL} SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10")
def _(spark, sf):
    return out(ranked(semantic(spark, sf), 10))


@add("hybrid_semantic_bm25", f"""WITH {bm25_sql()}, n AS (SELECT query_id, doc_id, {MINMAX_SQL} AS nb FROM scores WINDOW w AS (PARTITION BY query_id)),
sem AS (SELECT vec_id AS doc_id, round(least(1e0, greatest(0e0, embedding[1]::DOUBLE * 4)), 6) AS sem FROM embeddings),
h AS (SELECT query_id, n.doc_id, round(nb + 0.3e0 * coalesce(sem, 0), 6) AS score FROM n LEFT JOIN sem ON n.doc_id = sem.doc_id)
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h) WHERE rank <= 10""")
def _(spark, sf):
    weight, top = RankingConfig().semantic_weight, 10
    scaled = min_max(stage(bm25(*inputs(spark, sf)), "bm25-scores")).withColumnRenamed("scaled", "nb")
    near = scaled.join(F.broadcast(floors(scaled, "nb", top, weight)), "query_id", "left").where("nb >= coalesce(floor, 0)").drop("floor")
    sem = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.get("embedding", 0).cast("double") * 4)), 6).alias("sem"))
    both = near.join(sem, "doc_id", "left").withColumn("score", F.round(F.col("nb") + weight * F.coalesce("sem", L(0.0)), 6))
    return out(ranked(both, top))


@add("negative_penalty", f"WITH {bm25_sql(variant='local')}, t AS (SELECT r.query_id, r.doc_id, r.score, len(list_filter(['trash', 'scum', 'loser', 'idiot'], lambda x: contains(lower(d.text), x))) AS n FROM ranked r JOIN documents d USING (doc_id) WHERE rank <= {SIZE}) SELECT query_id, doc_id, round(score * CASE WHEN n >= 2 THEN 0.85e0 WHEN n = 1 THEN 0.95e0 ELSE 1e0 END, 9) AS score FROM t")
def _(spark, sf):
    bad = F.array(*[L(w) for w in ("trash", "scum", "loser", "idiot")])
    n = T.count_contained(bad, F.lower("body"))
    return shortlist(spark, sf, config=RankingConfig(variant="local")).select("query_id", "doc_id", F.round(F.col("score") * B.negative(n), 9).alias("score"))


@add("empty_query_rank", f"WITH p AS ({PRACTITIONERS}) SELECT doc_id, locality, count(*) OVER (PARTITION BY locality) - row_number() OVER (PARTITION BY locality ORDER BY doc_id) + 1 AS score FROM p")
def _(spark, sf):
    made = PO.numbered(view(spark, sf, PRACTITIONERS).select("doc_id", "locality"), "locality", "doc_id")
    return made.select("doc_id", "locality", (F.col("of") - F.col("position") + 1).alias("score"))


HYPHEN = r"list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s-]', ' ', 'g'), '\s+'), lambda x: len(x) >= 2)"


@add("keyword_overlap_topk", f"""WITH q AS (SELECT item_id AS query_id, list_distinct({HYPHEN}) AS t FROM benchmark), s AS (SELECT query_id, doc_id, len(list_filter(t, lambda x: contains(lower(d.text), x))) AS score FROM q, documents d)
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""")
def _(spark, sf):
    return out(ranked(AN.keyword_overlap(*inputs(spark, sf), top=10), 10))


@add("keyword_weighted_score", "SELECT p_partkey AS doc_id, CASE WHEN p_brand <> 'Brand#1' AND p_size < 3 THEN -1 ELSE (CASE WHEN contains(lower(p_type), 'steel') THEN 3 ELSE 0 END) + (CASE WHEN contains(lower(p_name), 'part') THEN 2 ELSE 0 END) + (CASE WHEN p_size > 25 THEN 1 ELSE 0 END) END AS score FROM part")
def _(spark, sf):
    points = [(F.contains(F.lower("p_type"), L("steel")), 3), (F.contains(F.lower("p_name"), L("part")), 2), (F.col("p_size") > 25, 1)]
    total = reduce(lambda a, b: a + b, (F.when(c, n).otherwise(0) for c, n in points))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.when((F.col("p_brand") != "Brand#1") & (F.col("p_size") < 3), -1).otherwise(total).alias("score"))


@add("meaningful_terms", f"WITH t AS (SELECT item_id AS query_id, {TOKENS.format('text')} AS t FROM benchmark) SELECT query_id, len(list_filter(t, lambda x: len(x) > 3 AND x NOT IN ({', '.join(repr(w) for w in GENERIC_TERMS)})))::BIGINT AS n FROM t")
def _(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.size(B.meaningful(T.tokens(F.col("text")))).cast("long").alias("n"))


# Rewriting

ALIASES = [("the", "definite article", False, None), ("tion", "nominal", False, None), ("les", "plural article", False, None), ("der", "article", True, ["die", "und", "das"]), ("and", "conjunction", False, None), ("ing", "gerund", False, None), ("de la", "of the", False, None), ("in", "within", True, ["of", "to"])]
ALIAS_VALUES = ", ".join(f"({t!r}, {a!r}, {str(p).lower()}, {'NULL' if c is None else repr(c)})" for t, a, p, c in ALIASES)


@add("alias_expand", f"""WITH q AS (SELECT item_id AS query_id, text, ' ' || regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g') || ' ' AS said FROM benchmark), a(term, alias, low, context) AS (VALUES {ALIAS_VALUES}),
h AS (SELECT query_id, alias, row_number() OVER (PARTITION BY query_id ORDER BY low, len(term) DESC, term) AS n FROM q JOIN a ON contains(said, ' ' || term || ' ') AND (context IS NULL OR len(list_filter(context, lambda c: contains(said, ' ' || c || ' '))) > 0)),
g AS (SELECT query_id, string_agg(alias, ' ' ORDER BY n) AS added FROM h WHERE n <= 2 GROUP BY query_id) SELECT q.query_id, added, md5(concat_ws(' ', text, added)) AS digest FROM q LEFT JOIN g ON q.query_id = g.query_id""")
def _(spark, sf):
    aliases = spark.createDataFrame(ALIASES, "term string, alias string, low_priority boolean, context array<string>")
    q = view(spark, sf, QUERIES)
    longer = RW.expand_aliases(q, aliases).withColumnRenamed("text", "longer").join(q, "query_id")
    added = F.nullif(F.ltrim(F.substring("longer", F.length("text") + 1, F.length("longer"))), L(""))
    return longer.select("query_id", added.alias("added"), F.md5(F.col("longer").cast("binary")).alias("digest"))


#: A dictionary as large as the tables allow: every run of one to three words of the benchmark.
RUNS_SQL = r"""b AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS w FROM benchmark), runs AS (SELECT DISTINCT array_to_string(w[i:i + n - 1], ' ') AS phrase, n FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM b), (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(w))"""


@add("phrase_dictionary", rf"""WITH {RUNS_SQL}, d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS phrase, n FROM p, (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(w)) SELECT doc_id, n AS size, count(*) AS places, count(DISTINCT phrase) AS phrases FROM h JOIN runs USING (phrase, n) GROUP BY doc_id, n""")
def _(spark, sf):
    w = DI.words(F.col("text"))
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(L(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).otherwise(F.expr("cast(array() as array<array<string>>)"))
    phrases = table(spark, sf, "benchmark").select(w.alias("w")).select(F.explode(F.concat(runs(1), runs(2), runs(3))).alias("words")).distinct().select(F.array_join("words", " ").alias("phrase_id"), "words")
    hits = DI.matches(table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), w.alias("words")), phrases, 3)
    return hits.groupBy(F.col("text_id").alias("doc_id"), F.col("size").cast("long").alias("size")).agg(F.count(L(1)).alias("places"), F.countDistinct("phrase_id").alias("phrases"))


@add("query_specialty", r"""WITH q AS (SELECT item_id AS query_id, lower(text || CASE item_id % 8 WHEN 0 THEN ' Physiotherapist' WHEN 1 THEN ' a physio for the PELVIC floor' WHEN 2 THEN ' pelvicphysio' WHEN 3 THEN ' pelvic pain  physios' WHEN 4 THEN ' Dietetics' WHEN 5 THEN ' nutritionspecialist' WHEN 6 THEN ' physiotherapists, dietitians' ELSE '' END) AS t FROM benchmark)
SELECT query_id, CASE WHEN regexp_matches(t, '\bphysiotherapist\b|\bphysiotherapy\b|\bpelvic\s*physio\b|\bphysio\b.*pelvic|pelvic\s+pain\s+physio') THEN 'Physiotherapy' WHEN regexp_matches(t, '\bdietitian\b|\bdietetics\b|\bnutrition\s*specialist\b') THEN 'Dietitian' END AS specialty FROM q""")
def _(spark, sf):
    said = F.when(F.col("item_id") % 8 == 0, " Physiotherapist").when(F.col("item_id") % 8 == 1, " a physio for the PELVIC floor").when(F.col("item_id") % 8 == 2, " pelvicphysio").when(F.col("item_id") % 8 == 3, " pelvic pain  physios").when(F.col("item_id") % 8 == 4, " Dietetics").when(F.col("item_id") % 8 == 5, " nutritionspecialist").when(F.col("item_id") % 8 == 6, " physiotherapists, dietitians").otherwise("")
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), RW.specialty_of(F.concat("text", said)).alias("specialty"))


CONCEPTS = [("eau", "water"), ("eau", "sea"), ("ung", "noun"), ("ción", "noun"), ("the", "word")]


@add("concept_expand", f"""WITH q AS (SELECT item_id AS query_id, text FROM benchmark), c(trigger, related) AS (VALUES {', '.join(map(str, CONCEPTS))}),
g AS (SELECT query_id, string_agg(DISTINCT related, ' ' ORDER BY related) AS added FROM q JOIN c ON contains(lower(text), trigger) GROUP BY query_id) SELECT q.query_id, coalesce(added, '') AS added FROM q LEFT JOIN g ON q.query_id = g.query_id""")
def _(spark, sf):
    q = view(spark, sf, QUERIES)
    concepts = spark.createDataFrame(CONCEPTS, "trigger string, related string")
    wide = RW.expand_concepts(q, concepts).withColumnRenamed("text", "longer")
    return wide.join(q, "query_id").select("query_id", F.ltrim(F.substring("longer", F.length("text") + 1, F.length("longer"))).alias("added"))


TERMS_SQL = f"t AS (SELECT item_id AS query_id, {TOKENS.format('text')} AS t FROM benchmark)"


def term_lists(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text", T.tokens(F.col("text")).alias("t"))


@add("merge_terms_conflict", f"""WITH {TERMS_SQL}, s AS (SELECT query_id, t[1:3] AS r, t[4:] AS s FROM t), f AS (SELECT query_id, r, list_filter(s, lambda x: len(list_filter(r, lambda y: contains(x, y) OR contains(y, x))) = 0) AS f FROM s)
SELECT query_id, least(60, len(list_distinct(list_concat(r, f))))::BIGINT AS n, r[1] AS first_term FROM f""")
def _(spark, sf):
    merged = RW.merge_required(F.slice("t", 1, 3), F.slice("t", F.lit(4), F.greatest(F.size("t"), F.lit(1))))
    return term_lists(spark, sf).select("query_id", F.size(merged).cast("long").alias("n"), F.get(merged, 0).alias("first_term"))


@add("safe_lane", f"""WITH {TERMS_SQL}, f AS (SELECT query_id, list_filter(t, lambda x: (regexp_matches(x, '^th') OR regexp_matches(x, 'ion$')) AND NOT regexp_matches(x, 'thth') AND NOT regexp_matches(x, '^the$')) AS f FROM t),
u AS (SELECT query_id, x, min(i) AS i FROM (SELECT query_id, unnest(f) AS x, generate_subscripts(f, 1) AS i FROM f) GROUP BY query_id, x), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS n FROM u)
SELECT t.query_id, coalesce(string_agg(x, ' ' ORDER BY i), '') AS safe FROM t LEFT JOIN k ON t.query_id = k.query_id AND n <= 4 GROUP BY t.query_id""")
def _(spark, sf):
    # A look-ahead pattern is split into an allowed and a denied one.
    return term_lists(spark, sf).select("query_id", F.array_join(RW.safe_terms(F.col("t"), ["^th", "ion$"], ["thth", "^the$"]), " ").alias("safe"))


@add("anchor_merge", f"""WITH {TERMS_SQL}, c AS (SELECT query_id, list_concat(list_transform(t[1:4], lambda x: upper(x)), t[1:8]) AS c FROM t), u AS (SELECT query_id, lower(x) AS k, min(i) AS i FROM (SELECT query_id, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM c) GROUP BY query_id, lower(x)),
n AS (SELECT u.query_id, c.c[i] AS x, i, row_number() OVER (PARTITION BY u.query_id ORDER BY i) AS n FROM u JOIN c ON u.query_id = c.query_id) SELECT query_id, string_agg(x, ' ' ORDER BY i) AS anchors FROM n WHERE n <= 5 GROUP BY query_id""")
def _(spark, sf):
    merged = RW.merge_anchors(F.transform(F.slice("t", 1, 4), lambda x: F.upper(x)), F.slice("t", 1, 8))
    return term_lists(spark, sf).select("query_id", F.array_join(merged, " ").alias("anchors"))


@add("clarity_gate", "SELECT event_id, (value - floor(value)) >= 0.75e0 AND event_type IN ('view', 'click') AS clear, CASE WHEN (value - floor(value)) >= 0.75e0 AND event_type IN ('view', 'click') THEN 1 ELSE 0 END AS n_negatives FROM events")
def _(spark, sf):
    confidence = F.col("value") - F.floor("value")
    specificity = F.when(F.col("event_type") == "view", "named_procedure").when(F.col("event_type") == "click", "confirmed_diagnosis").otherwise("symptom")
    return table(spark, sf, "events").select("event_id", RW.is_clear(confidence, specificity).alias("clear"), F.size(RW.negatives_if_clear(F.array(F.col("event_type")), confidence, specificity)).alias("n_negatives"))


@add("subspecialty_merge", "WITH b AS (SELECT c_nationkey AS query_id, lower(c_mktsegment) AS k, max(c_acctbal) AS confidence FROM customer GROUP BY ALL) SELECT * FROM (SELECT query_id, k AS key, confidence, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, k) AS rank FROM b) WHERE rank <= 3")
def _(spark, sf):
    return RW.merge_subspecialties(table(spark, sf, "customer").select(F.col("c_nationkey").alias("query_id"), F.initcap("c_mktsegment").alias("name"), F.col("c_acctbal").alias("confidence")))


@add("ideal_profile_query", f"WITH {TERMS_SQL} SELECT query_id, concat_ws(' ', array_to_string(t[1:2], ' '), array_to_string(t[5:7], ' '), array_to_string(t[10:12], ' '), array_to_string(t[15:19], ' ')) AS text FROM t")
def _(spark, sf):
    part = lambda a, n: F.slice("t", a, n)
    return term_lists(spark, sf).select("query_id", RW.ideal_query(part(1, 4), part(5, 5), part(10, 5), part(15, 9)).alias("text"))


@add("taxonomy_match", rf"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda x: len(x) >= 2)) AS term FROM benchmark), x(entry, name) AS (VALUES (1, 'thing'), (1, 'edly'), (2, 'eaux'), (3, 'schaft'), (3, 'keit'), (4, 'cion'))
SELECT DISTINCT query_id, entry FROM q JOIN x ON contains(term, name) OR contains(name, term)""")
def _(spark, sf):
    taxonomy = spark.createDataFrame([(1, ["thing", "edly"]), (2, ["eaux"]), (3, ["schaft", "keit"]), (4, ["cion"])], "entry int, names array<string>")
    return RW.taxonomy_match(view(spark, sf, QUERIES), taxonomy)


@add("intent_merge", f"WITH {TERMS_SQL} SELECT query_id, len(list_distinct(list_concat(t, ['hand', 'knee', 'hip'])))::BIGINT AS n FROM t")
def _(spark, sf):
    subs = F.array(*[F.struct(L(n).alias("name"), L(0.5).alias("confidence")) for n in ("Hand", "knee", "Hip", "foot")])
    return term_lists(spark, sf).select("query_id", F.size(RW.merge_intents(F.slice("t", 1, 10), F.col("t"), subs)).cast("long").alias("n"))


@add("session_context", f"WITH {TERMS_SQL} SELECT query_id, md5(concat_ws(' ', array_to_string(t[1:6], ' '), array_to_string(t[20:22], ' '), array_to_string(t[1:12], ' '))) AS enriched FROM t")
def _(spark, sf):
    c = RW.context(F.col("t"), F.slice("t", 20, 3), F.slice("t", 1, 4), F.array_join(F.slice("t", 1, 6), " "), "parallel-v2")
    return term_lists(spark, sf).select("query_id", F.md5(c["enriched_query"].cast("binary")).alias("enriched"))


# Second stage: the counts that the rescorers take, each from terms of its own, over the first stage's short list.

NEG = ["trash", "scum", "loser", "idiot", "stupid"]
#: Where in a query's terms each count's terms stand: the first and the last.
SLICES = {"intent": (1, 6), "anchor": (7, 8), "safe": (9, 12), "high": (13, 15), "pathway": (16, 20), "procedure": (21, 23), "sub": (24, 26)}
COUNTS_SQL = f"""{bm25_sql()}, qtok AS (SELECT query_id, {TOKENS.format('text')} AS t FROM q),
k AS (SELECT r.query_id, r.doc_id, r.score, {', '.join(f"len(list_filter(t[{a}:{b}], lambda x: contains(lower(d.text), x))) AS {n}" for n, (a, b) in SLICES.items())},
 len(list_filter({NEG}, lambda x: contains(lower(d.text), x))) AS neg, lower(d.text) AS body, t FROM ranked r JOIN documents d USING (doc_id) JOIN qtok USING (query_id) WHERE rank <= {SIZE})"""
NEG_SQL = "CASE WHEN neg >= 4 THEN -3e0 WHEN neg >= 2 THEN -2e0 WHEN neg = 1 THEN -1e0 ELSE 0e0 END"


def counted(spark, sf):
    t = T.tokens(F.col("query"))
    made = {n: T.count_contained(F.slice(t, a, b - a + 1), F.lower("body")) for n, (a, b) in SLICES.items()}
    return shortlist(spark, sf).withColumns({**made, "neg": T.count_contained(F.array(*[L(w) for w in NEG]), F.lower("body")), "t": t})


@add("rescore_additive", f"WITH {COUNTS_SQL} SELECT query_id, doc_id, round(greatest(0e0, CASE WHEN query_id % 3 = 0 THEN 0e0 ELSE score END + 0.3e0 * intent + 0.5e0 * anchor + {NEG_SQL} + least(0.21e0 * sub, 0.5e0)), 6) AS score FROM k")
def _(spark, sf):
    score = RS.additive(F.col("score"), F.col("intent"), F.col("anchor"), F.col("neg"), 0.21 * F.col("sub"), F.col("query_id") % 3 == 0)
    return counted(spark, sf).select("query_id", "doc_id", F.round(score, 6).alias("score"))


@add("rescore_tiered", f"""WITH {COUNTS_SQL}, s AS (SELECT query_id, doc_id, score, round(CASE WHEN high >= 2 THEN 4e0 WHEN high = 1 THEN 2e0 ELSE 0e0 END + least(pathway, 3) + 0.5e0 * procedure + least(0.2e0 * anchor, 0.6e0) + least(safe, 3) + least(0.3e0 * sub, 0.5e0) + {NEG_SQL}, 6) AS tier FROM k)
SELECT query_id, doc_id, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier DESC, score DESC, doc_id) AS rank FROM s""")
def _(spark, sf):
    c = F.col
    tier = RS.tiered(c("high"), c("pathway"), c("procedure"), c("anchor"), c("safe"), 0.3 * c("sub"), c("neg"))
    rows = counted(spark, sf).select("query_id", "doc_id", "score", F.round(tier, 6).alias("tier"))
    return ranked(rows, by=RS.tiered_order()).select("query_id", "doc_id", "tier", "rank")


@add("rescore_multiplicative", f"""WITH {COUNTS_SQL} SELECT query_id, doc_id, round(greatest(0e0, (score * (CASE WHEN high >= 2 THEN 1.4e0 WHEN high = 1 THEN 1.2e0 ELSE 1e0 END * CASE WHEN pathway >= 3 THEN 1.3e0 WHEN pathway = 2 THEN 1.15e0 WHEN pathway = 1 THEN 1.05e0 ELSE 1e0 END
 * CASE WHEN procedure > 0 THEN 1.05e0 ELSE 1e0 END) + least(0.2e0 * anchor, 0.6e0) + least(safe, 3)) * (1 + least(0.1e0 * sub, 0.5e0)) * CASE WHEN neg >= 4 THEN 0.7e0 WHEN neg >= 2 THEN 0.85e0 WHEN neg = 1 THEN 0.95e0 ELSE 1e0 END), 9) AS score FROM k""")
def _(spark, sf):
    c = F.col
    return counted(spark, sf).select("query_id", "doc_id", F.round(RS.multiplicative(c("score"), c("high"), c("pathway"), c("procedure"), c("anchor"), c("safe"), 0.1 * c("sub"), c("neg")), 9).alias("score"))


@add("rescore_negatives_only", f"WITH {COUNTS_SQL} SELECT query_id, doc_id, round(greatest(0e0, score + {NEG_SQL}), 6) AS score FROM k")
def _(spark, sf):
    return counted(spark, sf).select("query_id", "doc_id", F.round(RS.negatives_only(F.col("score"), F.col("neg")), 6).alias("score"))


# Profiles and an ideal, each field of its own kind of value.
FUZZY_SQL = "(lower(trim({a})) = lower(trim({b})) OR contains(lower(trim({a})), lower(trim({b}))) OR contains(lower(trim({b})), lower(trim({a}))))"
ANY_SQL = lambda held, b: f"len(list_filter({held}, lambda h: {FUZZY_SQL.format(a='h', b=b)})) > 0"
HELD_SQL = "p AS (SELECT p_partkey AS doc_id, string_split(p_type, ' ') AS subs, [p_brand, p_name] AS procs, ['size ' || p_size::VARCHAR] AS conds, p_type AS expertise, p_name || ' ' || p_type AS description, [p_brand] AS quals, ['adult' || (p_size % 3)::VARCHAR] AS ages, [CASE WHEN p_size % 2 = 0 THEN 'French' ELSE 'german' END] AS langs, CASE p_size % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'female' END AS gender FROM part)"


@add("ideal_profile_match", f"""WITH {HELD_SQL} SELECT doc_id, round(greatest(0e0,
 (CASE WHEN {ANY_SQL('subs', "'Steel'")} THEN 5e0 ELSE -2e0 END) + (CASE WHEN {ANY_SQL('subs', "'BRUSHED x'")} THEN 3e0 ELSE 0e0 END) + (CASE WHEN {ANY_SQL('subs', "'tin'")} THEN 1e0 ELSE 0e0 END)
 + (CASE WHEN {ANY_SQL('procs', "'brand#1'")} THEN 4e0 ELSE 0e0 END) + (CASE WHEN {ANY_SQL('procs', "'brand#2'")} THEN 2e0 ELSE 0e0 END) + (CASE WHEN {ANY_SQL('procs', "'7'")} THEN 0.5e0 ELSE 0e0 END)
 + (CASE WHEN {ANY_SQL('conds', "'size 1'")} THEN 3e0 ELSE 0e0 END) + (CASE WHEN {ANY_SQL('conds', "'size 2'")} THEN 1.5e0 ELSE 0e0 END)
 + (CASE WHEN contains(lower(expertise), 'promo') THEN 2e0 ELSE 0e0 END) + (CASE WHEN contains(lower(description), 'part') THEN 1e0 ELSE 0e0 END) + (CASE WHEN contains(lower(description), 'copper') THEN 1e0 ELSE 0e0 END)
 - (CASE WHEN {ANY_SQL('subs', "'nickel'")} THEN 3e0 ELSE 0e0 END) - (CASE WHEN {ANY_SQL('procs', "'brand#5'")} THEN 2e0 ELSE 0e0 END)
 + (CASE WHEN list_contains(list_transform(quals, lambda x: upper(x)), 'BRAND#3') THEN 1e0 ELSE 0e0 END) + (CASE WHEN list_contains(ages, 'adult1') THEN 1.5e0 ELSE 0e0 END)
 + (CASE WHEN list_contains(list_transform(langs, lambda x: lower(x)), 'french') THEN 1e0 ELSE 0e0 END) + (CASE WHEN lower(gender) = 'female' THEN 1e0 ELSE 0e0 END)), 6) AS score FROM p""")
def _(spark, sf):
    c = F.col
    text = lambda *values: F.array(*[L(v) for v in values])
    need = lambda *pairs: F.array(*[F.struct(L(n).alias("name"), L(i).alias("importance")) for n, i in pairs])
    part = table(spark, sf, "part")
    profile = F.struct(
        F.split("p_type", " ").alias("subspecialties"), F.array("p_brand", "p_name").alias("procedures"), F.array(F.concat(L("size "), c("p_size").cast("string"))).alias("conditions"),
        c("p_type").alias("expertise"), F.concat_ws(" ", "p_name", "p_type").alias("description"), F.array("p_brand").alias("qualifications"), F.array(F.concat(L("adult"), (c("p_size") % 3).cast("string"))).alias("age_groups"),
        F.array(F.when(c("p_size") % 2 == 0, "French").otherwise("german")).alias("languages"), F.when(c("p_size") % 4 == 0, "Male").when(c("p_size") % 4 == 1, "female").alias("gender"),
    )
    ideal = F.struct(
        need(("Steel", "required"), ("BRUSHED x", "preferred"), ("tin", "optional"), ("", "required")).alias("subspecialties"), need(("brand#1", "required"), ("brand#2", "preferred"), ("7", "optional")).alias("procedures"),
        need(("size 1", "required"), ("size 2", "preferred")).alias("conditions"), text("PROMO").alias("areas"), text("part", "Copper").alias("keywords"), text("nickel").alias("avoid_subspecialties"), text("brand#5").alias("avoid_procedures"),
        text("brand#3").alias("qualifications"), text("adult1").alias("age_groups"), text("FRENCH").alias("languages"), L("Female").alias("gender"),
    )
    return part.select(c("p_partkey").alias("doc_id"), F.round(RS.ideal_match(profile, ideal), 6).alias("score"))


@add("subspecialty_weight", """WITH h AS (SELECT p_partkey AS doc_id, lower(p_type) AS held FROM part), l(name, confidence) AS (VALUES ('steel', 0.9e0), ('promo brushed', 0.5e0), ('brass', 0.4e0))
SELECT doc_id, round(sum(CASE WHEN held = name OR contains(held, name) OR contains(name, held) OR len(list_intersect(list_filter(string_split(held, ' '), lambda x: len(x) > 3), list_filter(string_split(name, ' '), lambda x: len(x) > 3))) > 0 THEN confidence * 0.3e0 ELSE 0 END), 6) AS weight FROM h, l GROUP BY doc_id""")
def _(spark, sf):
    likely = F.array(*[F.struct(L(n).alias("name"), L(c).alias("confidence")) for n, c in (("steel", 0.9), ("promo brushed", 0.5), ("brass", 0.4))])
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.round(RS.weighted_subspecialty(F.array("p_type"), likely), 6).alias("weight"))


@add("session_boost", "SELECT o_orderkey AS doc_id, round((CASE WHEN o_orderpriority LIKE '1%' AND o_orderstatus = 'O' THEN 1.2e0 ELSE 1e0 END) * (CASE WHEN o_orderpriority LIKE '1%' AND o_custkey % 2 = 0 THEN 1.15e0 ELSE 1e0 END) * (CASE WHEN o_custkey % 3 = 0 THEN 1.3e0 ELSE 1e0 END) * (CASE WHEN o_custkey % 5 = 0 THEN 1.2e0 ELSE 1e0 END) * (CASE WHEN o_custkey % 7 = 0 THEN 1.15e0 ELSE 1e0 END), 6) AS boost FROM orders")
def _(spark, sf):
    k = F.col("o_custkey")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.round(B.session(F.col("o_orderpriority").startswith("1"), F.col("o_orderstatus") == "O", k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 7 == 0), 6).alias("boost"))


CHECK_SQL = "CASE WHEN trim({h}) = '' THEN NULL WHEN contains(' ' || lower(trim({h})) || ' ', ' ' || {v} || ' ') THEN 1e0 WHEN contains(lower(trim({h})), {v}) OR contains({v}, lower(trim({h}))) THEN 0.5e0 END"


@add("checklist_boost", f"""WITH c AS (SELECT p_partkey AS doc_id, CASE WHEN p_size % 5 = 0 THEN '' ELSE split_part(p_type, ' ', 1) || 'x' END AS a, p_type AS b, p_brand AS d FROM part), e AS (SELECT *, trim(concat_ws(' ', nullif(a, ''), b, d)) AS every FROM c),
r AS (SELECT doc_id, list_sum(list_transform(['promo', 'steel', 'bru', 'brand#1'], lambda v: coalesce({', '.join(CHECK_SQL.format(h=h, v='v') for h in ('a', 'b', 'd', 'every'))}, 0e0))) / 5 AS r FROM e)
SELECT doc_id, round(r, 6) AS ratio, round(CASE WHEN r >= 0.3e0 THEN least(1 + 0.2e0 * r, 1.2e0) ELSE 1e0 END, 6) AS boost FROM r""")
def _(spark, sf):
    sets = [F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat(F.split_part("p_type", L(" "), L(1)), L("x"))), F.col("p_type"), F.col("p_brand")]
    ratio, boost = RS.checklist(F.array(L(" Promo"), L("steel"), L("bru"), L("brand#1"), L(" ")), sets)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.round(ratio, 6).alias("ratio"), F.round(boost, 6).alias("boost"))


@add("term_classes", f"WITH {TERMS_SQL}, x AS (SELECT query_id, list_concat(t, ['angina', 'pci', 'stent', 'chest pain', 'angina']) AS t FROM t) SELECT query_id, len(list_filter(t, lambda x: x IN ('angina', 'chest pain'))) AS high, len(list_filter(t, lambda x: x IN ('pci', 'stent'))) AS procedure, len(list_filter(t, lambda x: x NOT IN ('angina', 'chest pain', 'pci', 'stent'))) AS pathway FROM x")
def _(spark, sf):
    high, procedure, pathway = RS.term_classes(F.concat("t", F.array(*[L(x) for x in ("Angina", "PCI", "stent", "chest pain", "angina")])))
    return term_lists(spark, sf).select("query_id", F.size(high).cast("long").alias("high"), F.size(procedure).cast("long").alias("procedure"), F.size(pathway).cast("long").alias("pathway"))


# Fusion: two rankings of the same queries, by both idf formulas.

TWO_SQL = f"""a AS (SELECT * FROM (WITH {bm25_sql()} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 50)),
b AS (SELECT * FROM (WITH {bm25_sql(variant='local', k1=1.2, b=0.8)} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 50))"""


def two(spark, sf):
    """Both short lists, written, since what combines them reads them several times."""
    q, docs = inputs(spark, sf)
    lists = bm25(q, docs, top=50), bm25(q, docs, RankingConfig(variant="local", k1=1.2, b=0.8), top=50)
    return tuple(stage(ranked(scores, 50), "short-list") for scores in lists)


@add("rrf_fusion", f"WITH {TWO_SQL}, f AS (SELECT query_id, doc_id, round(1e0 / coalesce(a.rank, 51) + 1e0 / coalesce(b.rank, 51), 6) AS score FROM a FULL JOIN b USING (query_id, doc_id)) SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 12")
def _(spark, sf):
    return out(FU.reciprocal_rank(*two(spark, sf)))


@add("two_query_union", f"WITH {TWO_SQL}, f AS (SELECT query_id, doc_id, coalesce(a.score, -1) AS sa, b.score AS sb FROM a FULL JOIN (SELECT * FROM b WHERE rank <= 30) b USING (query_id, doc_id)) SELECT * FROM (SELECT query_id, doc_id, CASE WHEN sa >= 0 THEN sa ELSE sb END AS score, row_number() OVER (PARTITION BY query_id ORDER BY sa DESC, sb DESC NULLS LAST, doc_id) AS rank FROM f) WHERE rank <= 100")
def _(spark, sf):
    return out(FU.two_query_union(*two(spark, sf)))


@add("full_outer_ranks", f"WITH {TWO_SQL} SELECT query_id, doc_id, a.rank AS rank_a, b.rank AS rank_b FROM a FULL JOIN b USING (query_id, doc_id)")
def _(spark, sf):
    a, b = two(spark, sf)
    return a.select("query_id", "doc_id", F.col("rank").alias("rank_a")).join(b.select("query_id", "doc_id", F.col("rank").alias("rank_b")), ["query_id", "doc_id"], "full")


@add("pool_union_sources", f"""WITH {TWO_SQL}, u AS (SELECT query_id, doc_id, rank AS pos, 0 AS p FROM a WHERE rank <= 18 UNION ALL SELECT query_id, doc_id, rank, 1 FROM b WHERE rank <= 35),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY p, pos) AS n FROM u), r AS (SELECT query_id, doc_id, CASE p WHEN 0 THEN 'ranking' ELSE 'bm25_only' END AS pool_source, row_number() OVER (PARTITION BY query_id ORDER BY p, pos, doc_id) AS rank FROM f WHERE n = 1) SELECT * FROM r WHERE rank <= 50""")
def _(spark, sf):
    a, b = two(spark, sf)
    return FU.pool([("ranking", a.where("rank <= 18").withColumn("pos", F.col("rank"))), ("bm25_only", b.where("rank <= 35").withColumn("pos", F.col("rank")))])


@add("rerank_backfill", f"""WITH {TWO_SQL}, g AS (SELECT query_id, doc_id, min(51 - rank) AS pos FROM b WHERE rank % 7 = 0 AND (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM a) GROUP BY ALL),
u AS (SELECT query_id, doc_id, pos, 0 AS part FROM g UNION ALL SELECT query_id, doc_id, rank, 1 FROM a WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM g)),
r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY part, pos, doc_id) AS rank FROM u) SELECT query_id, doc_id, rank, round(1e0 / rank, 6) AS score FROM r WHERE rank <= 12""")
def _(spark, sf):
    a, b = two(spark, sf)
    return FU.back_fill(b.where("rank % 7 = 0").withColumn("pos", 51 - F.col("rank")), a)


TIER_SQL = "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'excellent' WHEN quality = 1 THEN 'good' ELSE 'ill-fit' END AS tier FROM labels"


@add("tier_rerank", f"""WITH a AS (WITH {bm25_sql()} SELECT query_id, doc_id, score FROM ranked WHERE rank <= 50), t AS ({TIER_SQL}), e AS (SELECT query_id, a.doc_id, score, coalesce(tier, 'good') AS tier FROM a LEFT JOIN t ON a.doc_id = t.doc_id)
SELECT * FROM (SELECT query_id, doc_id, score, tier, row_number() OVER (PARTITION BY query_id ORDER BY CASE tier WHEN 'excellent' THEN 0 WHEN 'good' THEN 1 ELSE 2 END, score DESC, doc_id) AS rank FROM e) WHERE rank <= 12""")
def _(spark, sf):
    return FU.tier_rerank(ranked(bm25(*inputs(spark, sf), top=50), 50).drop("rank"), view(spark, sf, TIER_SQL)).select("query_id", "doc_id", "score", "tier", "rank")


@add("progressive_rerank", f"""WITH a AS (WITH {bm25_sql()} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 30), t AS ({TIER_SQL}), e AS (SELECT query_id, a.doc_id, score, rank AS seen, coalesce(tier, 'good') AS tier FROM a LEFT JOIN t ON a.doc_id = t.doc_id),
x AS (SELECT query_id, seen, row_number() OVER (PARTITION BY query_id ORDER BY seen) AS n FROM e WHERE tier = 'excellent'), s AS (SELECT query_id, least(5, ceil(seen / 12e0))::INT AS rounds FROM x WHERE n = 3),
k AS (SELECT e.*, coalesce(rounds, 3) AS rounds FROM e LEFT JOIN s ON e.query_id = s.query_id WHERE seen <= coalesce(rounds, 3) * 12)
SELECT * FROM (SELECT query_id, doc_id, score, tier, rounds AS rounds_used, row_number() OVER (PARTITION BY query_id ORDER BY CASE tier WHEN 'excellent' THEN 0 WHEN 'good' THEN 1 ELSE 2 END, score DESC, doc_id) AS rank FROM k) WHERE rank <= 12""")
def _(spark, sf):
    return FU.progressive(bm25(*inputs(spark, sf), top=30), view(spark, sf, TIER_SQL)).select("query_id", "doc_id", "score", "tier", "rounds_used", "rank")


def stage_b_counts(rows):
    t = T.tokens(F.col("query"))
    n = lambda a, b: T.count_contained(F.slice(t, a, b - a + 1), F.lower("body"))
    return rows.withColumns({"intent": n(1, 6), "anchor": n(7, 8), "negative": T.count_contained(F.array(*[L(w) for w in NEG]), F.lower("body")), "subspecialty": L(0.0), "ambiguous": L(False)})


@add("shortlist_two_stage", f"WITH {COUNTS_SQL}, s AS (SELECT query_id, doc_id, round(greatest(0e0, score + 0.3e0 * intent + 0.5e0 * anchor + {NEG_SQL}), 6) AS score FROM k) SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 12")
def _(spark, sf):
    return out(SL.shortlist(*inputs(spark, sf), stage_b_counts))


#: Signals of documents: those of the practitioner with the document's id, modulo their number.
SIGNALS = f"""SELECT d.doc_id, p.rating, p.reviews, p.years, p.verified, p.lat, p.lon, d.doc_id % 3 AS negatives, CASE WHEN d.doc_id % 4 <> 0 THEN (d.doc_id % 13) * 1e-1 END AS given
FROM documents d JOIN ({PRACTITIONERS}) p ON d.doc_id % 10 + 1 = p.doc_id WHERE d.doc_id % 7 <> 0"""
SIGNALS_SQL = f"sig AS (SELECT doc_id, {TIERS_SQL} AS quality, {PROX_SQL} AS proximity, least(1e0, greatest(0e0, given)) AS semantic, negatives FROM (SELECT *, {HAV.format(**CENTRE)} / 40 AS d FROM ({SIGNALS})))"
PAIRS_SQL = PHRASES_SQL.replace("ph AS", "ph2 AS (SELECT query_id, q, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p FROM qw), ph AS")


def signals(spark, sf):
    s = view(spark, sf, SIGNALS)
    quality = B.quality(F.col("rating"), F.col("reviews"), F.col("years"), F.col("verified"))
    return s.select("doc_id", quality.alias("quality"), B.proximity(miles() / 40).alias("proximity"), F.least(L(1.0), F.greatest(L(0.0), "given")).alias("semantic"), "negatives")


@add("production_rank", f"""WITH {bm25_sql()}, {PHRASES_SQL}, {SIGNALS_SQL}, raw AS (SELECT s.query_id, s.doc_id, round(s.score * coalesce(quality, 1e0) * coalesce(proximity, 1e0) + {PHRASE_SQL}, 6) AS score, coalesce(semantic, 0e0) AS semantic FROM scores s JOIN documents d ON s.doc_id = d.doc_id JOIN ph ON s.query_id = ph.query_id LEFT JOIN sig ON s.doc_id = sig.doc_id),
n AS (SELECT query_id, doc_id, round(round({MINMAX_SQL}, 6) + 0.3e0 * semantic, 6) AS score FROM raw WINDOW w AS (PARTITION BY query_id)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM n) WHERE rank <= 50""")
def _(spark, sf):
    return out(SL.production(*inputs(spark, sf), signals(spark, sf)).where("rank <= 50"))


@add("local_rank", f"""WITH {bm25_sql(variant='local')}, {PAIRS_SQL}, {SIGNALS_SQL}, raw AS (SELECT s.query_id, s.doc_id, round(greatest(0e0, (s.score * coalesce(quality, 1e0) + {PHRASE_SQL.replace('p,', 'ph2.p,')}) * CASE WHEN negatives >= 2 THEN 0.85e0 WHEN negatives = 1 THEN 0.95e0 ELSE 1e0 END), 6) AS score FROM scores s JOIN documents d ON s.doc_id = d.doc_id JOIN ph2 ON s.query_id = ph2.query_id LEFT JOIN sig ON s.doc_id = sig.doc_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM raw) WHERE rank <= 50""")
def _(spark, sf):
    return out(SL.local(*inputs(spark, sf), signals(spark, sf)).where("rank <= 50"))


# The index as a table


@add("bm25_topk_pruned", f"WITH {bm25_sql()} {TOP.format(n=10)}")
def _(spark, sf):
    q, docs = inputs(spark, sf)
    return out(IX.build(docs).topk(q, 10))


@add("bm25_local_pruned", f"WITH {bm25_sql(variant='local', k1=1.2, b=0.8)} {TOP.format(n=25)}")
def _(spark, sf):
    q, docs = inputs(spark, sf)
    return out(IX.build(docs).topk(q, 25, RankingConfig(variant="local", k1=1.2, b=0.8)))


@add("index_segments", f"WITH {bm25_sql(corpus='SELECT doc_id, text FROM documents WHERE doc_id % 11 <> 0')} {TOP.format(n=10)}")
def _(spark, sf):
    q, docs = inputs(spark, sf)
    store = IX.Segments(spark, fresh_path(spark, "segments"))
    changed = F.col("doc_id") % 4 == 0
    store.upsert(docs.withColumn("text", F.when(changed, F.concat(L("an older version of "), "text")).otherwise(F.col("text"))))
    store.upsert(docs.where(changed))
    store.delete(docs.where("doc_id % 11 = 0").select("doc_id"))
    store.merge()
    return out(ranked(store.open().scores(q), 10))


#: Documents with several fields, and what production makes of them.
FIELDED = "SELECT doc_id, lang AS specialty, text AS description, source AS name FROM documents"
WEIGHTED = "SELECT doc_id, concat_ws(' ', nullif(lang, ''), nullif(lang, ''), nullif(lang, ''), nullif(text, ''), nullif(text, ''), nullif(source, '')) AS text FROM documents"
NAMING = "SELECT item_id AS query_id, text || ' src1 en en' AS text FROM benchmark"


@add("production_weighted_rank", BOOK.oracles["production_rank"].replace(bm25_sql(), bm25_sql(queries=NAMING, corpus=WEIGHTED)).replace("JOIN documents d ON", "JOIN corpus d ON"))
def _(spark, sf):
    # The fields are those of the configuration that the documents have.
    return out(SL.production(view(spark, sf, NAMING), view(spark, sf, FIELDED), signals(spark, sf)).where("rank <= 50"))


@add("shortlist_weighted", BOOK.oracles["shortlist_two_stage"].replace(bm25_sql(), bm25_sql(queries=NAMING, corpus=WEIGHTED)).replace("JOIN documents d USING", "JOIN corpus d USING"))
def _(spark, sf):
    return out(SL.shortlist(view(spark, sf, NAMING), view(spark, sf, FIELDED), stage_b_counts))


# A filter for every query

#: What each query asks for, and what documents have to offer.
ASKED = """SELECT item_id AS query_id, 'lang' AS attribute, 'equals' AS how, ' EN' AS value FROM benchmark WHERE item_id % 4 = 0
UNION ALL SELECT item_id, 'source', 'either_way', 'SRC1' FROM benchmark WHERE item_id % 4 = 1
UNION ALL SELECT item_id, 'lang', 'equals', CASE WHEN k = 0 THEN 'en' ELSE 'fr' END FROM (SELECT item_id, 0 AS k FROM benchmark UNION ALL SELECT item_id, 1 FROM benchmark) WHERE item_id % 4 = 1
UNION ALL SELECT item_id, 'group', 'age', 'Young children' FROM benchmark WHERE item_id % 4 = 2 UNION ALL SELECT item_id, 'lang', 'equals', 'nowhere' FROM benchmark WHERE item_id % 20 = 2"""
OFFERED = """SELECT doc_id, 'lang' AS attribute, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents
UNION ALL SELECT doc_id, 'group', CASE doc_id % 5 WHEN 0 THEN 'Paediatrics' WHEN 1 THEN 'Child health' WHEN 2 THEN 'children ' WHEN 3 THEN 'Adults' END FROM documents UNION ALL SELECT doc_id, 'group', 'Older adults' FROM documents WHERE doc_id % 2 = 0"""
ALLOWED_SQL = """allowed AS (SELECT q.query_id, d.doc_id FROM q JOIN documents d ON CASE query_id % 4 WHEN 0 THEN lower(trim(lang)) = 'en' WHEN 1 THEN (contains(lower(source), 'src1') OR contains('src1', lower(source))) AND lang IN ('en', 'fr') WHEN 2 THEN doc_id % 5 IN (0, 1, 2) AND query_id % 20 <> 2 ELSE true END)"""


FILTERED_SQL = f"""WITH q AS ({QUERIES}), {ALLOWED_SQL}, tok AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents),
stats AS (SELECT query_id, count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM allowed JOIN tok USING (doc_id) GROUP BY query_id),
post AS (SELECT doc_id, dl, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format('text')}) AS term FROM q) GROUP BY ALL),
hits AS (SELECT query_id, doc_id, term, dl, tf, qtf FROM qt JOIN post USING (term) JOIN allowed USING (query_id, doc_id)),
w AS (SELECT query_id, term, greatest(0::DOUBLE, ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1)) AS idf FROM hits JOIN stats USING (query_id) GROUP BY query_id, term, n),
scores AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM hits JOIN w USING (query_id, term) JOIN stats USING (query_id) GROUP BY query_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores)"""


@add("bm25_filter_per_query", f"{FILTERED_SQL} {TOP.format(n=10)}")
def _(spark, sf):
    q, docs = inputs(spark, sf)
    catalogue = CO.Catalogue(IX.build(docs), view(spark, sf, OFFERED))
    return out(ranked(catalogue.scores(q, view(spark, sf, ASKED)), 10))


@add("shortlist_filter_per_query", f"""{FILTERED_SQL}, qtok AS (SELECT query_id, {TOKENS.format('text')} AS t FROM q), k AS (SELECT r.query_id, r.doc_id, r.score, len(list_filter(t[1:6], lambda x: contains(lower(d.text), x))) AS intent, len(list_filter(t[7:8], lambda x: contains(lower(d.text), x))) AS anchor, len(list_filter({NEG}, lambda x: contains(lower(d.text), x))) AS neg FROM ranked r JOIN documents d USING (doc_id) JOIN qtok USING (query_id) WHERE rank <= {SIZE}),
s AS (SELECT query_id, doc_id, round(greatest(0e0, score + 0.3e0 * intent + 0.5e0 * anchor + {NEG_SQL}), 6) AS score FROM k) SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 12""")
def _(spark, sf):
    q, docs = inputs(spark, sf)
    catalogue = CO.Catalogue(IX.build(docs), view(spark, sf, OFFERED))
    return out(api.rank(q, docs, stage_b_counts, asked=view(spark, sf, ASKED), catalogue=catalogue))


@add("filter_sizes", f"WITH q AS ({QUERIES}), {ALLOWED_SQL} SELECT q.query_id, count(doc_id) AS n FROM q LEFT JOIN allowed ON q.query_id = allowed.query_id GROUP BY q.query_id")
def _(spark, sf):
    q, docs = inputs(spark, sf)
    return CO.passed(q, view(spark, sf, ASKED), CO.Catalogue(IX.build(docs), view(spark, sf, OFFERED)))


# The evaluator in the loop

#: What an evaluator says of a document: JSON, some of it in a fence, some broken, some of no known kind, some missing.
SAYS = """SELECT d.doc_id, CASE WHEN d.doc_id % 13 = 0 THEN 'no JSON at all' WHEN d.doc_id % 17 = 0 THEN '{"fit_category": "perfect"}' WHEN d.doc_id % 19 = 0 THEN NULL
  WHEN quality = 1 AND toxic = 0 THEN concat('```json', chr(10), '{"fit_category": " Excellent", "brief_reason": "', coalesce(source, ''), '"}', chr(10), '```') WHEN quality = 1 THEN '{"fit_category": "good"}' WHEN quality = 0 THEN '{"fit_category": "ill-fit", "brief_reason": null}' END AS answer
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
LOOP_SQL = f"""WITH a AS (WITH {bm25_sql()} SELECT query_id, doc_id, score, rank, count(*) OVER (PARTITION BY query_id) AS n FROM ranked), k AS ({SAYS}),
e AS (SELECT query_id, a.doc_id, score, rank, n, CASE WHEN contains(answer, ' Excellent') THEN 'excellent' WHEN contains(answer, 'ill-fit') THEN 'ill-fit' ELSE 'good' END AS tier,
  CASE WHEN contains(answer, ' Excellent') THEN coalesce(source, '') WHEN contains(answer, 'ill-fit') OR contains(answer, '"good"') THEN '' ELSE 'Evaluation failed' END AS reason FROM a JOIN k ON a.doc_id = k.doc_id JOIN documents d ON a.doc_id = d.doc_id WHERE rank <= 30),
x AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM e WHERE tier = 'excellent'), f AS (SELECT query_id, ceil(rank / 12e0)::INT AS rounds FROM x WHERE i = 3),
s AS (SELECT query_id, n, coalesce(f.rounds, ceil(least(n, 30) / 12e0)::INT) AS rounds, CASE WHEN f.rounds IS NOT NULL THEN 'top-k-excellent' WHEN n >= 30 THEN 'max-profiles-reviewed' ELSE 'no-more-profiles' END AS stop_reason FROM (SELECT DISTINCT query_id, n FROM a) LEFT JOIN f USING (query_id)),
seen AS (SELECT e.*, rounds, stop_reason FROM e JOIN s USING (query_id) WHERE rank <= rounds * 12)"""


def loop(spark, sf):
    q, docs = inputs(spark, sf)
    says = view(spark, sf, SAYS)
    # A provider in miniature: the answers travel with the rows, and come back from the Python side as a service's would.
    return PG.progressive(bm25(q, docs), PG.by_provider(lambda batches: (b[["query_id", "doc_id", "answer"]] for b in batches), says, q))


@add("progressive_loop", f"{LOOP_SQL}, r AS (SELECT query_id, doc_id, score, tier, reason, ceil(rank / 12e0)::INT - 1 AS iteration_found, row_number() OVER (PARTITION BY query_id ORDER BY CASE tier WHEN 'excellent' THEN 0 WHEN 'good' THEN 1 ELSE 2 END, score DESC, doc_id) AS rank FROM seen) SELECT * FROM r WHERE rank <= 12")
def _(spark, sf):
    return loop(spark, sf)[0]


#: A checklist of every query: its first two terms.
LISTED_SQL = f"""tk AS (SELECT query_id, {TOKENS.format('text')} AS t FROM (SELECT item_id AS query_id, text FROM benchmark)), bo AS (SELECT r.query_id, r.doc_id, (CASE WHEN contains(lower(coalesce(d.text, '')), t[1]) THEN 1e0 ELSE 0e0 END + CASE WHEN contains(lower(coalesce(d.text, '')), t[2]) THEN 1e0 ELSE 0e0 END) / 2 AS ratio FROM u r JOIN tk USING (query_id) JOIN documents d ON d.doc_id = r.doc_id)"""


@add("progressive_checklist_loop", LOOP_SQL.replace(f"WITH a AS (WITH {bm25_sql()} SELECT query_id, doc_id, score, rank, count(*) OVER (PARTITION BY query_id) AS n FROM ranked)", f"WITH u AS (WITH {bm25_sql()} SELECT query_id, doc_id, score FROM scores), {LISTED_SQL}, a AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM (SELECT u.query_id, u.doc_id, round(u.score * CASE WHEN ratio >= 0.3e0 THEN least(1 + 0.2e0 * ratio, 1.2e0) ELSE 1e0 END, 6) AS score FROM u JOIN bo USING (query_id, doc_id)))")
     + ", r AS (SELECT query_id, doc_id, score, tier, row_number() OVER (PARTITION BY query_id ORDER BY CASE tier WHEN 'excellent' THEN 0 WHEN 'good' THEN 1 ELSE 2 END, score DESC, doc_id) AS rank FROM seen) SELECT * FROM r WHERE rank <= 12")
def _(spark, sf):
    q, docs = inputs(spark, sf)
    scores, t = IX.build(docs).scores(q), T.tokens(F.col("query"))
    held = lambda i: F.contains(F.lower(F.coalesce("text", L(""))), F.get(t, i)).cast("int")
    # What a checklist asks for is looked for in the documents that a query scores.
    ratio = (F.coalesce(held(0), L(0)) + F.coalesce(held(1), L(0))) / 2
    pairs = scores.select("query_id", "doc_id").join(docs, "doc_id").join(q.withColumnRenamed("text", "query"), "query_id")
    boosts = pairs.select("query_id", "doc_id", F.when(ratio >= 0.3, F.least(1 + 0.2 * ratio, L(1.2))).otherwise(1.0).alias("boost"))
    evaluator = PG.by_provider(lambda batches: (b[["query_id", "doc_id", "answer"]] for b in batches), view(spark, sf, SAYS), q)
    return PG.progressive_with_checklist(scores, boosts, evaluator)[0].select("query_id", "doc_id", "score", "tier", "rank")


@add("progressive_searches", f"{LOOP_SQL} SELECT query_id, any_value(stop_reason) AS stop_reason, any_value(rounds) AS rounds_used, count(*) AS reviewed, count(*) FILTER (tier = 'excellent') AS excellent, count(*) FILTER (tier = 'good') AS good, count(*) FILTER (tier = 'ill-fit') AS ill_fit FROM seen GROUP BY query_id")
def _(spark, sf):
    return loop(spark, sf)[1]


# A heuristic by points, and what a search answers

STATED = """SELECT s_suppkey AS doc_id, concat(n_name, CASE WHEN s_suppkey % 5 <> 0 THEN ' Greater London' ELSE '' END) AS region, CASE WHEN s_suppkey % 3 = 0 THEN 'Chronic Pelvic Pain' END AS specialty, CASE WHEN s_suppkey % 7 <> 0 THEN concat(CASE s_suppkey % 4 WHEN 0 THEN 'Pelvic Pain|Sports injuries' WHEN 1 THEN 'pelvic pain|Urogynaecology' WHEN 2 THEN 'Musculo Skeletal' ELSE 'pelvic pains' END, '|', s_name) END AS listed,
  CASE WHEN s_suppkey % 2 = 0 THEN 'Full Member' ELSE 'Associate' END AS member, CASE WHEN s_suppkey % 6 <> 0 THEN concat('I treat ', CASE s_suppkey % 4 WHEN 0 THEN 'endometriosis and pelvic pain' WHEN 1 THEN 'CHRONIC tension, pain management' ELSE 'women' END, ' in ', n_name) END AS statement, CASE WHEN s_suppkey % 3 = 1 THEN s_name ELSE '' END AS website, CASE WHEN s_suppkey % 4 = 1 THEN s_name END AS practice FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
HOLDS = lambda c, v: f"contains(lower(coalesce({c}, '')), '{v}')"
POINTS_SQL = " + ".join([f"CASE WHEN {HOLDS('member', 'full member')} THEN 15 ELSE 0 END", *(f"CASE WHEN {HOLDS('listed', w)} THEN {n} ELSE 0 END" for w, n in PELVIC_SPECIALTIES), *(f"CASE WHEN {HOLDS('statement', w)} THEN 6 ELSE 0 END" for w in PELVIC_WORDS)])


@add("heuristic_score", f"""SELECT doc_id, CASE WHEN {HOLDS('region', 'london')} AND (coalesce(list_contains(string_split(lower(listed), '|'), 'pelvic pain'), false) OR {HOLDS('specialty', 'pelvic pain')}) THEN 60 + {POINTS_SQL} + CASE WHEN {HOLDS('statement', 'pelvic pain')} THEN 10 ELSE 0 END + CASE WHEN {HOLDS('statement', 'chronic')} OR {HOLDS('statement', 'pain management')} THEN 5 ELSE 0 END
 + CASE WHEN website <> '' THEN 5 ELSE 0 END + CASE WHEN practice <> '' THEN 3 ELSE 0 END ELSE -1 END AS score FROM ({STATED})""")
def _(spark, sf):
    c = F.col
    points = B.pelvic_specialist(c("region"), c("specialty"), F.split("listed", "[|]"), c("member"), c("statement"), c("website"), c("practice"))
    return view(spark, sf, STATED).select("doc_id", points.alias("score"))


ANSWERED = """SELECT doc_id, source AS name, lang AS specialty, text AS clinical_expertise, CASE WHEN doc_id % 3 <> 0 THEN 100e0 + doc_id % 7 * 25e-1 END AS new_fee, CASE WHEN doc_id % 4 <> 0 THEN 80e0 END AS later_fee, CASE doc_id % 5 WHEN 0 THEN 'EUR ' WHEN 1 THEN NULL ELSE 'GBP' END AS currency FROM documents"""


@add("search_response", f"""WITH {bm25_sql()}, d AS ({ANSWERED}), y AS (SELECT *, CASE WHEN currency = 'GBP' THEN '£' ELSE coalesce(currency, '') END AS s FROM d)
SELECT query_id, y.doc_id, rank, score * 2 AS score, score AS rescoring_score, name, CASE WHEN clinical_expertise <> '' THEN md5(substr(clinical_expertise, 1, 200) || '...') END AS expertise,
 nullif(concat_ws(', ', s || CASE WHEN new_fee = floor(new_fee) THEN new_fee::BIGINT::VARCHAR ELSE new_fee::VARCHAR END || ' (new)', s || later_fee::BIGINT::VARCHAR || ' (follow-up)'), '') AS pricing FROM ranked r JOIN y ON r.doc_id = y.doc_id WHERE rank <= 12""")
def _(spark, sf):
    top = ranked(bm25(*inputs(spark, sf), top=12), 12).withColumn("bm25_score", F.col("score")).withColumn("score", F.col("score") * 2)
    fees = F.struct(F.col("new_fee").alias("new_appointment"), F.col("later_fee").alias("follow_up"), "currency")
    made = PR.response(top, view(spark, sf, ANSWERED).withColumn("fees", fees))
    return made.select("query_id", "doc_id", "rank", "score", F.round("rescoring_score", 6).alias("rescoring_score"), "name", F.md5(F.col("clinical_expertise").cast("binary")).alias("expertise"), "pricing")
