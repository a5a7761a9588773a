"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, dedup, jaccard, langid, lexical, mixing, pii, quality, sentencepiece_codec, sharding, toxicity, whitening
from .common import id_fold, small_batches, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


ORACLES["op3_mix"] = r"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS skey, source, md5(coalesce(text, '')) AS said,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
totals AS (SELECT skey, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
placed AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM totals),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(place % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM placed),
ordered AS (
  SELECT *, most / weight AS ratio, row_number() OVER (ORDER BY most / weight, place) AS row FROM weighed),
shares AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - (sum(most) OVER (ORDER BY row) - most))
            / sum(weight) OVER (ORDER BY row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share_left
  FROM ordered),
levels AS (SELECT arg_min(share_left, row) AS level FROM shares WHERE share_left < ratio),
targets AS (
  SELECT skey, source_size,
         CASE WHEN share_left >= ratio THEN most ELSE least(most, weight * (SELECT level FROM levels)) END AS target
  FROM shares),
ranked AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         (('0x' || substr(md5('mix/' || s.skey), 1, 4))::BIGINT + 0.5::DOUBLE) / 65536 AS off,
         row_number() OVER (PARTITION BY s.skey ORDER BY lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 2, 3),
                            md5(coalesce(doc_id::VARCHAR, '') || '/' || said), doc_id NULLS FIRST, size) AS r
  FROM sized s JOIN targets t ON s.skey = t.skey)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (least(floor(rate * r + off) - floor(rate * (r - 1) + off), ceil(rate)) * size)::BIGINT AS taken
FROM ranked
"""


@query
def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksum's table is made by its rule, and folded over the bytes of each text.
ORACLES["op5_shard"] = r"""
WITH RECURSIVE bits(i, b, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT i, b + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM bits WHERE b < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE b = 8),
sized AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, size - 16), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM sized, tab),
placed AS (
  SELECT *, sum(size) OVER w - size AS begin, sum(size) OVER () AS all_bytes FROM crc
  WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cut AS (SELECT *, least(39, ((2 * begin + size) * 40) // (2 * all_bytes))::INT AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY begin) - 1 AS slot, NULL::INT AS grown_shard FROM cut
"""


def pii_key(spark: SparkSession) -> str:
    """The secret that the session names; without one a public word, good for demonstrations and tests only."""
    return spark.conf.get("spark.rankloom.pii.key", None) or "demonstration"


@query
def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.apply_pseudonyms(table(spark, sf_dir, "documents"), pii_key(spark))


@query
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_fold("doc_id", 4) == 2, F.lit(False))
    model = langid.learn(docs.where(~held_out & F.col("doc_id").isNotNull()))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(id_fold("doc_id", 5) == 0, F.lit(False))
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out))
    return toxicity.predict(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(*chat.prefix_tree(turns))


ORACLES["op2_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, len(role) + len(text) + 23
    + len(regexp_extract_all(role || chr(10) || text, '\\'))
    + len(regexp_extract_all(role || chr(10) || text, '<\|(turn|text|end)\|>|</?s>|<\|im_(start|end)\||<</?SYS>>|\[/?INST\]')) AS chars
  FROM turns),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
         sum(chars)::BIGINT AS formatted_chars
  FROM escaped GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, len(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM whole
"""


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    failed = quality.base_failed()
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("quality") >= 0.5)).alias("kept"), "quality")


@query
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 measures, and its base verdict: the part that SQL can state."""
    out = quality.measure(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.base_failed().alias("base_failed"))


ORACLES["quality_counts"] = r"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS x FROM words WHERE len(w) >= 5),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY r),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN covered ON words.r = covered.r)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
"""


@query
def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return ann.nearest(vectors, F.col("vec_id") % 50 == 0)


@query
def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


ORACLES["op9_jaccard"] = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS x FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes m ON a = m.doc_id JOIN sizes n ON b = n.doc_id WHERE 100 * shared >= 85 * (m.n + n.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (SELECT doc_id, doc_id FROM texts UNION SELECT b, root FROM reach JOIN edges ON a = node)
SELECT texts.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root) AS component_id
FROM texts JOIN reach ON node = texts.doc_id LEFT JOIN sizes ON sizes.doc_id = texts.doc_id GROUP BY texts.doc_id
"""


#: The model of the registered query; the path is a parameter of the operator's loader.
SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = sentencepiece_codec.load(SENTENCEPIECE_MODEL)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = sentencepiece_codec.encode(docs, pieces, fixed=True)  # read from files
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.md5(sentencepiece_codec.decode(F.col("ids"), pieces).cast("binary")).alias("decoded_md5"))


@query
def unigram_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's operator with the same pieces as a unigram model, where the lattice is folded by Viterbi."""
    pieces = sentencepiece_codec.as_unigram(sentencepiece_codec.load(SENTENCEPIECE_MODEL))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = sentencepiece_codec.encode(docs, pieces, fixed=True)  # read from files
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.md5(sentencepiece_codec.decode(F.col("ids"), pieces).cast("binary")).alias("decoded_md5"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")))


@query
def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


ORACLES["op12_search"] = r"""
WITH asked AS (
  SELECT item, any_value(item_id) AS item_id, unnest(list_distinct(any_value(t))) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark)
  GROUP BY item),
texts AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
stats AS (SELECT count(*)::BIGINT AS docs, sum(len(t))::BIGINT AS occurrences FROM texts WHERE len(t) > 0),
post AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM texts) GROUP BY ALL),
weighed AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM post, stats GROUP BY term, docs),
scores AS (
  SELECT item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // occurrences)))))::BIGINT AS score
  FROM asked JOIN post USING (term) JOIN weighed USING (term), stats GROUP BY item, item_id, row, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, row)::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op13_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.mark_copies(table(spark, sf_dir, "documents"), largest=True)


ORACLES["op13_dedup"] = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM texts
"""


@query
def whitening_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op11 measures in whole numbers: the part that SQL can state."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return whitening.whiten(vectors, components=1).select("vec_id", "n", "deviation")


ORACLES["whitening_deviations"] = r"""
WITH good AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT + 1000000) AS x
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
usual AS (SELECT len(x) AS d FROM good GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
mine AS (SELECT good.* FROM good, usual WHERE len(x) = d),
fit AS (SELECT DISTINCT x FROM mine),
size AS (SELECT count(*)::BIGINT AS n FROM fit),
totals AS (SELECT i, sum(c)::BIGINT AS s FROM (SELECT unnest(x) AS c, unnest(range(len(x))) AS i FROM fit) GROUP BY i),
entries AS (SELECT row, vec_id, unnest(x) AS c, unnest(range(len(x))) AS i FROM mine)
SELECT any_value(vec_id) AS vec_id, any_value(n) AS n, sum((n * c - s) * (n * c - s))::BIGINT AS deviation FROM entries JOIN totals USING (i), size GROUP BY row
"""
