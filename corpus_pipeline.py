"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of
documents; the last returns token ids.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import jaccard, langid, mixing, pii, registry, sentencepiece_codec
from rankloom.llm.common import fresh, small_batches, stage


def with_small_batches(f):
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, docs, sf_dir)

    return run


@with_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without any letter (or text) go.

    The model is learned from the rows with a language; if there is none, nothing is
    known and only texts without letters go.  A missing language is filled in.
    """
    model = langid.learn(docs)
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = fresh("found", docs.columns)
    named = docs.withColumn(found, langid.identify(model)("text")).where(F.col(found)["lang_pred"] != langid.UNKNOWN)
    filled = F.coalesce("lang", F.col(found)["lang_pred"]).alias("lang")
    return named.select(*[filled if c == "lang" else F.col(c) for c in docs.columns])


@with_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: the one with the least id, nulls last."""
    return jaccard.one_of_each(docs, k=5, num=80, den=100)


@with_small_batches
def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers replaced; n_chars follows the new text."""
    new = fresh("new", docs.columns)
    text = F.col(new)["text"]
    done = {"text": text.alias("text"), "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars")}
    return docs.withColumn(new, pii.pseudonyms(registry.pii_key(spark))("text")).select(*[done.get(c, F.col(c)) for c in docs.columns])


@with_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (0, 1 or 2 times)."""
    return mixing.apply_mix(docs)


@with_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row; a document taken twice has two rows."""
    ids = sentencepiece_codec.encode(docs, sentencepiece_codec.load(registry.SENTENCEPIECE_MODEL), fixed=True)  # each stage reads files
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("pseudonyms", pseudonymise),
    ("mix", mix_sources),
    ("sentencepiece", encode),
]

#: Learned models, keyed permutations and merges have no SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
