"""Finding the phrases of a dictionary in texts, by equi-joins down a trie of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Joins the words of a node's name; no word holds it.
_SEP = "\x1f"


def trie(phrases: DataFrame, longest: int) -> DataFrame:
    """(phrase_id, words) -> (node, word, next, ends): an edge for each word that follows a beginning of a phrase.

    A node is named by its words; ``ends`` lists the phrases that end with the edge.
    Phrases without words or with more than ``longest`` are in no trie.
    """
    kept = phrases.where((F.size("words") >= 1) & (F.size("words") <= longest))
    steps = kept.select("phrase_id", "words", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("depth"))
    name = lambda n: F.array_join(F.slice("words", F.lit(1), n), _SEP)
    edges = steps.select(name(F.col("depth") - 1).alias("node"), F.get("words", F.col("depth") - 1).alias("word"), name(F.col("depth")).alias("next"), F.when(F.col("depth") == F.size("words"), F.col("phrase_id")).alias("phrase_id"))
    return edges.groupBy("node", "word", "next").agg(F.collect_set("phrase_id").alias("ends"))


def matches(texts: DataFrame, phrases: DataFrame, longest: int = 6) -> DataFrame:
    """(text_id, words), (phrase_id, words) -> (text_id, phrase_id, start, size): every place where a phrase stands in a text.

    Every position of a text starts at the root, and a join on (node, next word) takes it
    one word further, so work follows the words that agree and not texts times phrases.
    What travels is the ``longest`` words from a position on, never a text.  Starts count
    from 0.  Null texts and words match nothing; repeated phrases match under each id.
    """
    edges = trie(phrases, longest)
    roots = edges.where(F.col("node") == "")
    at = texts.select("text_id", F.posexplode(F.transform("words", lambda w, i: F.struct(w.alias("word"), F.slice("words", i + 2, longest - 1).alias("rest"))))).select("text_id", F.col("pos").alias("start"), "col.word", "col.rest")
    live = at.join(roots.select("word", "next", "ends"), "word").select("text_id", "start", "rest", F.col("next").alias("node"), "ends")
    found = []
    for size in range(1, longest + 1):
        found.append(live.where(F.size("ends") > 0).select("text_id", F.explode("ends").alias("phrase_id"), "start", F.lit(size).alias("size")))
        if size < longest:
            # The depth is part of the key: an edge below is one word deeper.
            live = live.withColumn("word", F.get("rest", F.lit(size - 1))).drop("ends").join(edges, ["node", "word"]).select("text_id", "start", "rest", F.col("next").alias("node"), "ends")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def leftmost_longest(hits: DataFrame) -> DataFrame:
    """Matches that do not overlap: from the left, at each place the longest (ties: the first in ``priority``, then the least phrase_id).

    hits: (text_id, phrase_id, start, size, priority).  One text's matches are folded in order.
    """
    best = hits.groupBy("text_id", "start").agg(F.min(F.struct((-F.col("size")).alias("by_size"), "priority", "phrase_id")).alias("b"))
    row = F.struct("start", (-F.col("b.by_size")).alias("size"), F.col("b.phrase_id").alias("phrase_id"))
    ordered = best.groupBy("text_id").agg(F.sort_array(F.collect_list(row)).alias("m"))
    kind = ordered.schema["m"].dataType.simpleString()
    empty = F.struct(F.lit(0).alias("until"), F.expr(f"cast(array() as {kind})").alias("kept"))
    step = lambda acc, x: F.when(x["start"] >= acc["until"], F.struct((x["start"] + x["size"]).alias("until"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)
    return ordered.select("text_id", F.explode(F.aggregate("m", empty, step, lambda acc: acc["kept"])).alias("x")).select("text_id", "x.phrase_id", "x.start", "x.size")


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores, in lower case; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
