"""Which documents hold which strings of words, by equi-joins instead of looking for every string in every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..staging import stage

#: Words of a phrase are longer than two characters, so these many at its outer ends can be compared for equality.
END = 3
#: Queries of so few blank-separated pieces have no two pieces that a text must hold as they are; so many are looked for at once.
FEW, TOGETHER = 3, 4096


def _keys(at) -> list[Column]:
    """Hashes by which a place in a text meets what may stand there, of two and of three pieces; ``at(i)`` is the i-th piece from the place on."""
    last, first = (lambda w: F.right(w, F.lit(END))), (lambda w: F.left(w, F.lit(END)))
    return [F.xxhash64(F.lit(1), last(at(0)), first(at(1))), F.xxhash64(F.lit(2), last(at(0)), at(1), first(at(2)))]


def _needles(phrases: DataFrame, wholes: DataFrame) -> DataFrame:
    """(needle) of both kinds -> needle, pieces, key, at: the hash of some of its pieces, and where in it these begin."""
    p = phrases.select("needle", F.split("needle", " ").alias("pieces"))
    two, three = _keys(lambda i: F.get("pieces", F.lit(i)))
    by_ends = p.select("needle", "pieces", F.when(F.size("pieces") == 2, two).otherwise(three).alias("key"), F.lit(0).alias("at"))
    w = wholes.select("needle", F.split("needle", " ").alias("pieces")).where(F.size("pieces") > FEW)
    # Of the pieces between the first and the last, the longest two neighbours are the least common.
    inner = F.sequence(F.lit(1), F.greatest(F.size("pieces") - 3, F.lit(1)))
    width = lambda i: F.least(F.length(F.get("pieces", i)), F.lit(END)) + F.least(F.length(F.get("pieces", i + 1)), F.lit(END))
    w = w.withColumn("at", -F.array_max(F.transform(inner, lambda i: F.struct(width(i).alias("width"), (-i).alias("at"))))["at"])
    return by_ends.unionByName(w.select("needle", "pieces", _keys(lambda i: F.get("pieces", F.col("at") + i))[0].alias("key"), "at"))


def holders(phrases: DataFrame, wholes: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, needle) once for every document (doc_id, text) whose text contains the needle, both in lower case.

    phrases: two or three words of three characters or more with a blank between; wholes: any
    strings that are not empty.  A string is contained where blank-separated pieces of
    the text follow each other, the first ending with the string's first piece, the last
    beginning with its last, those between equal.  Places in a text are hashed and meet the
    needles by equality; the pieces are compared where they are, so neither texts nor their
    words are shuffled.  Wholes of three pieces or fewer have nothing to be hashed; they
    are looked for in every text, many at a time.
    """
    asked = stage(_needles(phrases, wholes), "needles")
    low = documents.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("body"))
    places = low.select("doc_id", F.split("body", " ").alias("w")).select("doc_id", "w", F.posexplode("w").alias("pos", "word"))
    keys = _keys(lambda i: F.col("word") if i == 0 else F.get("w", F.col("pos") + i))
    met = places.select("doc_id", "w", "pos", F.explode(F.array(*keys)).alias("key")).join(asked, "key")
    n, begin = F.size("pieces"), F.col("pos") - F.col("at")
    between = F.slice("w", begin + 2, n - 2) == F.slice("pieces", F.lit(2), n - 2)
    here = F.endswith(F.get("w", begin), F.get("pieces", F.lit(0))) & F.startswith(F.get("w", begin + n - 1), F.element_at("pieces", -1))
    found = met.where((begin >= 0) & (begin + n <= F.size("w"))).where(here & ((n == 2) | between)).select("doc_id", "needle")
    short = wholes.where(F.size(F.split("needle", " ")) <= FEW).distinct().withColumn("b", F.floor(F.monotonically_increasing_id() / TOGETHER)).groupBy("b").agg(F.collect_list("needle").alias("q"))
    looked = low.join(F.broadcast(short.select("q"))).select("doc_id", F.explode(F.filter("q", lambda q: F.contains(F.col("body"), q))).alias("needle"))  # TOGETHER short strings a row
    return found.unionByName(looked).distinct()


def _runs(queries: DataFrame, longest: int) -> DataFrame:
    """(query_id, needle, times): a query's runs of 2 to ``longest`` words."""
    return queries.select("query_id", F.explode(T.phrases(F.col("text"), longest)).alias("needle")).groupBy("query_id", "needle").agg(F.count(F.lit(1)).cast("double").alias("times"))


def phrase_hits(queries: DataFrame, documents: DataFrame, longest: int = 3) -> DataFrame:
    """(query_id, doc_id, phrases): how many of a query's runs of 2 to ``longest`` words a document's text contains; pairs without any are left out."""
    runs = _runs(queries, longest)
    hits = holders(runs.select("needle").distinct(), runs.select("needle").limit(0), documents)
    return hits.join(runs, "needle").groupBy("query_id", "doc_id").agg(F.sum("times").cast("long").alias("phrases"))


def bonuses(queries: DataFrame, documents: DataFrame, longest: int = 3) -> DataFrame:
    """(query_id, doc_id, bonus) as ``boosts.phrase_bonus`` has it, pairs without any left out: 2 for the whole query, 1 for each of its runs of words."""
    runs = _runs(queries, longest)
    wholes = queries.select("query_id", F.lower(F.trim("text")).alias("needle"), F.lit(2.0).alias("times")).where("needle <> ''")
    hits = holders(runs.select("needle").distinct(), wholes.select("needle").distinct(), documents)
    return hits.join(runs.unionByName(wholes), "needle").groupBy("query_id", "doc_id").agg(F.sum("times").alias("bonus"))
