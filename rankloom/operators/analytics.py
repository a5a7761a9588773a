"""Counts and checks over profiles, picks, evaluations and chats."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from .best import Best

# Labels of reasons that name a field instead of a concept.
FIELD_LABELS = ("clinical expertise", "procedures", "conditions")


def membership(rows: DataFrame, sources: Column, names: list[str]) -> DataFrame:
    """One row: how many rows there are, and how many have a source that contains each name, regardless of case."""
    has = lambda name: F.coalesce(F.exists(sources, lambda s: F.contains(F.lower(s), F.lit(name.lower()))), F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(has(n)).alias(f"with_{n.lower()}") for n in names])


def variant_tallies(bookings: DataFrame, flags: DataFrame, precision: DataFrame) -> DataFrame:
    """By variant: bookings, flagged results, and the mean of its known precision.

    bookings: (variant); flags: (variant, flagged); precision: (variant, precision).
    A variant appears if any of the three has it.
    """
    a = bookings.groupBy("variant").agg(F.count(F.lit(1)).alias("bookings"))
    b = flags.groupBy("variant").agg(F.count_if("flagged").alias("flags"))
    c = precision.groupBy("variant").agg(F.round(F.avg("precision"), 6).alias("mean_precision"))
    out = a.join(b, "variant", "full").join(c, "variant", "full")
    return out.select("variant", F.coalesce("bookings", F.lit(0)).alias("bookings"), F.coalesce("flags", F.lit(0)).alias("flags"), "mean_precision")


def pick_sources(picks: DataFrame, pool: DataFrame) -> DataFrame:
    """Where picks (query_id, doc_id) came from: pool_source (``not_in_pool`` for none), n and its percentage of all."""
    rows = picks.join(pool.select("query_id", "doc_id", "pool_source"), ["query_id", "doc_id"], "left").withColumn("pool_source", F.coalesce("pool_source", F.lit("not_in_pool")))
    counts = rows.groupBy("pool_source").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("pool_source", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("percent"))


def verdicts(rows: DataFrame) -> DataFrame:
    """(verdict, excellent) -> how often each overall verdict was given, and the excellent picks among its cases."""
    return rows.groupBy("verdict").agg(F.countDistinct("case_id").alias("cases"), F.count_if("excellent").alias("excellent"), F.count(F.lit(1)).alias("picks"))


def unknown_names(cases: DataFrame, profiles: DataFrame) -> DataFrame:
    """(case_id, name) of the truths whose name, regardless of case, no profile has."""
    known = profiles.select(F.lower(F.trim("name")).alias("key")).where("key <> ''").distinct()
    return cases.withColumn("key", F.lower("name")).join(known, "key", "left_anti").select("case_id", "name")


def flag_record(doc_id: Column, name: Column, reason: Column) -> Column:
    return F.struct(doc_id.alias("doc_id"), name.alias("name"), F.lit(True).alias("flagged"), F.coalesce(reason, F.lit("No reason provided")).alias("reason"))


def booking_record(doc_id: Column, name: Column, variant: Column) -> Column:
    return F.struct(doc_id.alias("doc_id"), name.alias("name"), variant.alias("variant"))


def session_counts(messages: DataFrame) -> DataFrame:
    """(session, recommendations) -> sessions with their numbers of messages and recommendations, and the first stamp."""
    return messages.groupBy("session").agg(F.count(F.lit(1)).alias("messages"), F.sum("recommendations").alias("recommendations"), F.min("stamp").alias("first_stamp"))


def latest_by_phone(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id): the latest right row (right_id, phone, seen) with a left row's (left_id, phone) telephone number, ties to the greatest right_id.

    Each number's latest row is found before the two sides meet, so a number is joined with one row, however many have it.
    """
    latest = right.where("phone is not null").groupBy("phone").agg(F.max(F.struct("seen", "right_id")).alias("r"))
    return left.where("phone is not null").select("left_id", "phone").join(latest, "phone").groupBy("left_id").agg(F.max("r").alias("r")).select("left_id", "r.right_id")


def best_by_detail(left: DataFrame, right: DataFrame, long: int = 50) -> DataFrame:
    """Of the log entries of a session's day the most detailed: with filters and a query longer than ``long`` counts 2, one of them 1; ties to the earliest.

    left: (left_id, day, phone); right: (right_id, day, phone, seen, query, filters).  An
    entry with the session's own telephone number goes before any by day.
    """
    points = F.when(F.col("filters").isNotNull(), 1).otherwise(0) + F.when(F.length("query") > long, 1).otherwise(0)
    log = right.withColumn("points", points)
    by_phone = latest_by_phone(left, log)
    # The best entry of a day is the same for all its sessions, so the join meets one row a day.
    best = log.groupBy("day").agg(F.min(F.struct((-F.col("points")).alias("p"), "seen", "right_id")).alias("b")).select("day", F.col("b.right_id").alias("right_id"))
    by_day = left.join(by_phone, "left_id", "left_anti").join(best, "day").select("left_id", "right_id")
    return by_phone.select("left_id", "right_id", F.lit("phone").alias("how")).unionByName(by_day.select("left_id", "right_id", F.lit("day").alias("how")))


def reason_terms(factors: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Concepts of reasons: of ``label: value`` the value unless the label names a field, of ``X in Y`` X and the words of Y, else the whole; phrases and their words, in lower case."""
    words = lambda s: F.filter(F.split(F.regexp_replace(F.lower(s), r"[^\w\s-]", " "), r"\s+"), lambda w: (F.length(w) >= 2) & ~w.isin(*(stop_words or ("",))))
    none = F.array().cast("array<string>")
    both = lambda s: F.when(F.length(s) >= 2, F.concat(words(s), F.array(F.lower(s)))).otherwise(none)

    def of(factor: Column) -> Column:
        f = F.trim(factor)
        colon = F.instr(f, ":")
        value = F.when(colon > 0, F.trim(F.substring(f, colon + 1, F.length(f)))).otherwise(f)
        label = F.lower(F.trim(F.substring(f, F.lit(1), F.greatest(colon - 1, F.lit(0)))))
        named = F.when((colon > 0) & ~label.isin(*FIELD_LABELS), both(value)).otherwise(none)
        parts = F.split(value, r"(?i)\s+in\s+", 2)
        x, y = F.trim(F.get(parts, 0)), F.trim(F.get(parts, 1))
        within = F.concat(both(x), F.when((F.length(y) >= 2) & ~F.lower(y).isin(*FIELD_LABELS), words(y)).otherwise(none))
        return F.concat(named, F.when(F.size(parts) > 1, within).otherwise(both(value)))

    return F.array_distinct(F.flatten(F.transform(factors, of)))


def session_terms(*phrases: Column) -> Column:
    """Phrases of a session context in lower case, and their words."""
    every = F.concat(*phrases)
    words = F.flatten(F.transform(every, lambda p: F.filter(F.split(F.regexp_replace(F.lower(p), r"[^\w\s-]", " "), r"\s+"), lambda w: F.length(w) >= 2)))
    return F.array_distinct(F.concat(words, F.transform(F.filter(every, lambda p: F.length(p) >= 2), lambda p: F.lower(p))))


def places_said(text: Column, known: tuple[str, ...] = C.KNOWN_PLACES, refused: tuple[str, ...] = C.NO_PLACES, names: tuple[str, ...] = C.FIRST_NAMES, whole_words: bool = False) -> Column:
    """Array of struct<place, pattern, at>: the places that a text names, each once regardless of case.

    The seven ways of naming one are tried in order over the whole text; what they catch is
    cleaned and kept if it looks like a place: four words at most, the first in capitals,
    with a known place among more than two words, no first name with a surname, no refused
    word.  ``pattern`` says which way found it first (from 1), ``at`` where the words stand (from 1).
    A refused word counts wherever its letters stand, even within a longer one (so
    Sheffield, which holds "he", is never a place); ``whole_words`` takes words only.
    Null text: no places.
    """
    none = F.expr("cast(array() as array<struct<pattern: int, raw: string>>)")

    def by(n: int, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(n).alias("pattern"), x.alias("raw")))

    caught = F.coalesce(F.concat(*[by(n, p) for n, p in enumerate(C.PLACE_PATTERNS, 1)]), none)

    def cleaned(x: Column) -> Column:
        for pattern, by in C.PLACE_CLEANING:
            x = F.trim(F.regexp_replace(x, pattern, by))
        return x

    lists = {n: F.array(*[F.lit(v.lower()) for v in values]) for n, values in (("known", known), ("refused", refused), ("names", names))}

    def looks(place: Column) -> Column:
        low, n, words = F.lower(place), F.size(F.split(place, " ")), F.split(F.lower(place), " ")
        holds = lambda v: F.contains(low, v)
        some = F.exists(lists["known"], holds)
        real = F.exists(lists["known"], lambda v: (low == v) | F.startswith(low, F.concat(v, F.lit(" "))) | F.contains(low, F.concat(F.lit(" "), v)) | (F.contains(v, F.lit(" ")) & F.contains(low, F.get(F.split(v, " "), F.lit(0)))))
        bad = F.arrays_overlap(words, lists["refused"]) if whole_words else F.exists(lists["refused"], holds)
        form = real | ((n == 1) & place.rlike("^[A-Z][a-z]{3,}$")) | n.between(2, 3)
        person = (n == 2) & F.array_contains(lists["names"], F.get(words, 0))
        return (n <= 4) & place.rlike("^[A-Z]") & ~person & ~(holds(F.lit("terms")) | (holds(F.lit("but")) & (n == 2))) & (some | (n <= 2)) & ~bad & form & F.length(place).between(3, 50)

    # Each step is taken once: the next looks at its result.
    made = F.transform(caught, lambda c: F.struct(cleaned(c["raw"]).alias("place"), c["pattern"].alias("pattern"), F.instr(text, c["raw"]).alias("at")))
    good = F.filter(made, lambda m: looks(m["place"]))
    first = lambda acc, m: F.when(F.exists(acc, lambda y: F.lower(y["place"]) == F.lower(m["place"])), acc).otherwise(F.concat(acc, F.array(m)))
    return F.aggregate(good, F.expr("cast(array() as array<struct<place: string, pattern: int, at: int>>)"), first)


#: Words whose needles a task remembers at a time, the longest that are remembered, and documents that are counted at a time.
REMEMBERED, LONGEST, TOGETHER = 1 << 17, 64, 64


class Within:
    """Which needles, by number, a text contains; needles have only the letters that ``letters`` finds runs of."""

    def __init__(self, needles: list[str], letters: str):
        self.number = {x: i for i, x in enumerate(needles)}
        self.sizes = sorted({len(x) for x in needles})
        self.letters = re.compile(letters)
        self.known: dict[str, tuple[int, ...]] = {}

    def _held(self, word: str) -> tuple[int, ...]:
        parts = {word[at : at + n] for n in self.sizes if n <= len(word) for at in range(len(word) - n + 1)}
        return tuple(self.number[x] for x in parts if x in self.number)

    def words(self, text: str) -> set[str]:
        return set(self.letters.findall(text))

    def of(self, words: set[str]) -> set[int]:
        """The needles within some of the words."""
        found: set[int] = set()
        for word in words:
            own = self.known.get(word)
            if own is None:
                own = self._held(word)
                if len(word) <= LONGEST:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[word] = own
            found.update(own)
        return found


def _overlaps(needles: list[str], heads: np.ndarray, query_of: np.ndarray, names: pa.Array, top: int | None):
    """(doc_id, lower-case text) -> (query_id, doc_id, score); heads: where each needle's queries begin in ``query_of``, and the end of the last."""
    size_of = np.diff(heads)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within = Within(needles, "[a-z0-9-]{2,}")
        best = Best(len(names), top) if top else None

        def cells(q: np.ndarray, doc: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(doc), pa.array(score.astype(np.int64))], names=["query_id", "doc_id", "score"])

        for batch in batches:
            for part in (batch.slice(at, TOGETHER) for at in range(0, len(batch), TOGETHER)):
                found = [np.fromiter(within.of(within.words(x)), np.int64) for x in part["text"].to_pylist()]
                each = np.concatenate(found)
                count = size_of[each]
                at = np.repeat(heads[each] - np.cumsum(count) + count, count) + np.arange(count.sum())
                document = np.repeat(np.repeat(np.arange(len(part)), [len(x) for x in found]), count)
                score = np.bincount(document * len(names) + query_of[at], minlength=len(part) * len(names)).reshape(len(part), -1)
                document, q = np.nonzero((score > 0) & (score >= best.floor) if best else score)
                doc, score = part["doc_id"].to_numpy()[document], score[document, q]
                if best:
                    best.add(q, score.astype(float), doc)
                else:
                    yield cells(q, doc, score)
        if best:
            yield cells(*best.rows())

    return run


def keyword_overlap(queries: DataFrame, documents: DataFrame, top: int | None = None) -> DataFrame:
    """(query_id, doc_id, score): how many distinct words of a query a document's text contains, also within longer words.

    A query's words have only letters of ``hyphen_tokens``, so one is in a text if it is in one of the
    text's runs of these.  The queries' words are sent to the tasks, which look them up where texts are
    read: neither words nor pairs are shuffled.  With ``top``, a task gives only its best of every
    query (ties: the smaller id).  doc_id: a whole number, which comes once.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(T.hyphen_tokens(F.col("text")))).alias("needle")).distinct().toArrow().combine_chunks().sort_by([("needle", "ascending"), ("query_id", "ascending")])
    out = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id long, score long"
    if not asked.num_rows:
        return documents.sparkSession.createDataFrame([], out)
    needles, names = pc.unique(asked["needle"]), pc.unique(asked["query_id"])
    at, query_of = (pc.index_in(asked[c], v).to_numpy().astype(np.int64) for c, v in (("needle", needles), ("query_id", names)))
    heads = np.searchsorted(at, np.arange(len(needles) + 1))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return texts.mapInArrow(_overlaps(needles.to_pylist(), heads, query_of, names, top), out)


def top_counts(rows: DataFrame, column: str, top: int) -> DataFrame:
    """The ``top`` most frequent values and their counts, ties by value."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(top)


def lexicons(rows: DataFrame, group: str, term: Column) -> DataFrame:
    """Distinct lower-case terms of each group and of all (group null), sorted."""
    each = rows.select(F.col(group).alias("grp"), F.lower(F.trim(term)).alias("term")).where("term <> ''").distinct()
    both = each.unionByName(each.select(F.lit(None).cast(each.schema["grp"].dataType).alias("grp"), "term").distinct())
    return both.groupBy("grp").agg(F.sort_array(F.collect_list("term")).alias("terms"))
