"""Quality by weak supervision: rules vote or abstain, EM weighs them (native DataFrame code).

Each rule looks at one property of a text and votes good (1), bad (-1) or abstains
(0).  How often each rule votes each way for good texts and for each kind of bad text
is estimated without labels by expectation-maximisation over the table of vote patterns, which
has at most 3 ** rules rows however many texts there are.  A text is judged by the
posterior probability that it is good, given all its votes, instead of having to
pass every rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, fresh, stage, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def measure(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Counts of each whole text, beside the ``keep`` columns (doc_id alone by default).

    n_words; word_chars (code points in words); n_symbols (of SYMBOLS); n_lines (with a
    word); n_dup_lines (of those, equal to an earlier line); n_repeat_words (words in
    windows of five that occur twice or more in the text, the first one included);
    n_letters, n_capitals, n_bangs (of ``!!``), n_ended (lines that end like a
    sentence).  Null and empty texts count 0 throughout.  Windows are compared by
    64-bit hashes chained over their words.
    """
    names = keep or ["doc_id"]
    own = {c: fresh(c, names) for c in ("text", "words", "lines", "windows", "sorted")}
    text, w, g, lines = (F.col(own[c]) for c in ("text", "words", "windows", "lines"))
    has_word = lambda line: F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) > 0
    windows = F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))
    by_hash = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    s = F.col(own["sorted"])
    twice = F.sort_array(
        F.filter(
            F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])),
            lambda i: i.isNotNull(),
        )
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(twice, start, lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n")), lambda acc: acc["n"])
    return (
        documents.select(*names, F.coalesce("text", F.lit("")).alias(own["text"]))
        .withColumn(own["words"], words(text))
        .withColumn(own["lines"], F.filter(F.split(text, "\n"), has_word))
        .withColumn(own["windows"], windows)
        .withColumn(own["sorted"], F.when(F.size(F.array_distinct(g)) < F.size(g), by_hash))
        .select(
            *names,
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, GAP, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.when(s.isNotNull(), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
            (F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))).cast("long").alias("n_letters"),
            (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_capitals"),
            F.regexp_count(text, F.lit("!!+")).cast("long").alias("n_bangs"),
            F.size(F.filter(lines, lambda x: F.rtrim(x).rlike(r"[.!?…。！？:;\"'”»)]$"))).cast("long").alias("n_ended"),
        )
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """The voting rules over the columns of :func:`measure`; all abstain on a text without words, but ``length``."""
    n, lines = F.col("n_words"), F.col("n_lines")
    some, many = n > 0, n >= 20
    per_word = lambda c: F.col(c) / F.greatest(n, F.lit(1))
    letters = F.col("n_letters") / F.greatest(F.col("word_chars"), F.lit(1))
    capitals = F.col("n_capitals") / F.greatest(F.col("n_letters"), F.lit(1))
    dup = F.col("n_dup_lines") / F.greatest(lines, F.lit(1))
    return {
        "length": _vote((n >= 30) & (n <= 100_000), n < 10),
        "word_length": _vote(some & per_word("word_chars").between(2.5, 10), some & ~per_word("word_chars").between(1.5, 20)),
        "symbols": _vote(some & (per_word("n_symbols") < 0.02), some & (per_word("n_symbols") > 0.1)),
        "dup_lines": _vote((lines >= 3) & (dup < 0.05), (lines >= 3) & (dup > 0.3)),
        "repeats": _vote(many & (per_word("n_repeat_words") < 0.05), many & (per_word("n_repeat_words") > 0.2)),
        "letters": _vote(some & (letters > 0.85), some & (letters < 0.6)),
        "capitals": _vote(many & (capitals < 0.2), many & (capitals > 0.5)),
        "bangs": _vote(many & (F.col("n_bangs") == 0), many & (per_word("n_bangs") > 0.1)),
        "sentences": _vote(some & (F.col("n_ended") >= 0.5 * lines), many & (F.col("n_ended") < 0.1 * lines)),
    }


#: Kinds of bad text, and the rules that speak for each first; EM is free to change that.
KINDS = {"noise": ("symbols", "letters"), "repetition": ("dup_lines", "repeats"), "shouting": ("capitals", "bangs"), "fragment": ("length", "word_length", "sentences")}

#: Keeps the classes apart: a rule votes against a good text once in a hundred at most.
MOST_WRONG = 0.01


@dataclass(frozen=True)
class LabelModel:
    """Log-shares of the classes (good first, then KINDS) and, for each rule, log P(good vote) and log P(bad vote) by class."""

    log_share: tuple[float, ...]
    log_good: dict[str, tuple[float, ...]]
    log_bad: dict[str, tuple[float, ...]]

    def posterior(self, prefix: str = "vote_") -> Column:
        """P(good | votes); a rule that abstains says nothing."""
        logs = []
        for k, share in enumerate(self.log_share):
            total = F.lit(share)
            for rule in self.log_good:
                total = total + F.when(F.col(prefix + rule) == 1, F.lit(self.log_good[rule][k])).when(F.col(prefix + rule) == -1, F.lit(self.log_bad[rule][k])).otherwise(F.lit(0.0))
            logs.append(total)
        return 1 / sum((F.exp(x - logs[0]) for x in logs[1:]), F.lit(1.0))


def fit(patterns: dict[tuple[int, ...], int], names: list[str], *, rounds: int = 50, pseudo: float = 10.0) -> LabelModel:
    """EM over vote patterns and their counts (plain arithmetic on at most 3 ** rules rows).

    Bad texts are of several kinds which seldom trip the same rules, so a single bad
    class would see its rules contradict each other; there is a class for good texts
    and one for each of KINDS.  It starts by believing patterns without a bad vote,
    and pseudo-counts stand in for the data where there is none.
    """
    members = list(KINDS.values())
    k_all = range(1 + len(members))
    ordered = sorted(patterns.items())
    belief = {}
    for p, _ in ordered:
        tripped = [k for k in k_all if k and any(v == -1 and name in members[k - 1] for name, v in zip(names, p))]
        belief[p] = [0.95 if k == 0 else 0.05 / len(members) for k in k_all] if not tripped else [0.1 if k == 0 else 0.9 / len(tripped) * (k in tripped) for k in k_all]
    share0 = [0.8] + [0.2 / len(members)] * len(members)
    for _ in range(rounds):
        mass = [sum(n * belief[p][k] for p, n in ordered) for k in k_all]
        total = sum(mass)
        log_share = tuple(math.log((m + pseudo * s) / (total + pseudo)) for m, s in zip(mass, share0))
        log_good, log_bad = {}, {}
        for j, name in enumerate(names):
            rates = []
            for k in k_all:
                bad = sum(n * belief[p][k] for p, n in ordered if p[j] == -1)
                good = sum(n * belief[p][k] for p, n in ordered if p[j] == 1)
                expected = 0.005 if k == 0 else 0.5 if name in members[k - 1] else 0.05
                rate = (bad + pseudo * expected) / (bad + good + pseudo)
                rates.append(min(rate, MOST_WRONG) if k == 0 else rate)
            log_bad[name] = tuple(math.log(r) for r in rates)
            log_good[name] = tuple(math.log(1 - r) for r in rates)
        for p, _ in ordered:
            logs = [log_share[k] + sum(log_good[name][k] if v == 1 else log_bad[name][k] for name, v in zip(names, p) if v) for k in k_all]
            top = max(logs)
            e = [math.exp(x - top) for x in logs]
            belief[p] = [x / sum(e) for x in e]
    return LabelModel(log_share, log_good, log_bad)


def judge(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns of :func:`measure`, a vote of each rule (columns ``vote_*``) and ``quality``, the posterior of good.

    One row per input row; rows are judged by their own text, so nulls, ties and
    repeated rows need no rule of their own: null and empty texts get the bad vote of
    ``length`` only.  Whole texts count; a text is one row, so its words and windows must
    fit into a task's memory.  No rows: no rows.  ``keep`` must not name the columns added.
    """
    votes = {f"vote_{k}": v for k, v in rules().items()}
    measured = stage(measure(documents, keep).select("*", *[v.alias(k) for k, v in votes.items()]), "quality-votes")
    patterns = {tuple(r[k] for k in votes): r["n"] for r in measured.groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).collect()}
    model = fit(patterns, list(rules()))
    return measured.withColumn("quality", model.posterior())


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
