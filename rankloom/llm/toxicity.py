"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text are rates, so they do not depend on its length alone: density
of lexicon words, of words learned from labelled texts, closeness of such words
to the second person, capitals, exclamation and other punctuation, and words
disguised by symbols or digits.  A bounded sample of labelled texts is enough to
learn the words, the trees and the calibration, each on a part of its own; every
text is then scored where it lies, batch by batch.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: English insults, contempt, threats and profanity; second-person words of four languages.
LEXICON = frozenset(
    """arsehole asshole bastard bitch brainless bullshit clown coward creep cretin crap cunt damn degenerate despicable
    dick dickhead disgrace disgusting dumb dumbass dunce fag faggot failure filth filthy fool freak fuck fucked fucker fucking
    garbage halfwit hate idiot idiotic idiots imbecile inbred jackass jerk kill knob kys lame leech loser losers lowlife
    lunatic maggot moron moronic morons nasty nazi nigger nitwit parasite pathetic pervert pig prick psycho puke rat repulsive
    retard retarded revolting scum scumbag shit shithead shitty shut sicko slut snake spineless stupid stupidity suck sucks
    swine thug toad trash trashy twat twit ugly useless vermin vile wanker weasel weirdo whore wimp worthless wretch
    abschaum arschloch blöd depp drecksau dumm dummkopf hurensohn idiotin scheisse scheiße schlampe trottel versager wichser
    connard connasse crétin débile imbécile merde nul ordure pute salaud salope abruti raclure
    basura cabrón estúpido gilipollas hijoputa idiota imbécil mierda pendejo perdedor puta tonto zorra""".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Characters that stand in for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": "", ".": "", "-": "", "_": ""})
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
FOREIGN = re.compile(r"[^\x00-\x7F]+")
EDGE = ".,;:!?\"'()[]{}…“”‘’«»¡¿*_-"
NEAR = 5
#: A learned entry is a whole word, or the beginning of one with a mark of that length.
STEMS = (4, 5, 6)

FEATURES = ["lexicon", "learned", "learned_count", "strongest", "stems", "stem_strongest", "near_you", "you", "capitals", "shouted", "exclaim", "question", "punctuation", "symbols", "digits", "disguised", "disguised_hits", "any_hit", "length"]

_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = 1 if "A" <= _ch <= "Z" else 2 if _ch == "!" else 3 if _ch == "?" else 4 if _ch in "#*$%&|<>@^~=+" else 5 if _ch.isdigit() and _c < 128 else 6 if _ch in ".,;:'\"()[]-" else 0


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    bias: float
    knots: tuple[np.ndarray, np.ndarray]


def _terms(text: str) -> list[str]:
    return [w for w in (t.strip(EDGE).lower() for t in TOKEN.findall(text)) if w]


def features(text: str, words: dict[str, float], stems: dict[str, float]) -> list[float]:
    """The dense features of one text, in the order of FEATURES; all 0 for an empty text."""
    raw = TOKEN.findall(text)
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=7)
    terms = [t.strip(EDGE).lower() for t in raw]
    seen = set(terms)
    lexicon = seen & LEXICON
    learned = seen & words.keys()
    stem_hits = {}
    for w in seen:
        if len(w) >= STEMS[0]:
            for k in STEMS:
                s = stems.get(w[:k])
                if s is not None:
                    stem_hits[w] = max(s, stem_hits.get(w, 0.0))
    disguised = [w for w in seen if len(w) > 2 and not w.isalpha() and any(c.isalpha() for c in w)]
    plain = {w.translate(LEET) for w in disguised}
    unmasked = {w for w in plain if w in LEXICON or w in words}
    hits = lexicon | learned | stem_hits.keys()
    hit_rate = near = 0.0
    if hits:
        at = np.asarray([i for i, w in enumerate(terms) if w in hits])
        hit_rate = sum(terms[i] in lexicon for i in at) / n
        you = np.asarray([i for i, w in enumerate(terms) if w in SECOND_PERSON])
        if you.size:
            after = np.searchsorted(you, at)
            gap = np.minimum(np.abs(at - you[np.maximum(after - 1, 0)]), np.abs(at - you[np.minimum(after, you.size - 1)]))
            near = float((gap <= NEAR).mean())
    return [
        100 * hit_rate,
        100 * len(learned) / n,
        float(len(learned)),
        max((words[w] for w in learned), default=0.0),
        float(len(stem_hits)),
        max(stem_hits.values(), default=0.0),
        near,
        100 * len(seen & SECOND_PERSON) / n,
        (kinds[1] + sum(map(str.isupper, "".join(FOREIGN.findall(text))))) / len(text),
        sum(t.isupper() and len(t) > 2 for t in raw) / n,
        kinds[2] / n,
        kinds[3] / n,
        kinds[6] / n,
        kinds[4] / n,
        kinds[5] / n,
        len(disguised) / n,
        float(len(unmasked)),
        float(bool(hits or unmasked)),
        math.log(n),
    ]


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least: int = 10):
    """Logistic gradient boosting on histograms; complete trees as (feature, threshold, leaf) arrays."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # bin b: above edge b-1
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    bias = math.log(p0 / (1 - p0))
    margin = np.full(len(y), bias)
    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature = np.zeros(2**depth - 1, np.int64)
        threshold = np.full(2**depth - 1, np.inf)
        for level in range(depth):
            n = 2**level
            base = n - 1
            best = np.zeros(n)
            for j, e in enumerate(edges):
                if not e.size:
                    continue
                width = e.size + 1
                key = node * width + binned[:, j]
                sums = [np.bincount(key, weights=v, minlength=n * width).reshape(n, width).cumsum(axis=1) for v in (g, h, np.ones(len(y)))]
                gl, hl, cl = (s[:, :-1] for s in sums)
                gt, ht, ct = (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(cl < least) | (ct - cl < least)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(n), k]
                for i in np.flatnonzero(top > best + 1e-9):
                    best[i], feature[base + i], threshold[base + i] = top[i], j, e[k[i]]
            at = base + node
            node = 2 * node + (x[np.arange(len(y)), feature[at]] > threshold[at])
        gs, hs = (np.bincount(node, weights=v, minlength=2**depth) for v in (g, h))
        leaf = -rate * gs / (hs + l2)
        margin += leaf[node]
        out.append((feature, threshold, leaf))
    return out, bias


def margins(x: np.ndarray, trees, bias: float) -> np.ndarray:
    total = np.full(len(x), bias)
    rows = np.arange(len(x))
    for feature, threshold, leaf in trees:
        node = np.zeros(len(x), np.int64)
        for level in range(int(math.log2(len(leaf)))):
            at = 2**level - 1 + node
            node = 2 * node + (x[rows, feature[at]] > threshold[at])
        total += leaf[node]
    return total


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots for interpolation, smoothed by one clean and one toxic row per block."""
    order = np.lexsort((y, margin))
    blocks: list[list[float]] = []  # sum of y, rows, sum of margins
    for m, v in zip(margin[order].tolist(), y[order].tolist()):
        blocks.append([v, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    xs = np.array([b[2] / b[1] for b in blocks])
    ys = np.maximum.accumulate(np.array([(b[0] + 0.5) / (b[1] + 1.0) for b in blocks]))
    return xs, ys


def learn(documents: DataFrame, labels: DataFrame, *, most: int = 20_000) -> Model:
    """Fit on documents (doc_id, text) and labels (doc_id, toxic).

    The sample is bounded: the ``most`` labelled rows of the least hash of doc_id.
    Two fifths of it give the learned words, two fifths the trees, one fifth the
    calibration.  Null ids, labels or texts teach nothing; an id with several labels
    counts as toxic if one says so.  Without toxic or without clean rows in the
    sample, every score is the lexicon's alone (see ``predict``).  An id with several texts
    teaches each of them.  Extra columns are ignored, whatever their names.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    order = F.xxhash64("doc_id")
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = stage(known.orderBy(order, "doc_id").limit(most), "toxicity-sample")
    chosen = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(ids, "doc_id")  # Spark checks the size before broadcasting
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5))

    def terms_of(batches):
        for batch in batches:
            texts = [sorted({w for w in _terms(t)}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.list_(pa.string())), batch.column(1)], names=["terms", "toxic"])

    parts = stage(chosen.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), part.alias("part")), "toxicity-texts")
    vocabulary = (
        parts.where("part < 2").select("text", "toxic").mapInArrow(terms_of, "terms array<string>, toxic int")
        .select(F.explode("terms").alias("w"), "toxic")
    )
    kinds = [F.struct(F.lit(0).alias("k"), F.col("w").alias("t"))] + [F.struct(F.lit(k).alias("k"), F.substring("w", 1, k).alias("t")) for k in STEMS]
    sizes = parts.where("part < 2").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")).first()
    n1, n0 = sizes["n1"] or 0, sizes["n0"] or 0
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    if n1 and n0:
        counted = (
            vocabulary.select(F.explode(F.array(*kinds)).alias("x"), "toxic", "w").where((F.col("x.k") == 0) | (F.length("w") >= F.col("x.k")))
            .groupBy("x.k", "x.t").agg(F.sum("toxic").alias("c1"), F.sum(1 - F.col("toxic")).alias("c0"))
        )
        ratio = (F.col("c1") + 0.5) / (n1 + 1) / ((F.col("c0") + 0.5) / (n0 + 1))
        # At most (terms of the sample's texts) / 6 rows, the sample being bounded; far fewer pass the ratio.
        for r in counted.where((F.col("c1") >= 6) & (ratio >= 6.0)).select("k", "t", F.log(ratio).alias("s")).collect():
            (stems if r["k"] else words)[r["t"]] = round(r["s"], 4)

    def dense(batches):
        for batch in batches:
            rows = [features(t, words, stems) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1), batch.column(2), batch.column(3)], names=["x", "toxic", "part", "doc_id"])

    got = parts.where("part >= 2").select("text", "toxic", "part", "doc_id").mapInArrow(dense, f"x array<double>, toxic int, part long, doc_id {kind}").orderBy("doc_id", "x").collect()
    if not got or len({r["toxic"] for r in got}) < 2:
        return Model(words, stems, [], 0.0, (np.zeros(0), np.zeros(0)))
    x = np.array([r["x"] for r in got])
    y = np.array([r["toxic"] for r in got], float)
    fit = np.array([r["part"] < 4 for r in got])
    if fit.all() or not fit.any() or len(set(y[fit])) < 2 or len(set(y[~fit])) < 2:
        fit = np.ones(len(y), bool)
    trees, bias = boost(x[fit], y[fit])
    rest = ~fit if not fit.all() else fit
    return Model(words, stems, trees, bias, isotonic(margins(x[rest], trees, bias), y[rest]))


def score_rows(model: Model, rows: list[list[float]]) -> np.ndarray:
    x = np.array(rows).reshape(len(rows), len(FEATURES))
    if not model.trees:
        return np.where(x[:, FEATURES.index("any_hit")] > 0, 0.5 + np.minimum(x[:, 0], 10) / 20, 0.0)
    return np.clip(np.interp(margins(x, model.trees, model.bias), *model.knots), 0.0, 1.0)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1; higher: toxic likelier) for every row of documents (doc_id, text).

    Null text scores like an empty one: the features are all 0 and the score is the
    calibrated score of such a row.  Without trees (nothing to learn from) a text
    scores 0 without any lexicon word and 0.5 or more with one.  Whole texts count,
    however long.  Repeated rows are rows of their own.  No rows: no rows.  Extra columns
    are ignored, whatever their names.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [features(t or "", model.words, model.stems) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_rows(model, rows), pa.float64())], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
