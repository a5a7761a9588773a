"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased, runs of non-letters become one gap, and every run of
1 to ``ORDERS`` characters is hashed into one of ``BUCKETS`` buckets.  The model
is a matrix of log-probabilities, one row per language, that goes to every task;
texts are scored in batches: all n-grams of a batch are hashed at once, their
log-probabilities gathered and summed by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, trim

BUCKETS = 1 << 15
ORDERS = 3
#: Values of lang that a model may have; more are an error, not a sample.
MOST_LANGUAGES = 4096
#: Characters scored at a time: bounds a task's memory whatever the texts' lengths.
CHUNK = 1 << 17
#: n-grams that count as one independent piece of evidence when a score is made.
TEMPER = 50.0
#: Texts of a batch are handled so many at a time, which bounds what a task holds besides the batch.
SLICE = 256
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """``log_p``: buckets x languages; ``prior``: log of each language's share of the sample."""

    langs: tuple[str, ...]
    log_p: np.ndarray
    prior: np.ndarray


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For the first 65,536 code points: the lower case (0 for a non-letter), and whether it is a letter."""
    low = np.zeros(65536, np.uint32)
    for c in range(65536):
        ch = chr(c)
        if ch.isalpha():
            one = ch.lower()
            low[c] = ord(one) if len(one) == 1 else c
    return low, low > 0


def _letters(codes: np.ndarray) -> np.ndarray:
    """Lower-cased letters of an array of code points; 0 for anything else."""
    low, _ = _tables()
    out = low[np.minimum(codes, 65535)]
    far = np.flatnonzero(codes > 65535)
    if far.size:
        out[far] = [ord(chr(c).lower()) if chr(c).isalpha() else 0 for c in codes[far].tolist()]
    return out


def _symbols(text: str, after_letter: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Letters of a text in lower case, each run of other characters as one 0, and where in the text each stands.

    A leading run counts only if a letter came before the text.
    """
    letters = _letters(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    is_letter = letters > 0
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of a run
    keep[:1] |= after_letter
    at = np.flatnonzero(keep)
    return letters[at].astype(np.uint64), at


def _hashed(symbols: np.ndarray, owner: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams within one owner's symbols, and their owners, without those among the ``known`` first symbols."""
    buckets, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    rolled = np.zeros(symbols.size, np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, min(ORDERS, symbols.size) + 1):
            size = symbols.size - n + 1
            rolled = rolled[:size] * np.uint64(1_000_003) + symbols[n - 1 :]
            mixed = (rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            good = owner[:size] == owner[n - 1 :]
            if n == 1:
                good = good & (symbols > 0)
            good[: max(0, known - n + 1)] = False
            buckets.append((mixed >> np.uint64(49)).astype(np.int64)[good])
            owners.append(owner[:size][good])
    return np.concatenate(buckets), np.concatenate(owners)


def _ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Over all texts: which texts, their numbers of letters, buckets of n-grams, and the place of each n-gram's text among these texts.

    Texts go together up to CHUNK characters.  A longer one goes in pieces that carry
    their last symbols over, so every n-gram counts once, as if it were one piece.
    """
    held: list[int] = []
    size = 0

    def together(index: list[int]):
        lengths = np.fromiter((len(texts[i]) + 1 for i in index), np.int64, len(index))
        symbols, at = _symbols("\0".join([texts[i] for i in index]) + "\0")
        owner = np.repeat(np.arange(len(index), dtype=np.int32), lengths)[at]
        return np.asarray(index), np.bincount(owner[symbols > 0], minlength=len(index)), *_hashed(symbols, owner)

    for i, text in enumerate(texts):
        if len(text) >= CHUNK:
            carried, after_letter = np.zeros(0, np.uint64), False
            for at in range(0, len(text) + 1, CHUNK):
                piece = text[at : at + CHUNK] + ("\0" if at + CHUNK > len(text) else "")
                symbols, where = _symbols(piece, after_letter)
                after_letter = bool(where.size) and where[-1] == len(piece) - 1 and symbols[-1] > 0
                both = np.append(carried, symbols)
                yield np.array([i]), np.array([int((symbols > 0).sum())]), *_hashed(both, np.zeros(both.size, np.int32), carried.size)
                carried = both[max(0, both.size - ORDERS + 1) :]
        else:
            held.append(i)
            size += len(text) + 1
            if size >= CHUNK:
                yield together(held)
                held, size = [], 0
    if held:
        yield together(held)


def learn(labelled: DataFrame, *, per_language: int = 2000, alpha: float = 0.5) -> Model:
    """Fit on (doc_id, text, lang).

    Counts come from about ``per_language`` rows of each language (all, if it has
    fewer), those with a small hash of id and text: a sample of bounded size that any
    rerun draws again.  Every language is learned, rare ones too; the model has a column of
    BUCKETS numbers (256 KB) for each, and texts are scored a column at a time; more than
    MOST_LANGUAGES raise a ValueError, for no corpus has so many.  Rows with
    null lang or null text teach nothing; rows without an id, and rows that share one, teach
    like any others.  Rows equal in id, language and text teach once, so no repeated row
    outgrows the sample.  No labelled rows: a model without languages.  Extra columns
    are ignored.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    # Drawn by hash against each language's count, so no task ever holds a language.
    totals = known.groupBy("lang").agg(F.count(F.lit(1)).alias("of")).limit(MOST_LANGUAGES + 1).collect()
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang: these are not languages")
    share = F.broadcast(labelled.sparkSession.createDataFrame(totals, "lang string, of long"))  # MOST_LANGUAGES rows at most
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(share, "lang").where(draw * F.col("of") < per_language).select("doc_id", "lang", "text").distinct()

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                langs, texts = (batch.column(k).slice(at, SLICE).to_pylist() for k in (1, 2))
                for lang in langs:
                    docs[lang] = docs.get(lang, 0) + 1
                names = np.array(langs, dtype=object)
                for index, _, buckets, owners in _ngrams(texts):
                    of = names[index][owners]
                    for lang in set(of.tolist()):
                        sums[lang] = sums.get(lang, 0) + np.bincount(buckets[of == lang], minlength=BUCKETS)
        for lang, n in docs.items():
            row = sums.get(lang, np.zeros(BUCKETS, np.int64))
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (at.size + 1), pa.string()), pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(row[at], n).astype(np.int64), pa.int64())],
                names=["lang", "bucket", "n"],
            )

    # At most BUCKETS + 1 rows per language come back.
    rows = sample.select("doc_id", "lang", "text").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = tuple(sorted({r["lang"] for r in rows}))
    counts = np.full((BUCKETS, len(langs)), alpha)
    docs = np.zeros(len(langs))
    place = {lang: i for i, lang in enumerate(langs)}
    for lang, bucket, n in rows:
        if bucket < 0:
            docs[place[lang]] = n
        else:
            counts[bucket, place[lang]] += n
    log_p = np.log(counts / counts.sum(axis=0)) if langs else counts
    return Model(langs, log_p, np.log(docs / docs.sum()) if langs else docs)


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text, see :func:`predict`."""
    n = len(texts)
    sums = np.zeros((n, len(model.langs)))
    grams = np.zeros(n)
    letters = np.zeros(n, np.int64)
    by_language = np.ascontiguousarray(model.log_p.T)
    for index, n_letters, buckets, owners in _ngrams([t or "" for t in texts]):
        letters[index] += n_letters
        grams[index] += np.bincount(owners, minlength=len(index))
        for k, log_p in enumerate(by_language):
            sums[index, k] += np.bincount(owners, weights=log_p[buckets], minlength=len(index))
    if not model.langs:
        return [UNKNOWN] * n, [0.0] * n
    logits = sums / np.maximum(1.0, grams / TEMPER)[:, None] + model.prior
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    ok = letters > 0
    return [model.langs[b] if o else UNKNOWN for b, o in zip(best, ok)], np.where(ok, p[np.arange(n), best], 0.0).tolist()


def identify(model: Model):
    """A function from a column of texts to a column of struct lang_pred, score; see :func:`predict`.

    Only the texts go to Python, and back come only the results.
    """

    def run(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for at in range(0, len(texts), SLICE):
            for out, new in zip((langs, scores), score_texts(model, texts.slice(at, SLICE).to_pylist())):
                out.extend(new)
        trim()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    # Annotated by name, for annotations of this module are strings.
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # So called, a filter on the result does not compute it a second time.
    return F.arrow_udf(run, "lang_pred string, score double").asNondeterministic()


def predict(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``documents`` (doc_id alone by default), lang_pred and score for every row.

    score is the posterior probability of the language predicted, tempered: a text
    counts as one with TEMPER n-grams per TEMPER n-grams seen at most, so long texts
    do not all score 1.  A null text, or one without any letter, is ``und`` with
    score 0, and so is every text if the model has no language.  Equal scores: the
    first language by code point.  Whole texts count, however long.  Repeated rows are
    rows of their own.  No rows: no rows.  Columns named lang_pred or score in ``keep``
    would clash and must be left out; other columns are ignored, whatever their names.
    """
    names = keep or ["doc_id"]
    found = fresh("found", names)
    return documents.select(*names, identify(model)("text").alias(found)).select(*names, f"{found}.lang_pred", f"{found}.score")
