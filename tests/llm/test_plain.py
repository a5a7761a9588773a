"""Operators that SQL cannot state, against plain versions written for the test, through the registered queries."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from rankloom.llm import langid, pii, quality, registry, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


# Language: naive Bayes over dictionaries, gram by gram


def grams(text):
    """Buckets of all n-grams, and the number of letters."""
    symbols, gap = [], True
    for ch in (text or "") + "\0":
        if ch.isalpha():
            low = ch.lower()
            symbols.append(ord(low) if len(low) == 1 else ord(ch))
            gap = False
        elif not gap:
            symbols.append(0)
            gap = True
    out, mask = [], (1 << 64) - 1
    for n in (1, 2, 3):
        for i in range(len(symbols) - n + 1):
            if n == 1 and not symbols[i]:
                continue
            h = 0
            for s in symbols[i : i + n]:
                h = (h * 1_000_003 + s) & mask
            out.append((((h + n) * 0x9E3779B97F4A7C15) & mask) >> 49)
    return out, sum(s > 0 for s in symbols)


def test_language_equals_plain_naive_bayes(spark, documents):
    crc = lambda i: zlib.crc32(str(i).encode())
    taught = [r for r in documents if crc(r.doc_id) % 4 != 2 and r.lang is not None and r.text is not None]
    langs = sorted({r.lang for r in taught})
    counts, docs = {x: Counter() for x in langs}, Counter(r.lang for r in taught)
    for r in taught:
        counts[r.lang].update(grams(r.text)[0])
    size = {x: sum(counts[x].values()) + 0.5 * langid.BUCKETS for x in langs}
    got = {r.doc_id: r for r in registry.QUERIES["op10_langid"](spark, SF).collect()}
    assert len(got) == len(documents)
    for r in documents:
        found, letters = grams(r.text)
        logit = {x: sum(math.log((counts[x][b] + 0.5) / size[x]) for b in found) / max(1.0, len(found) / langid.TEMPER) + math.log(docs[x] / sum(docs.values())) for x in langs}
        top = max(logit.values())
        share = {x: math.exp(v - top) for x, v in logit.items()}
        best = max(langs, key=lambda x: (logit[x], -langs.index(x)))
        mine = got[r.doc_id]
        assert mine.held_out == (crc(r.doc_id) % 4 == 2)
        if not letters:
            assert (mine.lang_pred, mine.score) == ("und", 0.0)
        else:
            assert mine.score == pytest.approx(share[best] / sum(share.values()), abs=1e-6)
            assert mine.lang_pred == best or abs(sorted(logit.values())[-1] - sorted(logit.values())[-2]) < 1e-9


def test_long_texts_count_every_gram_once(monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abÉ  .\nßIİ\U00010400"), n)) for n in (0, 1, 5, 99, 100, 101, 700)] + ["..", "a" * 300]
    for chunk in (7, 100, 10_000):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        found, letters = defaultdict(list), Counter()
        for index, n, buckets, owners in langid._ngrams(texts):
            for i, k in zip(index.tolist(), n.tolist()):
                letters[i] += k
            for b, o in zip(buckets.tolist(), index[owners].tolist()):
                found[o].append(b)
        for i, t in enumerate(texts):
            want, n = grams(t)
            assert (Counter(found[i]), letters[i]) == (Counter(want), n), (chunk, i)


# Quality: expectation-maximisation with arrays


def test_quality_equals_plain_em(spark, documents):
    rows = registry.QUERIES["op7_quality"](spark, SF).collect()
    votes = {r.doc_id: tuple(r[f"vote_{k}"] for k in quality.rules()) for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    names = list(quality.rules())
    v = np.array([votes[r.doc_id] for r in documents])
    kinds = list(quality.KINDS.values())
    k = 1 + len(kinds)
    tripped = np.array([[any(x == -1 and n in kind for n, x in zip(names, row)) for kind in kinds] for row in v])
    belief = np.where(tripped.any(axis=1)[:, None], np.column_stack([np.full(len(v), 0.1), 0.9 * tripped / np.maximum(1, tripped.sum(axis=1))[:, None]]), np.array([0.95] + [0.05 / len(kinds)] * len(kinds)))
    prior_share, prior_bad = np.array([0.8] + [0.2 / len(kinds)] * len(kinds)), np.array([[0.005] + [0.5 if n in kind else 0.05 for kind in kinds] for n in names])
    for _ in range(50):
        share = (belief.sum(axis=0) + 10 * prior_share) / (len(v) + 10)
        bad, good = (v == -1).T @ belief, (v == 1).T @ belief
        rate = (bad + 10 * prior_bad) / (bad + good + 10)
        rate[:, 0] = np.minimum(rate[:, 0], quality.MOST_WRONG)
        logs = np.log(share) + (v == -1) @ np.log(rate) + (v == 1) @ np.log(1 - rate)
        belief = np.exp(logs - logs.max(axis=1, keepdims=True))
        belief /= belief.sum(axis=1, keepdims=True)
    assert k == belief.shape[1]
    p = dict(zip((r.doc_id for r in documents), belief[:, 0]))
    assert all(r.quality == pytest.approx(p[r.doc_id], abs=1e-9) for r in rows)
    assert all(r.kept == (not r.base_failed and p[r.doc_id] >= 0.5) for r in rows)


# Toxicity: features, boosting and calibration one value at a time


def plain_boost(x, y, trees, depth, rate, l2, least):
    """Best splits by trying every threshold of a feature on every node."""
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    margin = np.full(len(y), math.log(p0 / (1 - p0)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = [""] * len(y)
        for _ in range(depth):
            splits = {}
            for name in set(node):
                rows = np.array([n == name for n in node])
                best = (0.0, 0, math.inf)
                for j in range(x.shape[1]):
                    for t in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])):
                        left, right = rows & (x[:, j] <= t), rows & (x[:, j] > t)
                        if left.sum() < least or right.sum() < least:
                            continue
                        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
                        gain = score(left) + score(right) - score(rows)
                        if gain > best[0] + 1e-9:
                            best = (gain, j, t)
                splits[name] = best[1:]
            node = [n + ("1" if x[i, splits[n][0]] > splits[n][1] else "0") for i, n in enumerate(node)]
        for name in set(node):
            rows = np.array([n == name for n in node])
            margin[rows] += -rate * g[rows].sum() / (h[rows].sum() + l2)
    return margin


def test_boosting_equals_trying_every_split():
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.random(160), rng.integers(0, 5, 160), rng.random(160)])
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 2)).astype(float)
    trees, bias = toxicity.boost(x, y, trees=4)
    assert np.allclose(toxicity.margins(x, trees, bias), plain_boost(x, y, 4, 3, 0.15, 2.0, 10))


def test_isotonic_equals_the_minimax_formula():
    rng = np.random.default_rng(3)
    m = np.sort(rng.random(40))
    y = (rng.random(40) < m).astype(float)
    xs, ys = toxicity.isotonic(m, y)
    fit = [max(min(y[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    cuts = [0, *(i for i in range(1, 40) if fit[i] > fit[i - 1] + 1e-12), 40]
    blocks = [(m[a:b].mean(), (y[a:b].sum() + 0.5) / (b - a + 1)) for a, b in zip(cuts, cuts[1:])]
    assert np.allclose(xs, [b[0] for b in blocks]) and np.allclose(ys, np.maximum.accumulate([b[1] for b in blocks]))


def test_toxic_scores_follow_from_each_whole_text(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    taught = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    model = toxicity.learn(docs, labels.where(labels.doc_id.isin([r.doc_id for r in taught])).select("doc_id", "toxic"))
    got = {r.doc_id: r for r in registry.QUERIES["op1_toxicity"](spark, SF).collect()}
    assert len(got) == len(documents)
    for r in documents:
        x = toxicity.features(r.text or "", model.words, model.stems)
        margin = model.bias
        for feature, threshold, leaf in model.trees:
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + int(x[feature[at]] > threshold[at])
            margin += leaf[at - len(feature)]
        if model.trees:
            assert got[r.doc_id].score == pytest.approx(float(np.clip(np.interp(margin, *model.knots), 0, 1)), abs=1e-9)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5) and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


# Personal data: the permutation by integers, and whole texts by one document at a time


def plain_feistel(key, value, n, domain):
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    secret = hashlib.blake2b(key).digest()
    while True:
        left, right = divmod(value, 1 << half)
        for i in range(8):
            size = (half + 7) // 8
            mixed = hashlib.blake2b(f"{domain}/{n}/{i}/{half}/{right}".encode(), key=secret, digest_size=size).digest()
            left, right = right, left ^ int.from_bytes(mixed, "big") % (1 << half)
        value = left * (1 << half) + right
        if value < n:
            return value


@pytest.mark.parametrize("n", [2, 3, 17, 255, 256, 73_049, 10**14])
def test_permutation_equals_plain_feistel(n):
    p = pii.Permuter(b"secret")
    for v in range(0, n, max(1, n // 50)):
        assert p.permute(v, n, "card4") == plain_feistel(b"secret", v, n, "card4")


def test_pseudonyms_change_only_what_they_count(spark, documents):
    texts = {r.doc_id: r.text for r in documents}
    rows = registry.QUERIES["op4_pseudonyms"](spark, SF).collect()
    assert len(rows) == len(texts)
    changed, dates = 0, defaultdict(set)
    for r in rows:
        old, new = texts[r.doc_id], r.text
        assert r.n_replaced == sum(r.kinds.values()) and (new == old if r.n_replaced == 0 else True)
        changed += new != old
        shape = lambda t: re.sub(r"[A-Za-z0-9]+", "x", t)
        if set(r.kinds) <= {"card", "date", "phone", "iban", "ssn"}:
            assert len(old) == len(new) or "date" in r.kinds
            assert shape(old) == shape(new)
        for a, b in zip(re.findall(r"\b\d{4}-\d{2}-\d{2}\b", old or ""), re.findall(r"\b\d{4}-\d{2}-\d{2}\b", new or "")):
            dates[a].add(b)
    assert changed and all(len(v) == 1 for v in dates.values())


# Columns that clash with what stages make


def test_stages_survive_clashing_columns(spark):
    rows = [(1, "This is the first text of all of them, with 2024-02-29 in it", "en", "s", 5), (2, None, None, None, None), (1, "", "fr", "s", 0), (None, "another text here of more words than five", "en", None, 1)] * 3
    names = ["score", "lang_pred", "found", "new", "n_replaced", "kinds", "__row", "row", "n", "copies", "size", "class", "lines", "rank"]
    docs = spark.createDataFrame([(*r, *(1000 * i + k for k in range(len(names)))) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = [tuple(r[n] for n in names) for r in out.collect()]
        assert kept and all(r == tuple(r[0] + k for k in range(len(names))) and r[0] % 1000 == 0 and r[0] < 1000 * len(rows) for r in kept), name
    assert corpus_pipeline.pseudonymise(spark, docs, SF).where("doc_id = 1 and n_chars > 0").count() == 3
    assert corpus_pipeline.encode(spark, docs, SF).count() == len(rows)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), SF).count() == 0, name


def test_no_control_characters_are_lost():
    assert unicodedata.category("\0") == "Cc" and pii.pseudonymise(pii.Permuter(b"k"), "\0 +1 (988) 555-2485 \0")[0].count("\0") == 2


def test_kept_columns_may_be_named_like_working_ones(spark):
    docs = spark.createDataFrame([(7, "some words here, twice some words here", "en", 8, 9)], "doc_id long, text string, lang string, found int, words int")
    model = langid.learn(docs)
    assert tuple(langid.predict(docs, model, ["doc_id", "found"]).first())[:3] == (7, 8, "en")
    assert tuple(pii.apply_pseudonyms(docs.withColumnRenamed("found", "new"), "k", ["new"]).first())[0] == 8
    assert tuple(quality.judge(docs, ["words", "found"]).first())[:3] == (9, 8, 7)


def test_rows_without_ids_and_rare_languages_teach(spark):
    rows = [(None, "ein kleiner Text der Sprache", "de"), (None, "un petit texte de la langue", "fr"), (4, "the same text", "en")] + [(4, "the same text", "en")] * 500
    rows += [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} speech", f"x{i:03}") for i in range(300)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.langs) == {r[2] for r in rows}
    assert [math.isclose(p, model.prior[0]) for p in model.prior] == [True] * 303  # a repeated row teaches once
    assert langid.score_texts(model, ["kleiner Text"])[0] == ["de"]
