"""Deduplication by merged runs, whitening and lexical search against plain versions, and their edge cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rankloom.llm import dedup, lexical, registry, sentencepiece_codec, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


# Exact deduplication


def plain_copies(rows, largest):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), digest) for i in ids]
    return Counter(out)


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("parts", [1, 9])
def test_copies_equal_plain_groups(spark, largest, parts):
    rows = [(i, f"text {i % 7}") for i in range(40)] + [(i, "hot") for i in range(100, 160)]
    rows += [(None, "hot"), (None, "lone"), (None, "lone"), (5, None), (6, ""), (300, "x" * 200_000), (301, "x" * 200_000), (7, "twice"), (7, "twice"), (8, " hot"), (9, "Hot")]
    got = dedup.mark_copies(spark.createDataFrame(rows, DOCS).repartition(parts), largest=largest, fan_in=2).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == plain_copies(rows, largest)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {r.text_sha256 for r in got}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_digests_that_differ_in_a_check_stay_apart(spark):
    entry = "node int, sha binary, bytes long, check long, best long, n long"
    rows = [(node, b"same", size, check, node, 1) for node in range(40) for size, check in ((1, 1), (1, 2), (2, 1))]
    got = dedup.merge_runs(spark.createDataFrame(rows, entry), 40, largest=True, fan_in=3).collect()
    assert sorted((r.bytes, r.check, r.best, r.n) for r in got) == [(1, 1, 39, 40), (1, 2, 39, 40), (2, 1, 39, 40)]


def test_drop_copies_keeps_rows_as_they_are(spark):
    rows = [(1, "a", 10, "p"), (2, "a", 20, "q"), (None, "b", 30, "r"), (None, "b", 30, "r"), (None, None, 40, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number long, sha string")
    got = dedup.drop_copies(docs, largest=True)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[2], rows[4]], key=str)
    assert dedup.drop_copies(docs.limit(0)).count() == 0


# Whitening


def test_symmetric_qr_equals_the_library():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64):
        a = rng.normal(size=(n, n))
        a = a @ a.T
        values, vectors = whitening.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-11, atol=1e-11)
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-10 * max(1, abs(values[0])))
    for special in (np.zeros((4, 4)), np.eye(5), np.ones((3, 3)), np.diag([3.0, 1.0, 2.0])):
        values, vectors = whitening.symmetric_qr(special)
        assert np.allclose(vectors @ np.diag(values) @ vectors.T, special, atol=1e-12)


def test_welford_states_merge_to_the_whole():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(301, 5)) * 100
    whole = whitening.Welford(5)
    for part in np.array_split(x, 7):
        one = whitening.Welford(5)
        one.add(part)
        whole.merge(one.n, one.total, one.mean, one.scatter)
    assert whole.n == 301 and np.allclose(whole.mean, x.mean(axis=0)) and np.allclose(whole.scatter / 301, np.cov(x.T, bias=True))


def plain_whitening(vectors, width):
    """vec_id -> (deviation, whitened) for vectors of one length."""
    whole = {v: [math.floor(64 * c) + 1_000_000 for c in x] for v, x in vectors}
    distinct = np.array(sorted({tuple(x) for x in whole.values()}), float)
    n, total = len(distinct), distinct.sum(axis=0)
    values, columns = np.linalg.eigh(np.cov((distinct - 1_000_000).T, bias=True))
    values, columns = values[::-1], columns[:, ::-1]
    out = {v: (sum(int((n * a - int(s)) ** 2) for a, s in zip(x, total)), (np.array(x) - total / n) @ columns[:, :width] / np.sqrt(values[:width])) for v, x in whole.items()}
    return n, out, values[:width] / values.sum()


def test_whitening_equals_plain(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, want, shares = plain_whitening([(r.vec_id, r.embedding) for r in table], 16)
    got = registry.QUERIES["op11_whitening"](spark, SF).collect()
    assert len(got) == 16 * len(table) and {r.n for r in got} == {n}
    signs = {}
    for r in got:
        deviation, white = want[r.vec_id]
        assert r.deviation == deviation
        signs.setdefault(r.component, np.sign(white[r.component - 1] * r.whitened))
        assert r.whitened * signs[r.component] == pytest.approx(white[r.component - 1], abs=1e-8)
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.5, -1.0]), (None, [3.0, 0.25]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (7, []), (8, [1.0]), (9, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, vector array<double>, x string, component int")
    got = whitening.whiten(frame.repartition(5)).collect()
    assert Counter(r.vec_id for r in got) == {1: 4, 2: 2, None: 2}
    assert {r.n for r in got} == {3} and got[0].identity_error < 1e-9
    n, want, _ = plain_whitening([(v, x) for v, x in rows if x and len(x) == 2 and all(c is not None and math.isfinite(c) for c in x)], 2)
    assert n == 3 and all(r.deviation == want[r.vec_id][0] for r in got)
    assert whitening.whiten(frame.limit(0)).count() == 0 == whitening.whiten(frame.where("vec_id in (3, 4, 7)")).count()
    one = whitening.whiten(frame.where("vec_id = 1")).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, 0.0, None)}
    far = whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id long, vector array<double>")).collect()
    assert [r.deviation for r in far] == [None, None, None] or all(r.deviation is None for r in far if r.vec_id != 3)


def test_many_partial_states(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(a) for a in rng.normal(size=6) * [8, 7, 6, 5, 4, 3]]) for i in range(400)]
    got = whitening.covariance(spark.createDataFrame(rows, "vec_id long, x array<double>").select(whitening.whole_numbers(_col("x")).alias("x")).repartition(30), "x", 6)
    x = np.array([[math.floor(64 * c) for c in v] for _, v in rows], float)
    assert got.n == 400 and np.allclose(got.scatter / 400, np.cov(x.T, bias=True)) and list(got.total) == [int(s) + 400 * 1_000_000 for s in x.sum(axis=0)]


def _col(name):
    from pyspark.sql import functions as F

    return F.col(name)


# Lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_search(items, documents, k=10):
    counted = [(d, Counter(TERM.findall((t or "").translate(LOW)))) for d, t in documents]
    N, L = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            n = sum(c.values())
            m = 100 - 90 + (90 * n * N) // L if L else 0
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(LOW))) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i, None if u else d, -s) for i, (s, u, d) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


ODD = [(3, "Red fox"), (1, "red FOX"), (None, "red fox"), (None, None), (2, ""), (2, "red"), (2, "red"), (9, "ÄPFEL äpfel naïve-fox_fox 4ever"), (10, "... ,,"), (11, "fox " * 50_000), (12, "red \x7f{}[]fox~")]


@pytest.mark.parametrize("size,parts,block", [(2, 3, 2), (4096, 1, 1 << 19), (1, 1, 1)])
def test_search_of_odd_texts(spark, size, parts, block):
    items = [(1, "red fox"), (1, "fox"), (2, None), (3, "nothing here"), (4, "ÄPFEL äpfel fox fox"), (None, "4EVER"), (5, "?")]
    docs = spark.createDataFrame(ODD, DOCS).withColumn("score", _col("doc_id")).repartition(parts)
    index = lexical.build_index(docs, shard_documents=size)
    got = lexical.search(spark.createDataFrame(items, "item_id long, text string"), docs, k=4, index=index, block=block).collect()
    assert Counter(map(tuple, got)) == plain_search(items, ODD, 4)


def test_search_equals_plain_in_many_shards(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(60)]
    p = 1 / np.arange(1, 61)
    text = lambda n: " ".join(rng.choice(vocabulary, size=n, p=p / p.sum()))
    docs = [(i, text(int(rng.integers(1, 40)))) for i in range(500)] + [(1000 + i, "w1 w2 w3 w40") for i in range(60)]
    items = [(i, text(12)) for i in range(25)] + [(99, "w1 w2 w3 w40")]
    frame = spark.createDataFrame(docs, DOCS).repartition(2)
    got = lexical.search(spark.createDataFrame(items, "item_id long, text string"), frame, index=lexical.build_index(frame, shard_documents=64))
    assert Counter(map(tuple, got.collect())) == plain_search(items, docs)


def test_search_takes_few_nodes_where_bounds_tell():
    """Documents without the rare terms are never reached once ten with them are known."""
    rng = np.random.default_rng(7)
    common, rare = np.sort(rng.choice(4096, 2000, replace=False)), np.sort(rng.choice(4096, 12, replace=False))
    members, tf = np.concatenate([common, rare]), np.ones(2012, np.int64)
    tree = lexical.Tree(np.array([0, 2000, 2012]), members, lexical.gains(tf, np.full(2012, 100)), 4096)
    best = lexical.Best.none(1, 10)
    taken = lexical.best_first(tree, np.arange(4096), np.zeros(4096, bool), np.array([0]), np.array([0, 2]), np.array([0, 1]), np.array([10, 9000]), best)
    assert set(best.doc[0]) <= set(rare.tolist()) and taken < 800


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame(ODD, DOCS), spark.createDataFrame([(1, "fox")], "item_id long, text string")
    assert lexical.search(items, docs.limit(0)).count() == 0 == lexical.search(items.limit(0), docs).count() == lexical.search(items, docs.where("doc_id = 10")).count()


# Viterbi on the lattice, through the registered query


def best_score(unit, pieces, memo):
    """The greatest total over all ways to cut a unit, by trying every first piece."""
    if not unit:
        return 0.0
    if unit not in memo:
        worst = min(pieces.scores.values()) - sentencepiece_codec.UNKNOWN_PENALTY
        memo[unit] = max(pieces.scores.get(unit[:n], worst if n == 1 else -math.inf) + best_score(unit[n:], pieces, memo) for n in range(1, min(len(unit), pieces.longest) + 1))
    return memo[unit]


def test_unigram_query_finds_the_best_cuts(spark):
    pieces = sentencepiece_codec.as_unigram(sentencepiece_codec.load(registry.SENTENCEPIECE_MODEL))
    named = {i: p for p, i in pieces.ids.items()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.QUERIES["unigram_encode"](spark, SF).collect()
    assert len(rows) == len(texts)
    memo, checked = {}, 0
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.decoded_md5 == hashlib.md5(text.encode()).hexdigest() and r.n_tokens == len(r.ids)
        if 0 < len(text) < 4000 and all(i in named for i in r.ids):
            whole = sentencepiece_codec.SPACE + text.replace(" ", sentencepiece_codec.SPACE)
            assert "".join(named[i] for i in r.ids) == whole
            # Blanks begin words here: no piece has one behind another character.
            words = re.findall(f"{sentencepiece_codec.SPACE}*[^{sentencepiece_codec.SPACE}]*", whole)
            assert sum(pieces.scores[named[i]] for i in r.ids) == pytest.approx(sum(best_score(w, pieces, memo) for w in words if w))
            checked += 1
    assert checked > 20


# Nearest neighbours over many cells and blocks


def test_nearest_over_many_cells_equals_brute_force_nearly(spark):
    from rankloom.llm import ann

    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", _col("embedding").alias("vector"))
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.vector for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i in range(len(ids)):
        if ids[i] % 10 == 0:
            best = [j for j in np.lexsort((ids, -(x @ x[i]))) if j != i][:5]
            want[ids[i]] = {int(ids[j]) for j in best}
    got = ann.nearest(table, _col("vec_id") % 10 == 0, cell=60, block=7).collect()
    found = defaultdict(set)
    for r in got:
        found[r.query_id].add(r.vec_id)
        assert r.score == pytest.approx(float(x[ids == r.query_id][0] @ x[ids == r.vec_id][0]), abs=1e-9)
    assert set(found) == set(want) and all(len(v) == 5 for v in found.values())
    recall = sum(len(found[q] & want[q]) for q in want) / (5 * len(want))
    assert len(want) == 50 and recall >= 0.9
    one = {(r.query_id, r.vec_id) for r in ann.nearest(table, _col("vec_id") % 10 == 0).collect()}
    assert len(one & {(q, v) for q, vs in found.items() for v in vs}) >= 0.9 * len(one)
