import random
import re
from itertools import combinations

import numpy as np
import pytest

from rankloom.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, num, den):
    low = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for size in (3, 4, 7, 9, 15, 40, 120, 300):
        base = rng.choices(vocabulary, k=size)
        for edits in (0, 0, 1, 1, 1, 2, 3, 5, 8):
            words = list(base)
            for _ in range(edits):
                if not words:
                    break
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[at].upper()]])
            rows.append((n, " ".join(words)))
            n += 1
    passage = " ".join(rng.choices(vocabulary, k=30))
    rows += [(n + i, passage + " " + " ".join(rng.choices(vocabulary, k=30))) for i in range(25)]
    return rows + [(9000, ""), (9001, None), (9002, " \t\n"), (9003, ""), (9004, "one"), (9005, "ONE")]


@pytest.mark.parametrize("seed,k,num", [(1, 4, 85), (2, 5, 80), (3, 3, 60)])
def test_against_all_pairs(spark, seed, k, num):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(df, k=k, num=num, den=100).collect()}
    assert got == brute(rows, k, num, 100)


def test_nulls_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.join_components(df, k=4, num=85, den=100).collect())
    assert got == [(-1, 2, -1), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert jaccard.join_components(df.limit(0)).count() == 0
    assert [r.doc_id for r in jaccard.one_of_each(df, k=4, num=85).collect()] == [1]
    assert jaccard.one_of_each(df.limit(0)).count() == 0


def test_an_id_with_several_texts_links_them(spark):
    rows = [(4, "a b c d e"), (9, "a b c d e"), (9, "p q r s t u"), (7, "p q r s t u"), (8, ""), (8, "v w x y z"), (6, "v w x y z")]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, n_shingles string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_components(df, k=4, num=85, den=100).collect())
    assert got == [(4, 2, 4), (6, 2, 6), (7, 3, 4), (8, 0, 6), (8, 2, 6), (9, 2, 4), (9, 3, 4)]


def test_a_very_long_text_and_its_near_copy(spark):
    words = [f"w{i}" for i in range(40_000)]
    near = words[:20_000] + ["x"] + words[20_000:]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:20_000]))], "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(df, k=4, num=85, den=100).collect()} == {1: (39_997, 1), 2: (39_998, 1), 3: (19_997, 3)}


def test_entries_of_similar_sets_meet_and_sketch_is_a_bound():
    rng = np.random.default_rng(5)
    plan = jaccard.Plan(85, 100)
    for size in [7, 8, 12, 20, 33, 60, 100, 250] * 30:
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(a.size) > 0.07], rng.integers(0, 2**63, max(1, size // 20)).astype(np.uint64)]))
        with np.errstate(over="ignore"):
            both, either = np.intersect1d(a, b).size, np.union1d(a, b).size
            flips = int(np.bitwise_count((jaccard._parities(a) ^ jaccard._parities(b)).view(np.uint64)).sum())
            assert flips <= either - both
            if 100 * both >= 85 * either:
                (ea, sa), (eb, sb) = jaccard.signatures(a, plan), jaccard.signatures(b, plan)
                shared = np.intersect1d(ea, eb)
                # Each may leave out its slack in the band they share; something must remain.
                assert max(int((shared & np.uint64(1) == p).sum()) - max(sa[p], sb[p]) for p in (0, 1)) >= 1
