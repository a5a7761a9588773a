"""Words of queries within texts, looked up where texts are read."""

import random

import pytest

from rankloom.operators.analytics import keyword_overlap
from rankloom.operators.bm25 import ranked


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("ab-é", k=rng.randint(1, 7)))
    docs = [(i, "\n".join(" ".join(word() + rng.choice(["", ".", "_x"]) for _ in range(rng.randint(0, 9))).upper() for _ in range(2)) if i % 11 else None) for i in range(120)]
    docs += [(120 + i, "aab ba") for i in range(40)]  # equal counts
    queries = [(i, " ".join(word() for _ in range(8))) for i in range(15)] + [(15, None), (16, "ab ab AB a é")]
    return docs, queries, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")


def plain(docs, queries):
    import re

    found = {}
    for q, asked in queries:
        terms = {x for x in re.findall("[a-z0-9-]{2,}", (asked or "").lower())}
        for d, text in docs:
            n = sum(t in (text or "").lower() for t in terms)
            if n:
                found[q, d] = n
    return found


def test_counts_equal_looking_everywhere_and_nothing_is_shuffled(case):
    docs, queries, d, q = case
    made = keyword_overlap(q, d)
    assert {(r.query_id, r.doc_id): r.score for r in made.collect()} == plain(docs, queries)
    assert "Exchange" not in made._jdf.queryExecution().toString()


@pytest.mark.parametrize("parts", [1, 5])
def test_tasks_keep_the_best_of_a_query(case, parts):
    docs, queries, d, q = case
    want = {}
    for (x, doc), n in sorted(plain(docs, queries).items(), key=lambda i: (-i[1], i[0][1])):
        want.setdefault(x, []).append((doc, n))
    kept = keyword_overlap(q, d.repartition(parts), 4)
    assert kept.count() <= 4 * parts * len(want)
    got = {}
    for r in sorted(ranked(kept, 4).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert got == {x: rows[:4] for x, rows in want.items()}


def test_nobody_asks(spark, case):
    assert keyword_overlap(spark.createDataFrame([(1, "a"), (2, None)], "query_id long, text string"), case[2], 3).count() == 0
