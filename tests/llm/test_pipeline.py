import math
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from rankloom.llm import jaccard, langid, mixing, pii, registry

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, "12345 --", "en", "src1", 8), (9002, None, None, None, None), (9003, "Call +1 (988) 555-2485 and that is all there is of it here today", None, None, 5)], docs.schema)
    docs = docs.unionByName(extra)
    columns, sizes = docs.columns, []
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, SF)
        if i < 4:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        sizes.append(docs.count())
        if name == "language_id":
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert not ids & {9001, 9002} and 9003 in ids
        if name == "near_duplicates":
            links = jaccard.join_components(docs, k=5, num=80, den=100).collect()
            assert all(r.component_id == r.doc_id for r in links)
        if name == "pseudonyms":
            assert "555-2485" not in docs.where("doc_id = 9003").first()["text"]
    assert docs.columns == ["doc_id", "n_tokens", "ids"]
    assert max(Counter(r.doc_id for r in docs.select("doc_id").collect()).values()) <= 2
    assert sizes[0] > sizes[1] == sizes[2]


def test_mix_takes_rows_without_an_id_of_their_own(spark):
    rows = [(None, f"null {i} " + "word " * 8, "en", "s", None) for i in range(6)] + [(7, f"again {i} " + "word " * 8, "en", "s", None) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    copies = mixing.mix(docs).collect()
    out = [tuple(r) for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()]
    taken = Counter()
    for r in copies:
        taken[r.doc_id] += r.copies
    assert taken[None] > 0 and Counter(r[0] for r in out) == taken
    assert set(out) <= set(rows) and max(Counter(out).values()) <= 2


def test_near_duplicates_leave_one_row_whatever_the_ids(spark):
    text = "one two three four five six seven eight nine ten"
    other = "quite another text of more than five words"
    rows = [(None, text), (5, text), (3, text), (3, text), (None, text), (None, other), (None, other), (3, "id three has a second text here"), (8, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(3, text), (None, other), (3, rows[7][1]), (8, None), (9, None)])


# Every stage against a plain version, on rows with nulls, repeats, ties and clashing columns


def plain_sets(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def plain_groups(texts):
    """Number of the group of each text, by comparing all with all."""
    sets, group = [plain_sets(t) for t in texts], list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return [root(i) for i in range(len(texts))]


def test_stages_equal_plain_versions(spark, tmp_path):
    sp = pytest.importorskip("sentencepiece")
    from test_plain import grams

    base = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    long = next(r[1] for r in base if r[1] and len(r[1].split()) > 60)
    odd = [(None, long, None, None, None), (None, long + " and a little more", "en", "src1", 3), (base[0][0], base[0][1], base[0][2], base[0][3], base[0][4]), (base[3][0], "the same id with other words in it, call +1 (988) 555-2485 today", None, "src2", 0)]
    odd += [(9001, "12345 --", "en", "src1", 8), (9002, None, None, None, None), (9003, "", "fr", "src0", 0), (9004, "ok", None, "src0", 2), (9005, "word " * 5000, "en", None, None), (9006, "Born 2024-02-29, card 4111 1111 1111 1111.", None, None, 1)]
    rows = base + odd * 2
    docs = spark.createDataFrame([(*r, i, i * 2) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row long, copies long")
    stages = dict(corpus_pipeline.STAGES)

    def through(name, frame):
        out = stages[name](spark, frame, SF)
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    # Language: plain naive Bayes fills in what is missing, texts without letters go.
    first = through("language_id", docs)
    taught = {r[:3] for r in rows if r[1] is not None and r[2] is not None}
    langs = sorted({r[2] for r in taught})
    counts, number = {x: Counter() for x in langs}, Counter(r[2] for r in taught)
    for _, text, lang in taught:
        counts[lang].update(grams(text)[0])
    size = {x: sum(c.values()) + 0.5 * langid.BUCKETS for x, c in counts.items()}

    def language(text):
        found = grams(text)[0]
        logit = {x: sum(math.log((counts[x][b] + 0.5) / size[x]) for b in found) / max(1.0, len(found) / langid.TEMPER) + math.log(number[x] / sum(number.values())) for x in langs}
        return max(langs, key=lambda x: (logit[x], x))

    want = {i: (*r[:2], r[2] or language(r[1]), *r[3:], i, i * 2) for i, r in enumerate(rows) if r[1] and any(c.isalpha() for c in r[1])}
    assert {r.row: tuple(r) for r in first.collect()} == want and first.columns == docs.columns

    # Near duplicates: one row of each group stays, that of the least id.
    kept = [want[i] for i in sorted(want)]
    second = through("near_duplicates", first)
    groups = {}
    for row, g in zip(kept, plain_groups([r[1] for r in kept])):
        groups.setdefault(g, []).append(row)
    got = {r.row: tuple(r) for r in second.collect()}
    assert all(want[i] == r for i, r in got.items())
    for members in groups.values():
        least = min((r[0] is None, r[0] or 0) for r in members)
        stay = [r for r in members if r[5] in got]
        assert len(stay) == 1 and (stay[0][0] is None, stay[0][0] or 0) == least
    assert len(got) == len(groups) < len(kept)

    # Pseudonyms: text by text.
    third = through("pseudonyms", second)
    permuter = pii.Permuter(registry.pii_key(spark).encode())
    hidden = {i: (r[0], pii.pseudonymise(permuter, r[1])[0], *r[2:4], len(pii.pseudonymise(permuter, r[1])[0]), *r[5:]) for i, r in got.items()}
    assert {r.row: tuple(r) for r in third.collect()} == hidden and any(hidden[i][1] != got[i][1] for i in got)

    # The mix: as often as the operator's SQL says of these rows.
    fourth = through("mix", third)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r[:4] for r in hidden.values()], columns=columns[:4]).astype({"doc_id": "Int64"}))
    taken = Counter()
    for doc_id, n, _, _, words in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({registry.ORACLES['op3_mix']})").fetchall():
        taken[doc_id, n] += words
    mixed = fourth.collect()
    assert all(tuple(r) == hidden[r.row] for r in mixed) and max(Counter(r.row for r in mixed).values()) <= 2
    words = Counter()
    for r in mixed:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        words[r.doc_id, n] += n
    assert words == Counter({k: v for k, v in taken.items() if v})

    # Ids: those of the library.
    library = sp.SentencePieceProcessor(model_file=registry.SENTENCEPIECE_MODEL)
    ids = stages["sentencepiece"](spark, fourth, SF).collect()
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in ids) == Counter((r.doc_id, len(e), tuple(e)) for r in mixed for e in [library.encode(r.text)])
