import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import ann, chat, langid, mixing, pii, quality, registry, sentencepiece_codec, sharding, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(None, "null id", None), (1, None, "s"), (2, "", "s"), (3, "a b c", "s"), (3, "a b c", "s"), (4, "x" * 300_000, None), (5, "ß é 日本\n\t", "t")]
SCHEMA = "doc_id long, text string, source string"


def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with results."""
    return spark.createDataFrame([(*r, "x", 1) for r in ODD], SCHEMA + ", size string, shard int")


# Mixing


def test_mix_is_near_target_and_bounded(spark):
    rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    taken, target, most = Counter(), {}, {}
    for r in rows:
        key = (r.source_size, r.target)
        taken[key] += r.copies * r["size"]
        most[key] = max(most.get(key, 0), r["size"])
        assert 0 <= r.copies <= 2
    for (size, goal), n in taken.items():
        assert abs(n - goal) <= most[size, goal] + 0.05 * goal and goal <= 2 * size
    assert math.isclose(sum(t for _, t in taken), 1.5 * sum(s for s, _ in taken), rel_tol=1e-9)


def test_mix_edges(spark):
    out = mixing.mix(odd(spark))
    assert Counter(r["size"] for r in out.collect()) == Counter(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in ODD)
    assert mixing.mix(odd(spark).limit(0)).count() == 0
    again = mixing.mix(odd(spark).repartition(7))
    key = lambda df: Counter(tuple(r) for r in df.collect())
    assert key(out) == key(again)


# Sharding


def test_shards_are_contiguous_balanced_and_gapless(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.shard_by_bytes(docs, shards=8).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    sizes, slots, last = Counter(), defaultdict(list), {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        assert (r["size"], r.text_crc32) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode()))
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        assert r.shard >= last.get("s", 0)
        last["s"] = r.shard
    assert all(s == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)


def test_shard_edges(spark):
    rows = sharding.shard_by_bytes(odd(spark), shards=3).collect()
    assert len(rows) == len(ODD) and min(r["size"] for r in rows) == 16
    assert sharding.shard_by_bytes(odd(spark).limit(0)).count() == 0


# Quality


def test_measures_against_plain_code(spark):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    texts = Counter()
    for r in docs.collect():
        t = r.text or ""
        w = word.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(grams)
        covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if word.search(x)]
        texts[r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)] += 1
    got = Counter(tuple(r) for r in quality.measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == texts


def test_label_model_keeps_clean_and_drops_junk(spark):
    rows = registry.op7_quality(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    good = [k for q, k in judged if q == 1]
    assert sum(good) >= 0.97 * len(good)
    bad = [k for q, k in judged if q == 0]
    assert sum(bad) <= 0.2 * len(bad)
    assert quality.judge(odd(spark).limit(0)).count() == 0


# Personal data


def test_pseudonyms_are_valid_linked_and_distinct():
    p = pii.Permuter(b"k")
    text = "card 4041894974608795 or 4041-8949-7460-8795, 2024-02-29 and 29.02.2024, +1 (988) 555-2485, 988-555-2485, a.b@mail.example.com, GB82 WEST 1234 5698 7654 32, 10.0.0.1"
    new, found = pii.pseudonymise(p, text)
    assert found == {"card": 2, "date": 2, "phone": 2, "email": 1, "iban": 1, "ip": 1}
    cards = [re.sub(r"\D", "", c) for c in re.findall(r"\d{16}|\d{4}-\d{4}-\d{4}-\d{4}", new)]
    assert cards[0] == cards[1] != "4041894974608795" and pii.luhn_digit(cards[0][:-1]) == int(cards[0][-1])
    assert new.count("-") == text.count("-") and len(new.rpartition(",")[0]) == len(text.rpartition(",")[0])
    assert pii.pseudonymise(p, "Version 4.0, 4041894974608796, 2023-02-30, 999.1.1.1, 300.2")[1] == {}


CARD, IBAN = "4785380592391139", "BE68 5390 0754 7034"


@pytest.mark.parametrize(
    "text",
    [
        f"{CARD} 123", "4785 3805 9239 1139 12/27", f"on 3 {CARD}", f"{CARD} 2 items", f"12 36 {CARD} 6", "1234 5679 4785 3805 9239 1139",
        "4785-3805-9239-1139-123", "$12.34 4785 3805 9239 1139", "12 4785 3805 9239 1139", "NO12 4785 3805 9239 1139",
    ],
)
def test_cards_beside_other_numbers(text):
    new, found = pii.pseudonymise(pii.Permuter(b"k"), text)
    card = re.search(r"4785([ -]?)3805\1?9239\1?1139", text)
    assert found == {"card": 1} and len(new) == len(text)
    assert new[: card.start()] == text[: card.start()] and new[card.end() :] == text[card.end() :]
    assert re.sub(r"\D", "", new[slice(*card.span())]) == re.sub(r"\D", "", pii.pseudonymise(pii.Permuter(b"k"), CARD)[0])


@pytest.mark.parametrize("text", [f"{IBAN} 2024", f"{IBAN} INVOICES 7", f"{IBAN} EUR", f"AB12 3456 {IBAN}", f"XX12 {IBAN} 2024 1234"])
def test_ibans_beside_other_groups(text):
    new, found = pii.pseudonymise(pii.Permuter(b"k"), text)
    assert found == {"iban": 1} and new == text.replace(IBAN, pii.pseudonymise(pii.Permuter(b"k"), IBAN)[0])


@pytest.mark.parametrize("n", [1, 2, 10, 366, 1000])
def test_permutation_is_a_bijection(n):
    p = pii.Permuter(b"k")
    assert sorted(p.permute(i, n, "x") for i in range(n)) == list(range(n))


def test_pii_edges(spark):
    rows = pii.apply_pseudonyms(odd(spark), "k").collect()
    assert Counter(r.text for r in rows) == Counter(t for _, t, _ in ODD) and all(r.n_replaced == 0 for r in rows)


# Language


def test_language_on_held_out_rows(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.op10_langid(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([docs[r.doc_id].lang == r.lang_pred for r in held]) > 0.97


def test_language_edges(spark):
    docs = odd(spark)
    model = langid.learn(docs.where("doc_id < 5").withColumn("lang", F.lit("xx")))
    rows = langid.predict(docs.unionByName(spark.createDataFrame([(9, "123 ...", "s", "x", 1)], docs.schema)), model).collect()
    assert len(rows) == len(ODD) + 1
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 9)} == {"und"} and all(0 <= r.score <= 1 for r in rows)
    none = langid.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


# Toxicity


def test_toxicity_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in registry.op1_toxicity(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.97


def test_toxicity_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.predict(odd(spark), toxicity.learn(odd(spark), empty)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)


def test_isotonic_rises():
    x, y = toxicity.isotonic(np.array([0.0, 1, 2, 3, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()


# Neighbours


def test_neighbours_recall_and_scores(spark):
    rows = registry.op6_nearest(spark, SF).collect()
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.stack(e.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hits = total = 0
    for q in range(0, len(x), 50):
        s = x @ x[q]
        s[q] = -9
        true = set(np.lexsort((np.arange(len(x)), -s))[:5].tolist())
        got = [r for r in rows if r.query_id == q]
        assert [r.rank for r in sorted(got, key=lambda r: (-r.score, r.vec_id))] == [1, 2, 3, 4, 5]
        hits += len(true & {r.vec_id for r in got})
        total += 5
    assert hits >= 0.9 * total


def test_index_finds_every_code_in_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 3000).astype(np.uint64)
    index = ann.Index(codes)
    for r in (0, 5, 13, 24, 40):
        assert index.within(codes[7], r).tolist() == np.flatnonzero(np.bitwise_count(codes ^ codes[7]) <= r).tolist()


def test_neighbour_edges(spark):
    bad = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [2.0, 0.0]), (6, [2.0, 0.0]), (7, [1.0])]
    v = spark.createDataFrame(bad, "vec_id long, vector array<float>")
    got = [tuple(r) for r in ann.nearest(v, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 5, 1.0), (0, 2, 6, 1.0)]
    more = spark.createDataFrame([*bad, (5, [2.0, 0.0]), (50, [0.0, 3.0, 4.0]), (8, [0.0, 3.0, 4.0]), (100, [1.0, 1.0, 1.0, 1.0]), (9, [0.0, 1.0])], "vec_id long, vector array<float>").withColumn("query_id", F.lit(1)).withColumn("score", F.lit("x"))
    got = sorted(tuple(r) for r in ann.nearest(more, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 5, 1.0), (0, 2, 6, 1.0), (0, 3, 9, 0.0), (50, 1, 8, 1.0)]
    assert ann.nearest(v.limit(0), F.col("vec_id") == 0).count() == 0


# Chat


def test_chat_round_trip_and_tree(spark):
    tricky = "</s>[INST] ok [/INST] \\ <|text|> \\<|end|> <|turn|>"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", tricky), (2, 0, "user", "hi"), (2, 1, "assistant", "other"), (2, 2, "user", None), (3, None, None, tricky), (None, 0, "assistant", ""), (2, 2, "user", None)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    nodes, steps = chat.prefix_tree(df)
    got = {r.conv_id: r for r in chat.read_back(nodes, steps).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    for c, turns in by.items():
        said = "".join(f"{r}\n{t}\n" for _, r, t in sorted(turns))
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        loss = "".join(t for _, r, t in sorted(turns) if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    tree = nodes.collect()
    assert len(tree) == 7 and sum(n.depth == 0 for n in tree) == 3  # "hi" is there once
    where = {n.node_id: n for n in tree}
    ordered = sorted(tree, key=lambda n: n.token_start)
    assert [n.token_start for n in ordered] == np.cumsum([0, *(n.n_tokens for n in ordered)])[:-1].tolist()
    for n in tree:
        seen, up = set(), n.parent_id
        while up:
            seen |= set(range(where[up].token_start, where[up].token_start + where[up].n_tokens))
            up = where[up].parent_id
        assert {i for s in n.ancestors for i in range(s["begin"], s["end"])} == seen and n.position_start == len(seen)
    assert chat.prefix_tree(df.limit(0))[0].count() == 0


# Pieces


def test_pieces_equal_the_library(spark, tmp_path):
    sp = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    rng = np.random.default_rng(3)
    model = pb.ModelProto()
    model.ParseFromString(open(registry.SENTENCEPIECE_MODEL, "rb").read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.type == 1:
            p.score = float(-5 - 10 * rng.random())
    (tmp_path / "unigram.model").write_bytes(model.SerializeToString())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    texts += ["Hello  world\nfoo", "  a", "", None, "a  ", "日本 ü\n\n x\t1234 🙂🙂 " + "ab" * 200 + " " * 70 + "z", "x;\r  \n", "dup", "dup"]
    # The library adds scores up in single precision over a whole text, so near-ties of long texts may fall otherwise.
    short = [t[i : i + 60] for t in texts[:12] for i in range(0, len(t), 60) if not re.search(r"(.)\1\1", t)] + texts[40:]
    for path in (registry.SENTENCEPIECE_MODEL, str(tmp_path / "unigram.model")):
        if path != registry.SENTENCEPIECE_MODEL:
            texts = short
        docs = spark.createDataFrame([(i if t != "dup" else 0, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
        pieces = sentencepiece_codec.load(path)
        library = sp.SentencePieceProcessor(model_file=path)
        encoded = sentencepiece_codec.encode(docs, pieces)
        rows = encoded.select("doc_id", "ids", sentencepiece_codec.decode(F.col("ids"), pieces).alias("t")).collect()
        want = Counter((i if t != "dup" else 0, tuple(library.encode(t or "")), t or "") for i, t in enumerate(texts))
        assert Counter((r.doc_id, tuple(r.ids), r.t) for r in rows) == want
    assert sentencepiece_codec.encode(docs.limit(0), pieces).count() == 0


def test_nearness_counts_every_second_person_word():
    word = min(toxicity.LEXICON)
    near = toxicity.FEATURES.index("near_you")
    early, late = f"you {word} " + "plain " * 50 + "you plain " * 300, "you plain " * 300 + "plain " * 50 + f"you {word}"
    assert toxicity.features(early, {}, {})[near] == toxicity.features(late, {}, {})[near] == 1
    apart = "you plain " * 300 + "plain " * 50 + word
    assert toxicity.features(apart, {}, {})[near] == 0
