"""Exact set-similarity join of documents on word shingles, and its connected components.

A document is the set of its distinct word n-grams.  Two sets with Jaccard
similarity of at least num/den have sizes in the same or in adjacent size bands, and
differ in at most H tokens, H depending on the band.  For each band the token
universe is hashed into m = H + 1 + E segments: however the H differences fall, E + 1
segments stay equal.  Each set indexes its segments (as hashes) under its own band and
the next; sets that meet in an index entry are candidates and are verified exactly.

Which segments a set indexes is a matter of cost.  Of E + 1 equal segments one is
enough, so each set leaves out E: its empty ones, then those that most other sets
have too, such as the words of a widespread passage.  All sets rank segments in one
order, so two similar sets always keep one in common.  A set with more than E empty
segments adds the neighbourhood of its segments with one token deleted, which finds
one difference more per segment; if even that is not enough, its empty segments too.

Only links that change components are wanted, so members of an entry are compared
with one centre first, with centres of random small parts of the entry next, and pair
by pair only where their components still differ.  Before two sets are fetched, the
parities of their tokens in 1,024 hash cells are compared: each token that only one
set has flips one cell, so more differing cells than H rule a link out for certain.
Sets that are equal are one set throughout.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, stage, trim

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_32 = np.uint64(32)
#: Entries have 48 bits, which saves space; entries that agree by chance cost a comparison, nothing else.
ENTRY_BITS = np.uint64((1 << 48) - 2)
#: Segments that at least so many sets share are ranked by their number; rarer ones are never left out.
COMMON = 8
#: Rounds of comparing with centres before pairs are compared: one centre per entry first, then one per PART members.
CENTRES, PART = 3, 12
#: 64-bit words of the parity sketch.
WORDS = 16


def _mix(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> _32)) * by
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> _32)


class _Hashes(dict):
    """Hash of each word, remembered up to a bound (a worker's memory, not the result, depends on it)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes | None, k: int, hashes: dict) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the k-word shingles of a text.

    A-Z is lower-cased, words are split at ASCII white space.  A text of fewer than k
    words has its whole sequence as its one shingle; one without words has none.
    """
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(k, n)
    acc = h[: n - width + 1] ^ np.uint64(width)
    for j in range(1, width):
        acc = _mix(acc, _B) + h[j : n - width + 1 + j]
    return np.unique(_mix(acc, _C))


@dataclass(frozen=True)
class Plan:
    """Size bands and segment numbers for similarity num/den."""

    num: int
    den: int

    def __hash__(self):
        return hash((self.num, self.den))

    @lru_cache(None)
    def starts(self) -> tuple[int, ...]:
        out = [1]
        while out[-1] < 1 << 40:
            out.append(out[-1] * self.den // self.num + 1)
        return tuple(out)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.starts(), size, side="right")) - 1

    @lru_cache(None)
    def segments(self, band: int) -> tuple[int, int]:
        """m and E for pairs whose larger set is in the band."""
        largest = self.starts()[band + 1] - 1
        h = (self.den - self.num) * 2 * largest // (self.den + self.num)
        e = 2 + h // 10 if h else 0
        return h + 1 + e, e


def signatures(tokens: np.ndarray, plan: Plan) -> tuple[np.ndarray, tuple[int, int]]:
    """Index entries of a set under its own band and the next, and how many it may leave out in even and odd bands.

    The lowest bit of an entry is the parity of its band.
    """
    if not tokens.size:
        return np.zeros(0, np.uint64), (0, 0)
    out, slack = [], [0, 0]
    first = plan.band(tokens.size)
    weight = _mix(tokens, _C)
    for band in (first, first + 1):
        m, spare = plan.segments(band)
        seg = ((tokens >> _32) * np.uint64(m)) >> _32  # ascending, as the tokens are
        cuts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        own = seg[cuts]
        sums = np.add.reduceat(weight, cuts)
        base = np.uint64(band) * _B
        key = lambda s, where, kind: (_mix(s + where * _A + base + np.uint64(kind), _C) & ENTRY_BITS) | np.uint64(band & 1)  # noqa: B023, E731
        out.append(key(sums, own, 1))
        empty = m - own.size
        if empty <= spare:
            slack[band & 1] = spare - empty
            continue
        # Sparse: with the deletions, d_i <= 1 is found in segments of two tokens and more.
        counts = np.diff(np.append(cuts, tokens.size))
        out.append(key(sums, own, 2))
        owner = np.repeat(np.arange(own.size), counts)
        lost = sums[owner] - weight
        out.append(key(lost, own[owner], 2)[counts[owner] > 1])
        if empty - spare > int((counts > 1).sum()):
            blank = np.setdiff1d(np.arange(m, dtype=np.uint64), own)
            out.append(key(np.zeros(blank.size, np.uint64), blank, 3))
    return np.unique(np.concatenate(out)), (slack[0], slack[1])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.append(0, np.cumsum([len(a) for a in arrays])).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


#: Texts of a batch are handled so many at a time, which bounds what a task holds.
SLICE = 256


def _per_text(k: int, make, names: list[str]):
    """An Arrow map over (doc_id, text as bytes): ``make`` turns the slice's sets into columns."""

    def run(batches):
        hashes = _Hashes()
        with np.errstate(over="ignore"):
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(at, SLICE)
                    sets = [shingles(t, k, hashes) for t in batch.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([batch.column(0), *make(sets)], names=["doc_id", *names])
                    del batch, sets
                del whole
        hashes.clear()
        trim()

    return run


def set_entries(docs: DataFrame, k: int, plan: Plan) -> DataFrame:
    """doc_id, n_shingles, two 64-bit sums that identify the set, its index entries and how many it may leave out."""

    def make(sets):
        sums = [np.array([_mix(s, by).sum() for s in sets], np.uint64).view(np.int64) for by in (_B, _C)]
        done = [signatures(s, plan) for s in sets]
        return [pa.array([len(s) for s in sets], pa.int64()), *(pa.array(s, pa.int64()) for s in sums), _lists([d[0] for d in done]), *(pa.array([d[1][i] for d in done], pa.int32()) for i in (0, 1))]

    names = ["n_shingles", "key1", "key2", "entries", "slack0", "slack1"]
    return docs.mapInArrow(_per_text(k, make, names), "doc_id long, n_shingles long, key1 long, key2 long, entries array<long>, slack0 int, slack1 int")


def _parities(tokens: np.ndarray) -> np.ndarray:
    odd = np.bincount((tokens & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def set_tokens(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, size, tokens and the parity sketch p0, p1, ..."""
    names = ["size", "tokens", *(f"p{i}" for i in range(WORDS))]

    def make(sets):
        sketch = np.array([_parities(s) for s in sets], np.int64).reshape(len(sets), WORDS)
        return [pa.array([len(s) for s in sets], pa.int64()), _lists(sets), *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(WORDS))]

    schema = "doc_id long, size long, tokens array<long>, " + ", ".join(f"p{i} long" for i in range(WORDS))
    return docs.mapInArrow(_per_text(k, make, names), schema)


def _may_link(a: str, b: str, num: int, den: int):
    """What the sizes and sketches of two sets allow; false only where they cannot link."""
    na, nb = F.col(f"{a}.size"), F.col(f"{b}.size")
    differing = sum((F.bit_count(F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}"))) for i in range(WORDS)), F.lit(0))
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (differing * (den + num) <= (den - num) * (na + nb))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, label): the least node that each linked node reaches.

    Alternating large-star and small-star steps.  The least neighbours are aggregates
    with a partial step, kept beside the links, so that the join with the links has a
    shuffle of its own on both sides and Spark can split the rows of a node with very
    many links.  Each round is written, which cuts the lineage.
    """
    work: list = []
    stars = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links", work)
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).persist(StorageLevel.DISK_ONLY)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct().persist(StorageLevel.DISK_ONLY)
        down = large.groupBy("a").agg(F.min("b").alias("m")).persist(StorageLevel.DISK_ONLY)
        small = large.join(down, "a").select(F.col("b").alias("x"), "m").where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        stars = stage(small, "stars", work)
        for kept in (least, large, down):
            kept.unpersist()
        last = work.pop()
        discard(work)
        work.append(last)
        state = stars.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == before:
            return stars.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label").unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = state


def join_components(documents: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, keep_entries: bool = True) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of documents (doc_id, text).

    Documents link when den * |intersection| >= num * |union|; component_id is the least
    doc_id reachable by links, itself included.  Texts without words (or null) have an
    empty set and link with nothing.  A row with a null doc_id counts its shingles,
    links with nothing and has a null component_id.  Rows that repeat a doc_id are one
    node: each row keeps its own n_shingles, and they share the links of all.  Equal
    sets, ties and repeated rows are linked by definition.  No rows: no rows.  Tokens are
    64-bit hashes of shingles; sets are identified by two 64-bit sums.

    ``keep_entries`` writes the index entries of all sets once, about the size of the
    documents; else they are made twice, which takes a third more time and less disk.
    """
    plan = Plan(num, den)
    work: list = []  # what only this function reads
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    made = set_entries(docs, k, plan)
    whole = stage(made, "jaccard-sets", work) if keep_entries else made
    same = ["key1", "key2", "n_shingles"]
    keys = stage(whole.select("doc_id", *same, "slack0", "slack1"), "jaccard-keys")
    named = keys.where("doc_id is not null and n_shingles > 0")
    firsts = stage(named.groupBy(*same).agg(F.min("doc_id").alias("first")), "jaccard-firsts")

    # Entries that several sets have: counted with a partial step, so one that very many have is no one task's work.
    chosen = whole.where("doc_id is not null").select("doc_id", "entries").join(firsts.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")
    each = chosen.select("doc_id", F.explode("entries").alias("entry"))
    counts = stage(each.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "jaccard-counts", work)
    met = stage(each.join(counts, "entry"), "jaccard-met", work)
    # Leave out each set's most widespread entries, as many as it can spare.
    parity = F.expr("entry & 1")
    spare = named.select("doc_id", "n_shingles", "slack0", "slack1").distinct()
    widest = Window.partitionBy("doc_id", "n_shingles", "slack0", "slack1", parity).orderBy(F.desc("n"), "entry")
    ranked = met.where(F.col("n") >= COMMON).join(spare, "doc_id").withColumn("rank", F.row_number().over(widest))
    kept = ranked.where(F.col("rank") > F.when(parity == 0, F.col("slack0")).otherwise(F.col("slack1")))
    members = stage(met.where(F.col("n") < COMMON).select("entry", "doc_id").unionByName(kept.select("entry", "doc_id")).distinct(), "jaccard-members", work)
    tokens = stage(set_tokens(docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), k), "jaccard-tokens", work)
    facts = tokens.drop("tokens")

    real: DataFrame | None = None
    tested: DataFrame | None = None
    labels: DataFrame | None = None
    for step in range(CENTRES + 1):
        rows = members
        if labels is not None:
            rows = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        else:
            rows = members.withColumn("label", F.col("doc_id"))
        spread = rows.groupBy("entry").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("entry", "n")
        mixed = stage(rows.join(spread, "entry"), f"jaccard-mixed{step}", work)
        if step < CENTRES:
            parts = F.greatest(F.lit(1), F.floor(F.col("n") / PART)) if step else F.lit(1)
            dealt = mixed.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(step)), parts))
            centre = dealt.groupBy("entry", "part").agg(F.min(F.struct(F.xxhash64("entry", "doc_id", F.lit(-step)), "doc_id", "label")).alias("c"))
            pairs = dealt.join(centre, ["entry", "part"]).where(F.col("label") != F.col("c.label")).select(F.least("doc_id", "c.doc_id").alias("a"), F.greatest("doc_id", "c.doc_id").alias("b"))
            pairs = _near(pairs.distinct(), facts, num, den)
        else:
            known = mixed.join(facts, "doc_id")
            x, y = known.alias("x"), known.alias("y")
            pairs = x.join(y, (F.col("x.entry") == F.col("y.entry")) & (F.col("x.label") != F.col("y.label")) & (F.col("x.doc_id") < F.col("y.doc_id")) & _may_link("x", "y", num, den))
            pairs = pairs.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage(pairs, f"jaccard-pairs{step}", work)
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else stage(tested.unionByName(pairs), "jaccard-tested", work)
        found = stage(_verified(pairs, tokens, num, den), f"jaccard-links{step}", work)
        if found.isEmpty():
            continue
        real = found if real is None else real.unionByName(found)
        labels = stage(components(real), "jaccard-labels")
    # An id with several sets links these.
    several = named.select("doc_id", *same).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    through = stage(named.join(several, "doc_id").join(firsts, same).select(F.col("doc_id").alias("a"), F.col("first").alias("b")).where("a <> b").distinct(), "jaccard-repeats", work)
    if not through.isEmpty():
        labels = stage(components(through if real is None else real.unionByName(through)), "jaccard-labels")
    # Equal sets have the label of the first of them, the least.
    of_set = firsts if labels is None else firsts.join(labels.withColumnRenamed("node", "first"), "first", "left").select(*same, F.coalesce("label", "first").alias("first"))
    discard(work)
    nodes = named.select("doc_id", *same).join(of_set, same).groupBy("doc_id").agg(F.min("first").alias("label"))
    return keys.join(nodes, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def _near(pairs: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that sizes and sketches do not rule out."""
    x, y = facts.alias("x"), facts.alias("y")
    both = pairs.join(x, F.col("a") == F.col("x.doc_id")).join(y, F.col("b") == F.col("y.doc_id"))
    return both.where(_may_link("x", "y", num, den)).select("a", "b")


def _verified(pairs: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sets are similar."""
    left, right = (tokens.select(F.col("doc_id").alias(c), F.col("tokens").alias("t" + c)) for c in "ab")
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b").where(den * both >= num * (F.size("ta") + F.size("tb") - both)).select("a", "b")


def one_of_each(documents: DataFrame, *, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``documents`` with one row of each group of linked texts: the one with the least doc_id, nulls last.

    Rows are told apart by a number of their own, fixed by staging, so copies without
    an id and rows that repeat an id are compared like any others.  Texts without
    words link with nothing and stay.
    """
    row = fresh("row", documents.columns)
    rows = stage(documents.withColumn(row, F.monotonically_increasing_id()), "jaccard-rows")
    joined = join_components(rows.select(F.col(row).alias("doc_id"), "text"), k=k, num=num, den=den, keep_entries=False)
    groups = joined.select(F.col("doc_id").alias(row), "component_id").join(rows.select(row, "doc_id"), row)
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first"))
    return rows.join(first.select(f"first.{row}"), row, "left_semi").select(*documents.columns)
