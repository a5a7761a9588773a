"""Ranked lexical search with dual-sorted wavelet trees, one per shard.

An index shard holds a few thousand neighbouring documents of one input partition: their
ids, lengths and postings.  For a search the postings of each term are ordered by impact
(what the term can add to a score), and the sequence of their documents is laid out
as a wavelet tree over the documents in the order of their ids.  The tree keeps the
order of impacts at every node, so at any node the first posting of a term's range has
the term's greatest impact among the documents below; the sum over the query's terms
bounds every score below the node, and at a leaf it is the score.  Nodes are taken best
bound first, a few at a time for every query, terms without postings below a node drop
out of it, and nodes whose bound cannot enter the best k are left; what is left is exact.

Texts are read once and never shuffled.  A task answers its shards one after another and
carries each query's best k and their least score from shard to shard.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, trim

#: A shard is closed as soon as it has so many documents, or so many terms with repeats.
SHARD_DOCUMENTS, SHARD_TERMS = 4096, 1 << 20
#: Shards of a file. Spark's reader decodes up to 4096 rows at once, so all shards of a file, however large its task's share of the texts.
FILE_SHARDS = 2
#: Bound of what is sent to the tasks at once: (query, term) pairs, a term counting once more for every 16 bytes; more are searched in blocks.
BLOCK = 1 << 19
#: Nodes taken at a time for each query, and postings that queries searched together may have.
BEAM, TOGETHER = 48, 1 << 18
INDEX = "documents array<long>, lengths array<long>, terms array<binary>, df array<int>, members array<int>, tf array<int>"
#: Every byte that is no part of a term becomes a blank, A-Z become a-z; bytes of other characters stay.
_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() and not 0x41 <= b <= 0x5A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split() if text else []


class _Gathered:
    """Documents on their way into a shard."""

    def __init__(self):
        self.ids, self.lengths, self.tokens, self.vocabulary = [], [], [], defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        found = terms_of(text)
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.tokens.append(np.fromiter(map(self.vocabulary.__getitem__, found), np.int64, len(found)))
        self.size += len(found)

    def batch(self) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        names = sorted(self.vocabulary)
        rank = np.empty(len(names), np.int64)
        rank[[self.vocabulary[t] for t in names]] = np.arange(len(names))
        tokens = np.concatenate([np.empty(0, np.int64), *self.tokens])
        keys, tf = np.unique(rank[tokens] * len(order) + np.repeat(place, self.lengths), return_counts=True)
        df = np.bincount(keys // len(order), minlength=len(names))
        lists = ([self.ids[i] for i in order], [self.lengths[i] for i in order], names, df, keys % len(order), tf)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([v], pa.list_(k)) for v, k in zip(lists, kinds)], names=["documents", "lengths", "terms", "df", "members", "tf"])


def _sharded(most_documents: int, most_terms: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gathered()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.add(doc_id, text.as_py())
                if len(held.ids) >= most_documents or held.size >= most_terms:
                    yield held.batch()
                    held = _Gathered()
        if held.ids:
            yield held.batch()
        trim()

    return run


def build_index(documents: DataFrame, *, shard_documents: int = SHARD_DOCUMENTS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The index of (doc_id, text): a row for each shard, written once; every row of ``documents`` is in it.

    documents: ids in rising order, those without one last; lengths: their terms with repeats;
    terms in byte order, df: in how many documents of the shard; members and tf: places in
    ``documents`` and occurrences, term by term.
    """
    return stage(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sharded(shard_documents, shard_terms), INDEX), "lexical-index", rows_per_file=FILE_SHARDS)


def _asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = sorted(set(terms_of(text.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["number", "term"])


@dataclass
class Best:
    """The best k so far of every query: score, whether the id is missing, id; empty places have score 0."""

    score: np.ndarray
    unknown: np.ndarray
    doc: np.ndarray

    @classmethod
    def none(cls, queries: int, k: int) -> "Best":
        return cls(np.zeros((queries, k), np.int64), np.zeros((queries, k), bool), np.full((queries, k), np.iinfo(np.int64).min))

    def hopeless(self, q: np.ndarray, bound: np.ndarray, unknown: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Where neither the bound nor, if it equals the least kept score, the smallest id can enter the best k.

        An empty place has the smallest id there is, so a bound of 0 never enters.
        """
        least, miss, last = self.score[q, -1], self.unknown[q, -1], self.doc[q, -1]
        behind = (unknown & ~miss) | ((unknown == miss) & (doc >= last))
        return (bound < least) | ((bound == least) & behind)

    def take(self, q: np.ndarray, score: np.ndarray, unknown: np.ndarray, doc: np.ndarray) -> None:
        k = self.score.shape[1]
        hit = np.unique(q)
        q = np.concatenate([q, np.repeat(hit, k)])
        score, unknown, doc = (np.concatenate([new, old[hit].ravel()]) for new, old in ((score, self.score), (unknown, self.unknown), (doc, self.doc)))
        order = np.lexsort((doc, unknown, -score, q))
        q = q[order]
        first = np.searchsorted(q, hit)
        kept = order[(first[:, None] + np.arange(k)).ravel()]  # every query has k places at least
        for new, old in ((score, self.score), (unknown, self.unknown), (doc, self.doc)):
            old[hit] = new[kept].reshape(-1, k)


def gains(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count adds to a score for each unit of its term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """The dual-sorted wavelet tree of one shard, over the postings of the terms that are asked for.

    Level l splits by the l-th highest binary digit of a document's place: at each level the
    sequence has the zeros first, both parts in their former order.  ``zeros`` counts zeros
    before a position, ``gain`` follows the postings through the levels.
    """

    def __init__(self, starts: np.ndarray, members: np.ndarray, gain: np.ndarray, documents: int):
        """starts: where each term's postings begin, and the end of the last."""
        sizes = np.diff(starts)
        order = np.lexsort((members, -gain, np.repeat(np.arange(len(sizes)), sizes)))
        members, gain = members[order], gain[order]
        self.starts, self.size, self.levels = starts, len(members), max(1, int(documents - 1).bit_length())
        self.zeros = np.zeros((self.levels, self.size + 1), np.int32)
        self.gain = np.empty((self.levels + 1, self.size), np.int32)
        self.gain[0] = gain
        for level in range(self.levels):
            one = (members >> (self.levels - 1 - level) & 1).astype(bool)
            np.cumsum(~one, out=self.zeros[level, 1:])
            self.gain[level + 1] = np.concatenate([self.gain[level][~one], self.gain[level][one]])
            members = np.concatenate([members[~one], members[one]])

    def children(self, level: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ranges of the lower and of the upper half of the documents."""
        low, high = self.zeros[level, lo], self.zeros[level, hi]
        base = self.zeros[level, -1]
        return low, high, base + lo - low, base + hi - high


def _each(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions begin, begin + 1, ... of every run, one run after another."""
    ends = np.cumsum(count)
    return np.repeat(begin - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def best_first(tree: Tree, ids: np.ndarray, unknown: np.ndarray, queries: np.ndarray, heads: np.ndarray, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Bring ``best`` up to date with a shard's documents; returns how many nodes were taken.

    ids and unknown: of the documents, in order; queries: their numbers; heads: where
    the terms of each begin, and the end of the last; terms: numbers in the tree.
    """
    # Entries: the range of one term at one node.  Nodes: query, level, first document, bound, and their entries.
    lo, hi, weight = tree.starts[terms], tree.starts[terms + 1], weights
    node = [queries, np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64), np.add.reduceat(weight * tree.gain[0, lo], heads[:-1]), heads[:-1], np.diff(heads)]
    taken = 0
    while len(node[0]):
        q, level, first, bound, begin, count = node
        alive = ~best.hopeless(q, bound, unknown[first], ids[first])
        order = np.flatnonzero(alive)
        order = order[np.lexsort((-bound[order], q[order]))]
        sorted_q = q[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q)
        now, later = order[place < BEAM], order[place >= BEAM]
        if not len(now):
            break
        taken += len(now)
        entry, at = _each(begin[now], count[now]), np.repeat(np.arange(len(now)), count[now])
        low, high, low1, high1 = tree.children(level[now][at], lo[entry], hi[entry])
        child_lo, child_hi = np.concatenate([low, low1]), np.concatenate([high, high1])
        child, w = np.concatenate([at, at + len(now)]), np.concatenate([weight[entry], weight[entry]])
        full = child_hi > child_lo
        child_lo, child_hi, child, w = child_lo[full], child_hi[full], child[full], w[full]
        below = np.concatenate([level[now], level[now]]) + 1
        gain = w * tree.gain[below[child], child_lo]
        own, starts, counts = np.unique(child, return_index=True, return_counts=True)
        half = np.left_shift(1, tree.levels - below)
        firsts = np.concatenate([first[now], first[now]]) + half * (np.arange(2 * len(now)) >= len(now))
        made = [np.concatenate([q[now], q[now]])[own], below[own], firsts[own], np.add.reduceat(gain, starts) if len(own) else gain, starts, counts]
        leaf = made[1] == tree.levels
        if leaf.any():
            best.take(made[0][leaf], made[3][leaf], unknown[made[2][leaf]], ids[made[2][leaf]])
        kept = np.flatnonzero(~leaf)
        # Entries of the nodes that wait are carried on; those of nodes taken or given up are not.
        old = _each(begin[later], count[later])
        new = _each(made[4][kept], made[5][kept])
        lo, hi, weight = np.concatenate([lo[old], child_lo[new]]), np.concatenate([hi[old], child_hi[new]]), np.concatenate([weight[old], w[new]])
        counts = np.concatenate([count[later], made[5][kept]])
        node = [np.concatenate([a[later], b[kept]]) for a, b in zip(node[:4], made[:4])] + [np.cumsum(counts) - counts, counts]
    return taken


def _searched(k: int, known: int, occurrences: int, numbers: list[int], heads: np.ndarray, terms: list[bytes], term_of: np.ndarray, weight: np.ndarray):
    """The task: index rows in, the best k of the task's shards for every query out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, place = Best.none(len(numbers), k), {t: i for i, t in enumerate(terms)}
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths, names, df, members, tf = (batch.column(c)[row].values for c in range(6))
                mine = np.array([place.get(t, -1) for t in names.to_pylist()], np.int64)
                df = df.to_numpy()
                here = np.flatnonzero(mine >= 0)
                if not len(here):
                    continue
                begins = np.cumsum(df) - df
                which = _each(begins[here], df[here])
                members, tf = members.to_numpy()[which].astype(np.int64), tf.to_numpy()[which].astype(np.int64)
                m = np.array([10 + 90 * n * known // occurrences for n in lengths.to_pylist()], np.int64)
                unknown = np.asarray(ids.is_null())
                tree = Tree(np.concatenate([[0], np.cumsum(df[here])]), members, gains(tf, m[members]), len(ids))
                _answer(tree, np.asarray(ids.fill_null(0)), unknown, mine[here], heads, term_of, weight, len(terms), best)
        q, at = np.nonzero(best.score > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(numbers, np.int64)[q]), pa.array(best.doc[q, at], mask=best.unknown[q, at]), pa.array(best.score[q, at])], names=["number", "doc_id", "score"]
        )
        trim()

    return run


def _answer(tree: Tree, ids, unknown, here, heads, term_of, weight, n_terms: int, best: Best) -> None:
    """All queries on one shard, as many at a time as have ``TOGETHER`` postings."""
    local = np.full(n_terms, -1, np.int64)
    local[here] = np.arange(len(here))
    mine = local[term_of]
    held = mine >= 0
    query_of = np.repeat(np.arange(len(heads) - 1), np.diff(heads))[held]
    mine, weights = mine[held], weight[held]
    work = np.bincount(query_of, np.diff(tree.starts)[mine], minlength=len(heads) - 1)
    group = (np.cumsum(work) - work) // TOGETHER
    for g in np.unique(group[work > 0]):
        inside = group[query_of] == g
        queries, begin = np.unique(query_of[inside], return_index=True)
        best_first(tree, ids, unknown, queries, np.append(begin, inside.sum()), mine[inside], weights[inside], best)


def _found(index: DataFrame, asked: DataFrame, k: int, known: int, occurrences: int) -> DataFrame:
    """(number, doc_id, score): the best k of every task; ``asked`` (number, term, weight) is one block."""
    rows = asked.groupBy("number").agg(F.collect_list(F.struct("term", "weight")).alias("terms")).collect()  # at most BLOCK pairs, or one query
    terms = sorted({bytes(t["term"]) for r in rows for t in r["terms"]})
    place = {t: i for i, t in enumerate(terms)}
    heads = np.cumsum([0, *(len(r["terms"]) for r in rows)])
    term_of = np.array([place[bytes(t["term"])] for r in rows for t in r["terms"]], np.int64)
    weight = np.array([t["weight"] for r in rows for t in r["terms"]], np.int64)
    return index.mapInArrow(_searched(k, known, occurrences, [r["number"] for r in rows], heads, terms, term_of, weight), "number long, doc_id long, score long")


def search(queries: DataFrame, documents: DataFrame, *, k: int = 10, index: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(item_id, text), (doc_id, text) -> item_id, rank, doc_id, score: the k best documents of every item, exactly.

    N counts the documents with at least one term, L all their terms.  A term's weight is
    floor(1000 * ln((2N + 2) / (2df + 1))); it adds weight * ((10^9 * tf) div (1000 * tf + 8 * m))
    to a document of n terms, m = 10 + (90 * n * N) div L; a query's terms count once each.
    Documents with score 0 are not returned; equal scores by rising doc_id.

    Null or empty texts have no terms: such documents are never found and such items find
    nothing.  Documents without an id rank last among equals.  Rows with the same doc_id are
    documents of their own; rows with the same item_id are items of their own, each ranked
    from 1.  Texts of every length are indexed whole.  No documents or items: no rows.  Other
    columns are ignored, whatever their names.  ``index`` is what ``build_index`` gave, if
    it is there already; more than ``block`` (item, term) pairs are searched in blocks, long
    terms counting as several.
    """
    index = build_index(documents) if index is None else index
    numbered = stage(queries.select("item_id", "text").withColumn("number", F.monotonically_increasing_id()), "lexical-items")
    terms = numbered.select("number", "text").mapInArrow(_asked, "number long, term binary")
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    totals = index.agg(F.sum(F.size(F.filter("lengths", lambda n: n > 0))).alias("known"), F.sum(add("lengths")).alias("occurrences")).first()
    known, occurrences = totals["known"] or 0, totals["occurrences"] or 0
    spark = documents.sparkSession
    if not occurrences:
        return spark.createDataFrame([], f"item_id {numbered.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    pairs = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    df = pairs.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * known + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    asked = stage(terms.join(df.select("term", weight.alias("weight")), "term"), "lexical-asked")
    # Blocks of whole queries, dealt by a hash.
    pairs_asked = asked.agg(F.sum(1 + F.floor(F.octet_length("term") / 16)).alias("n")).first()["n"] or 0
    blocks = -(-pairs_asked // block)
    if not blocks:
        return spark.createDataFrame([], f"item_id {numbered.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    found = None
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b)
        part = _found(index, mine, k, known, occurrences)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(numbered.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
