"""Nearest neighbours by multi-index hashing of learned binary codes.

A rotation learned on a sample (iterative quantisation) turns a unit vector into a
64-bit code.  Codes are cut into substrings of 16 bits and each substring is
indexed.  Two codes within Hamming distance r agree, in at least one of the m
substrings, up to floor(r / m) bits; so probing every substring's index with all
keys that near yields every code within r.  Those are checked by their whole codes
and reranked by the cosine of the original vectors.

Candidates are hashed into cells of bounded size and the queries into blocks; each
(cell, block) is searched in one task, and only the best few of each query leave it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

BITS, SUB = 64, 16
#: Rows of a cell and of a block of queries, on average.
CELL, BLOCK = 8192, 4096
_POP = np.array([bin(i).count("1") for i in range(1 << SUB)], np.uint8)


@dataclass(frozen=True)
class Codes:
    """``rotation`` maps a unit vector (less ``mean``) to 64 values whose signs are the code; ``radius`` is searched first."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def of(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        signs = (unit - self.mean) @ self.rotation > 0
        return np.packbits(signs, axis=1, bitorder="little").view("<u8").ravel()


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _top(queries: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    sims = queries @ points.T
    return np.argpartition(-sims, min(k, sims.shape[1] - 1), axis=1)[:, :k]


def learn(vectors: DataFrame, *, most: int = 20_000, k: int = 5, rounds: int = 30, reach: float = 0.98, seed: int = 7) -> Codes | None:
    """Fit the rotation on (vec_id, vector), and the radius that holds the share ``reach`` of true neighbours.

    The sample is bounded: the ``most`` usable rows of the least hash of vec_id.  In it,
    neighbours lie farther apart than among all rows, so the radius errs to the wide
    side.  None if there is no usable row.
    """
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("vec_id", "vector").toPandas()
    if rows.empty:
        return None
    x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0)
    centred = x - mean
    dims = x.shape[1]
    # Project on the leading axes (or pad by random ones where there are fewer than BITS), then rotate.
    _, _, axes = np.linalg.svd(centred, full_matrices=True) if len(x) < 2 * dims else (0, 0, np.linalg.eigh(centred.T @ centred)[1].T[::-1])
    basis = axes[:BITS].T if dims >= BITS else np.hstack([axes.T, rng.normal(size=(dims, BITS - dims)) / np.sqrt(dims)])
    z = centred @ basis
    turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.sign(z @ turn).T @ z)
        turn = (u @ vt).T
    codes = Codes(mean, basis @ turn, BITS)
    own = codes.of(x)
    probe = rng.choice(len(x), min(500, len(x)), replace=False)
    if len(x) <= k + 1:
        return codes
    near = _top(x[probe], x, k + 1)
    far = np.bitwise_count(own[probe][:, None] ^ own[near])
    far = far[near != probe[:, None]]
    return Codes(mean, basis @ turn, int(np.quantile(far, reach, method="higher")))


class Index:
    """Substring indexes over the codes of a cell."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.subs = []
        for i in range(BITS // SUB):
            keys = ((codes >> np.uint64(i * SUB)) & np.uint64((1 << SUB) - 1)).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            present, starts = np.unique(keys[order], return_index=True)
            self.subs.append((present, starts, np.append(starts[1:], len(keys)), order))

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows of every code within the radius, ascending."""
        reach = radius // len(self.subs)
        hit = np.zeros(len(self.codes), bool)
        for i, (present, starts, ends, order) in enumerate(self.subs):
            key = int(code) >> (i * SUB) & ((1 << SUB) - 1)
            near = np.flatnonzero(_POP[present ^ key] <= reach)  # the keys that are in use, among all that near
            lengths = ends[near] - starts[near]
            if lengths.size:
                offsets = np.repeat(starts[near] - np.append(0, lengths.cumsum()[:-1]), lengths)
                hit[order[offsets + np.arange(lengths.sum())]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def _search(codes: Codes, k: int):
    def run(key, points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if points.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        p, q = (np.stack(f["vector"].to_numpy()).astype(np.float64) for f in (points, queries))
        ids = points["vec_id"].to_numpy()
        p_len, q_len = (np.sqrt((v * v).sum(axis=1)) for v in (p, q))
        index = Index(codes.of(p))
        repeated = len(np.unique(ids)) < len(ids)  # an id with several vectors counts once
        out = []
        for vec_id, vector, length, code in zip(queries["vec_id"].to_numpy(), q, q_len, codes.of(q)):
            radius = codes.radius
            while True:  # widened until this cell alone could fill the answer, so no query comes out short
                rows = index.within(code, radius)
                rows = rows[ids[rows] != vec_id]
                if radius >= BITS or (len(np.unique(ids[rows])) if repeated else len(rows)) >= k:
                    break
                radius = min(BITS, radius + 4)
            score = (p[rows] * vector).sum(axis=1) / (p_len[rows] * length)
            best = np.lexsort((ids[rows], -score))
            best = best[np.sort(np.unique(ids[rows][best], return_index=True)[1])][:k] if repeated else best[:k]
            out.append(pd.DataFrame({"query_id": vec_id, "vec_id": ids[rows][best], "score": score[best]}))
        return pd.concat(out, ignore_index=True).astype({"query_id": "int64", "vec_id": "int64"})

    return run


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 5, sample: int = 20_000, reach: float = 0.98, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank (from 1), vec_id, score (cosine).

    vectors: (vec_id, vector); extra columns are ignored, whatever their names.
    ``is_query`` may look at vec_id and vector.  Every row but those with the query's own
    id is a candidate.  Nearest first, ties to the smaller vec_id; all candidates if there
    are fewer than k.  Rows whose vector is null, zero or holds null or non-finite
    components, or whose id is null, take no part.  A cosine needs vectors of one length:
    each length is searched on its own.  Rows that are equal throughout are one; an id
    with several vectors is a candidate, or a query, by its nearest.  No usable rows: no
    result.  ``cell`` candidates and ``block`` queries, about, meet in a task.
    """
    good = stage(vectors.select("vec_id", F.col("vector").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).distinct(), "ann-vectors")
    out = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    sizes = good.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).where("q > 0").orderBy("d").collect()  # a row for each length that is asked for
    for d, n, n_queries in sizes:
        out = out.unionByName(_of_length(good.where(F.size("vector") == d), is_query, n, n_queries, k, sample, reach, cell, block))
    single = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return single.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_length(good: DataFrame, is_query: Column, n: int, n_queries: int, k: int, sample: int, reach: float, cell: int, block: int) -> DataFrame:
    """The best few of each query in each cell, among vectors of one length."""
    codes = learn(good, most=sample, k=k, reach=reach)
    cells, blocks = max(1, -(-n // cell)), max(1, -(-n_queries // block))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = good.withColumn("cell", F.pmod(F.xxhash64("vec_id"), F.lit(cells)).cast("int")).withColumn("block", every(blocks))
    right = good.where(is_query).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("cell", every(cells))
    return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInPandas(_search(codes, k), "query_id long, vec_id long, score double")
