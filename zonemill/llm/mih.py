"""Nearest neighbours by multi-index hashing over learned rotated binary codes (Norouzi, Punjani, Fleet 2012).

Codes are signs after learned rotations (iterative quantisation, several starts). A code is cut into ``PARTS`` substrings,
each with its own index. By the pigeonhole principle a code within distance r of the query has a substring within
floor(r / PARTS), and for all but the first r mod PARTS + 1 substrings one less suffices; the codes found there are
checked on all bits, and what lies within r is ranked by exact inner products.

Queries meet the index in blocks: a block of index rows builds its substring indices once per block of queries, answers
with its ``k`` best per query, and these are merged. r is the distance within which a sample of queries finds its
neighbours in a sample of vectors; where a block has fewer than ``k`` codes within r, its r grows until it has them, so
every query gets its ``k``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 6_000  # vectors that rotations and the radius are learned from
BITS = 256
PARTS = 16
RECALL = 0.985  # share of sample neighbours that the radius has to reach
INDEX_ROWS = 8192
QUERY_ROWS = 1024
FOUND = "query_id long, query_key long, vec_id long, score double"


def rotations(x: np.ndarray, bits: int = BITS, rounds: int = 25, seed: int = 7) -> np.ndarray:
    """Projection matrix (dimensions × bits): per start a random orthogonal basis, turned towards its own signs."""
    rng = np.random.default_rng(seed)
    out = []
    while sum(w.shape[1] for w in out) < bits:
        r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
        for _ in range(rounds if len(x) else 0):
            u, _, v = np.linalg.svd(x.T @ np.sign(x @ r))
            r = u @ v
        out.append(r)
    return np.concatenate(out, axis=1)[:, :bits]


def lifted(x: np.ndarray, longest: float | None = None) -> np.ndarray:
    """One more component that makes all indexed vectors as long as the ``longest``; 0 for queries. The largest inner
    product is then the smallest angle."""
    more = np.zeros(len(x)) if longest is None else np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))
    return np.column_stack([x, more])


class Codes:
    """Binary codes as ``PARTS`` unsigned 16-bit substrings."""

    def __init__(self, weights: np.ndarray, longest: float):
        self.weights, self.longest = weights, longest

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(lifted(x, self.longest) @ self.weights > 0, axis=1).view("<u2")

    def of_query(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(lifted(x) @ self.weights > 0, axis=1).view("<u2")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ, for every row of ``a`` against one row ``b``."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def learned_radius(x: np.ndarray, codes: Codes, k: int, queries: int = 300) -> int:
    """The distance that holds ``RECALL`` of the true ``k`` neighbours of sample queries in the sample.

    In the whole table neighbours are nearer than in the sample, so the sample's radius is on the safe side.
    """
    if len(x) < 2:
        return BITS
    c, asked = codes.of(x), codes.of_query(x[:queries])
    far = []
    for i in range(len(asked)):
        score = x @ x[i]
        score[i] = -np.inf
        near = np.argpartition(-score, min(k, len(x) - 1) - 1)[:k]
        far.append(distances(c[near], asked[i]))
    return int(np.quantile(np.concatenate(far), RECALL))


class Index:
    """Substring indices of a block: per substring its distinct values and the rows that have them."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for part in codes.T:
            order = np.argsort(part, kind="stable")
            values, first = np.unique(part[order], return_index=True)
            self.tables.append((values, order, np.append(first, len(part))))

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows within ``radius``: probe every substring's buckets by pigeonhole, check what they hold on all bits."""
        base, rest = divmod(radius, PARTS)
        hit = np.zeros(len(self.codes), bool)
        for j, (values, order, first) in enumerate(self.tables):
            reach = base if j <= rest else base - 1
            if reach < 0:
                continue
            near = np.bitwise_count(values ^ query[j]) <= reach
            hit[order[np.repeat(near, np.diff(first))]] = True
        rows = np.flatnonzero(hit)
        return rows[distances(self.codes[rows], query) <= radius]


def _search(block: pd.DataFrame, asked: pd.DataFrame, codes: Codes, radius: int, k: int) -> pd.DataFrame:
    if block.empty or asked.empty:
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "query_key": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    block = block.sort_values("vec_id", kind="stable")
    ids, keys, x = block["vec_id"].to_numpy(), block["row_key"].to_numpy(), np.stack(block["vector"].to_numpy())
    index = Index(codes.of(x))
    q_ids, q_keys, q = asked["vec_id"].to_numpy(), asked["row_key"].to_numpy(), np.stack(asked["vector"].to_numpy())
    q_codes = codes.of_query(q)
    out = []
    for i in range(len(q)):
        own = np.zeros(len(ids), bool)
        own[np.flatnonzero((ids == q_ids[i]) & (keys == q_keys[i]) & (x == q[i]).all(axis=1))[:1]] = True  # all rows of an id lie in one block
        need, r = min(k, int((~own).sum())), radius
        while True:
            rows = index.within(q_codes[i], r)
            rows = rows[~own[rows]]
            if len(rows) >= need or r >= BITS:
                break
            r = min(BITS, r + PARTS)
        score = (x[rows] * q[i]).sum(axis=1)  # equal vectors have equal sums, wherever they lie
        best = np.lexsort((ids[rows], -score))[:k]
        out.append((np.full(len(best), q_ids[i]), np.full(len(best), q_keys[i]), ids[rows[best]], score[best]))
    parts = [np.concatenate(c) for c in zip(*out)]
    return pd.DataFrame(dict(zip(("query_id", "query_key", "vec_id", "score"), parts)))


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``vector`` (doubles) of rows that are not null, empty, zero or holding null, NaN or infinite parts."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """The ``k`` nearest other vectors by inner product of every row where ``is_query`` holds.

    ``query_id``, ``rank`` (from 1, ties by smaller vec_id), ``vec_id``, ``score`` (exact, in double precision). Vectors
    of another length than most, and those that :func:`usable` leaves out, take no part. Rows of one vec_id are candidates each, and
    queries each where their vectors differ; a query that repeats exactly is answered once, and its copies are candidates.
    """
    rows = usable(vectors).withColumn("row_key", F.xxhash64("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v))
    shapes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("longest")).orderBy(F.desc("n"), "d").first()
    d, n, longest = (shapes["d"], shapes["n"], shapes["longest"]) if shapes else (1, 0, 0.0)
    rows = rows.where(F.size("vector") == d)
    share = min(1.0, SAMPLE / max(n, 1))
    sample = rows.where(F.shiftrightunsigned(F.xxhash64("vec_id"), 1) <= min(int(share * 2**63), 2**63 - 1)).orderBy("vec_id", "row_key").limit(2 * SAMPLE).collect()
    x = np.array([r["vector"] for r in sample]).reshape(len(sample), d)
    codes = Codes(rotations(lifted(x, longest)), longest)
    radius = learned_radius(x, codes, k)
    blocks = max(1, -(-n // INDEX_ROWS))
    parts = max(1, -(-n // (20 * QUERY_ROWS)))
    place = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    index = rows.select(place(blocks).alias("block"), every(parts).alias("part"), "vec_id", "row_key", "vector")
    queries = rows.where(is_query).dropDuplicates(["vec_id", "vector"])
    asked = queries.select(place(parts).alias("part"), every(blocks).alias("block"), "vec_id", "row_key", "vector")
    found = (index.groupBy("block", "part").cogroup(asked.groupBy("block", "part"))
             .applyInPandas(lambda a, b: _search(a, b, codes, radius, k), FOUND))
    # k rows of a query from each block: ranked within limits, block by block first
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
