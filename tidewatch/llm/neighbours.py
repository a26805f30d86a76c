"""Approximate nearest neighbours by a forest of hash prefixes.

Every vector gets a string of BITS bits in each of TREES trees: on which side of a plane it
lies, planes being orthogonal in groups and placed at the sample's medians. Vectors are
first given one more component, sqrt(R**2 - |x|**2) with R the largest norm (0 for queries),
which turns the largest inner product into the smallest angle.

A tree is its strings in ascending order. A query descends to its longest prefix match in
every tree; from the deepest of these levels all trees ascend together, one bit at a time,
until the ranges of equal prefixes hold enough rows. Those rows' inner products are then
taken exactly, in double precision.

Rows are dealt into blocks of about BLOCK_ROWS, each with a forest of its own, and the
queries into groups; every group meets every block, each in a task of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES, BITS = 24, 48
BLOCK_ROWS, GROUP_QUERIES = 8192, 4096
#: Fitting: rows and queries of the sample, recall that it must show, shares of a tree's rows that are tried.
SAMPLE_ROWS, SAMPLE_QUERIES, RECALL = 4096, 256, 0.95
SHARES = (0.002, 0.003, 0.004, 0.005, 0.007, 0.01, 0.014, 0.02, 0.025, 0.03, 0.035, 0.04, 0.045, 0.05, 0.055, 0.06, 0.065, 0.07, 0.075, 0.08, 0.09, 0.1, 0.15, 0.2, 1.0)


class Planes:
    """The hash functions of all trees."""

    def __init__(self, sample: np.ndarray, radius: float, trees: int = TREES, bits: int = BITS, seed: int = 11):
        rng = np.random.default_rng(seed)
        size = sample.shape[1] + 1
        groups = [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(-(-trees * bits // size))]
        self.radius, self.trees, self.bits = radius, trees, bits
        self.directions = np.concatenate(groups, axis=1)[:, : trees * bits].astype(np.float32)
        self.middle = np.median(self.raised(sample) @ self.directions, axis=0)

    def raised(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.radius**2 - (x.astype(np.float64) ** 2).sum(axis=1)))
        return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)

    def strings(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """(trees, rows) of bit strings as numbers."""
        raised = np.concatenate([x, np.zeros((len(x), 1))], axis=1).astype(np.float32) if query else self.raised(x)
        side = (raised @ self.directions > self.middle).reshape(len(x), self.trees, self.bits)
        return (side @ (2.0 ** np.arange(self.bits - 1, -1, -1))).T.astype(np.uint64)


class Forest:
    def __init__(self, planes: Planes, vectors: np.ndarray):
        self.planes = planes
        strings = planes.strings(vectors)
        self.order = np.argsort(strings, axis=1)
        self.strings = np.take_along_axis(strings, self.order, axis=1)
        self.rows = len(vectors)

    def ranges(self, queries: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries) of where each tree's matches start and end, at the level where the query stops."""
        bits, asked = self.planes.bits, self.planes.strings(queries, True)
        trees, n = asked.shape
        # descend: the longest prefix that a neighbour in the order shares
        depth = np.zeros(n, np.int64)
        for t in range(trees):
            at = np.searchsorted(self.strings[t], asked[t])
            for beside in (np.maximum(at - 1, 0), np.minimum(at, self.rows - 1)):
                differ = self.strings[t][beside] ^ asked[t]
                length = bits - np.ceil(np.log2(differ.astype(np.float64) + 1)).astype(np.int64)
                depth = np.maximum(depth, length)
        start, end = np.zeros((trees, n), np.int64), np.full((trees, n), self.rows, np.int64)
        open_ = np.arange(n)
        for level in range(int(depth.max(initial=0)), 0, -1):  # ascend
            here = open_[depth[open_] >= level]
            if not len(here):
                continue
            shift = np.uint64(bits - level)
            low = asked[:, here] >> shift << shift
            high = low + ((np.uint64(1) << shift) - np.uint64(1))
            a = np.stack([np.searchsorted(s, x) for s, x in zip(self.strings, low, strict=True)])
            b = np.stack([np.searchsorted(s, x, side="right") for s, x in zip(self.strings, high, strict=True)])
            full = (b - a).sum(axis=0) >= enough
            start[:, here[full]], end[:, here[full]] = a[:, full], b[:, full]
            open_ = np.setdiff1d(open_, here[full], assume_unique=True)
        return start, end

    def candidates(self, queries: np.ndarray, share: float, least: int):
        """For each query the rows that some tree brings."""
        enough = max(least, math.ceil(share * self.rows * self.planes.trees))
        start, end = self.ranges(queries, enough)
        seen = np.zeros(self.rows, bool)
        for i in range(len(queries)):
            for t in range(self.planes.trees):
                seen[self.order[t, start[t, i] : end[t, i]]] = True
            at = np.flatnonzero(seen)
            seen[at] = False
            yield at


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        bound = -np.partition(-scores, k - 1)[k - 1]
        near = np.flatnonzero(scores >= bound)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def fit(sample: np.ndarray, radius: float, k: int, recall: float = RECALL) -> tuple[Planes, float]:
    """Planes, and the least share of SHARES with which the sample's queries find `recall` of their k nearest."""
    planes = Planes(sample, radius)
    forest, queries = Forest(planes, sample), sample[:SAMPLE_QUERIES]
    scores = queries.astype(np.float64) @ sample.astype(np.float64).T
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    ids = np.arange(len(sample))
    near = [set(best(ids, s, k).tolist()) for s in scores]
    for share in SHARES:
        found = sum(len(n & set(c.tolist())) for n, c in zip(near, forest.candidates(queries, share, 4 * k), strict=True))
        if found >= recall * sum(map(len, near)):
            return planes, share
    return planes, 1.0


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed component by component in one order: equal vectors get equal scores, wherever they stand."""
    out = np.zeros(len(vectors))
    for at in range(0, len(vectors), 4096):
        part = vectors[at : at + 4096].T * query[:, None]
        out[at : at + 4096] = np.add.accumulate(part, axis=0)[-1] if len(part) else 0.0
    return out


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, every component finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def nearest(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest rows by inner product, as far as the forest finds them.

    Queries are the rows for which `is_query` holds; a query doesn't find rows of its own key.
    Null, zero and non-finite vectors take no part, nor do null keys or vectors whose length
    is not that of most sampled ones. A query key that repeats counts once, with its least
    vector. Equal scores go to the smaller key. Every row is indexed; the sample of
    SAMPLE_ROWS only places the planes and picks how far to ascend.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(key).isNotNull() & F.coalesce(usable(F.col(vector)), F.lit(False))).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toArrow().column("v").to_pylist()
    schema = f"query_id {dict(df.dtypes)[key]}, rank int, vec_id {dict(df.dtypes)[key]}, score double"
    if not sample:
        return spark.createDataFrame([], schema)
    lengths = [len(x) for x in sample]
    size = max(set(lengths), key=lambda n: (lengths.count(n), n))
    rows = rows.filter(F.size("v") == size)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, asked, radius = rows.agg(F.count("*"), F.count_if("asks"), F.max(norm)).first()
    planes, share = fit(np.array([x for x in sample if len(x) == size], np.float64), radius, k, recall)
    fitted = spark.sparkContext.broadcast((planes, share))
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-asked // GROUP_QUERIES))
    queries = rows.filter("asks").groupBy("id").agg(F.min("v").alias("v"))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "id", "v")
    asking = queries.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": right.column("id").slice(0, 0), "vec_id": left.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        planes, share = fitted.value
        ids, vectors = left.column("id").to_numpy(), matrix(left.column("v"))
        asks, asked_for = right.column("id").to_numpy(), matrix(right.column("v"))
        forest = Forest(planes, vectors)
        out = []
        for i, at in enumerate(forest.candidates(asked_for, share, 4 * k)):
            at = at[ids[at] != asks[i]]
            scores = vectors[at] @ asked_for[i]
            if len(at) > 4 * k:  # the sums' order matters in the last bits only
                near = np.partition(scores, len(at) - 2 * k)[len(at) - 2 * k]
                at = at[scores >= near - 1e-9 * max(1.0, abs(near))]
            scores = products(vectors[at], asked_for[i])
            pick = best(ids[at], scores, k)
            out.append((np.repeat(asks[i], len(pick)), ids[at[pick]], scores[pick]))
        return pa.table(dict(zip(names, (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    kind = dict(df.dtypes)[key]
    found = dealt.groupBy("block", "group").cogroup(asking.groupBy("block", "group")).applyInArrow(search, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
