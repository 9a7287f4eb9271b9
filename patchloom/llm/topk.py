"""Exact top-k search by block-at-a-time pruning.

Vectors are integers; the terms are the components. Candidates are cut into document-range blocks
that keep their vectors (the forward index) and, for each term, the largest and the smallest
value. A query's bound of a block sums, over its terms, the larger of weight * largest and
weight * smallest. Each query takes blocks by falling bound until no bound left reaches its k-th
score; blocks that tie with it are still taken, as a smaller id wins. A block is scored in two
steps: first over the query's heaviest terms, those that hold ``HEAD`` of its squared weight; the
other terms are scored only for vectors whose score so far, with the summed maxima of the other
terms, still reaches the k-th score. For dense vectors without a direction of their own the bounds
over all terms exclude little, and it is the second step that prunes.

Queries and candidates are dealt into groups by hash and each pair of groups meets in one task, so
neither side is ever broadcast or collected; tasks return k rows for each query at most. A first
pass over one group of candidates gives each query a score that its k-th best has at least, and
the pairs of groups start from it.

Defined results: vectors that are null or hold null or non-finite components take no part;
shorter vectors count as padded with zeros; a row's candidates are all rows of another vec_id, so
rows that repeat an id are never each other's neighbours; repeated query rows give their rows
again; null ids are no queries and no candidates. Components are exact however large; a score
beyond a long counts as the long nearest to it, and such scores tie. Other columns are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, HEAD = 8, 0.98
#: Blocks that a query takes in a first step of its own, queries that share strips, blocks of a strip.
FIRST, BATCH, STRIP = 8, 256, 128
#: Vectors of one group of candidates, and of one group of queries.
CANDIDATES, QUERIES = 8192, 4096
RESULT = "row_key string, query_id long, vec_id long, score long"
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, the components as floor(scale * x) in doubles, of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long"), x.alias("x"), fine.alias("fine")).filter("vec_id IS NOT NULL AND fine")

    def whole(c: Column) -> Column:
        y = F.greatest(F.least(F.lit(scale) * c, F.lit(sys.float_info.max)), F.lit(-sys.float_info.max))
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # from there on doubles are whole

    return rows.select("vec_id", F.transform("x", whole).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def _width(t: pa.Table) -> int:
    return int(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max(initial=0))


def _heads(queries: np.ndarray) -> np.ndarray:
    """Which terms of each query are among its heaviest."""
    weight = np.abs(queries).astype(np.float64)
    weight = (weight / np.maximum(weight.max(axis=1, initial=0), 1e-300)[:, None]) ** 2
    order = np.argsort(-weight, axis=1, kind="stable")
    falling = np.take_along_axis(weight, order, 1)
    before = np.cumsum(falling, axis=1) - falling
    out = np.zeros(queries.shape, bool)
    np.put_along_axis(out, order, before < HEAD * weight.sum(axis=1)[:, None], 1)
    return out


class Search:
    """One group of candidates, in blocks; keeps the k best of each query."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, block: int, floor: np.ndarray) -> None:
        limit = max(1, queries.shape[1]) * max(1.0, float(np.abs(queries).max(initial=0))) * max(1.0, float(np.abs(vectors).max(initial=0)))
        self.exact = limit < 2**53  # in doubles; beyond, in Python's integers
        as_kind = (lambda x: x.astype(np.float64)) if self.exact else np.frompyfunc(int, 1, 1)
        self.queries, self.vectors = as_kind(queries), as_kind(vectors)
        self.query_ids, self.ids, self.k, self.floor = query_ids, ids, k, floor
        self.starts = np.arange(0, len(ids), block)
        self.block_of = np.arange(len(ids)) // block
        self.high, self.low = (f.reduceat(self.vectors, self.starts, axis=0) for f in (np.maximum, np.minimum))
        head = _heads(queries)
        self.head, self.tail = np.where(head, self.queries, 0), np.where(head, 0, self.queries)
        self.bound, self.rest = self.maxima(self.queries), self.maxima(self.tail)
        self.best = np.full((len(queries), k), LOW, np.int64)
        self.place = np.full((len(queries), k), -1)
        self.scored = 0

    def maxima(self, weights: np.ndarray) -> np.ndarray:
        """Summed term maxima: a row for each query, a column for each block."""
        return np.where(weights > 0, weights, 0) @ self.high.T + np.where(weights < 0, weights, 0) @ self.low.T

    def kth(self) -> np.ndarray:
        """What a vector's score must reach, for each query."""
        return np.where(self.place[:, -1] >= 0, np.maximum(self.best[:, -1], self.floor), self.floor)

    def take(self, q: np.ndarray, v: np.ndarray, so_far: np.ndarray) -> None:
        """Scores the other terms of pairs of query and vector whose score can still reach the k-th, and keeps the k best."""
        may = (so_far + self.rest[q, self.block_of[v]] >= self.kth()[q]) & (self.query_ids[q] != self.ids[v])
        may = may.astype(bool)
        q, v, so_far = q[may], v[may], so_far[may]
        self.scored += len(np.unique(q * len(self.starts) + self.block_of[v]))
        score = so_far + (self.tail[q] * self.vectors[v]).sum(axis=1) if len(q) else so_far
        score = score.astype(np.int64) if self.exact else np.array([min(max(int(x), LOW), HIGH) for x in score], np.int64)
        had, column = np.nonzero(self.place[np.unique(q)] >= 0)
        had = np.unique(q)[had]
        q, p, s = np.concatenate((q, had)), np.concatenate((v, self.place[had, column])), np.concatenate((score, self.best[had, column]))
        order = np.lexsort((p, -1 - s, q))  # places ascend with ids; -1 - s does not overflow
        q, p, s = q[order], p[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        self.place[q[top], rank[top]], self.best[q[top], rank[top]] = p[top], s[top]

    def run(self) -> None:
        n, blocks = self.bound.shape
        size = int(self.starts[1]) if blocks > 1 else len(self.ids)
        for lo in range(0, n, BATCH):
            rows = np.arange(lo, min(lo + BATCH, n))
            order = np.argsort(-self.bound[rows], axis=1, kind="stable")
            for step in range(min(FIRST, blocks)):
                b = order[:, step]
                open_ = (self.bound[rows, b] >= self.kth()[rows]).astype(bool)
                v = (b[open_] * size)[:, None] + np.arange(size)
                q = np.repeat(rows[open_], size)
                v = v.ravel()
                inside = v < len(self.ids)
                q, v = q[inside], v[inside]
                self.take(q, v, (self.head[q] * self.vectors[v]).sum(axis=1))
            done = np.zeros((len(rows), blocks), bool)
            np.put_along_axis(done, order[:, :FIRST], True, 1)
            by_bound = np.argsort(-self.bound[rows].max(axis=0), kind="stable")
            for at in range(0, blocks, STRIP):
                strip = np.sort(by_bound[at : at + STRIP])
                open_ = (self.bound[np.ix_(rows, strip)] >= self.kth()[rows][:, None]).astype(bool) & ~done[:, strip]
                some, used = open_.any(axis=1), open_.any(axis=0)
                if not some.any():
                    continue
                v = np.flatnonzero(np.isin(self.block_of, strip[used]))
                column = np.searchsorted(strip, self.block_of[v])
                so_far = self.head[rows[some]] @ self.vectors[v].T
                reach = so_far + self.rest[np.ix_(rows[some], strip)][:, column]
                r, c = np.nonzero((reach >= self.kth()[rows[some]][:, None]).astype(bool) & open_[some][:, column])
                self.take(rows[some][r], v[c], so_far[r, c])


def search_group(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK, floor: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, int]:
    """For each query the places and scores of its k best vectors (-1: none), and how many blocks were scored to the end.

    Vectors that score below a query's ``floor`` may be left out.
    """
    order = np.argsort(ids, kind="stable")
    if not len(order) or not len(queries):
        return np.full((len(queries), k), -1), np.full((len(queries), k), LOW, np.int64), 0
    search = Search(queries, query_ids, vectors[order], ids[order], k, block, np.full(len(queries), LOW, np.int64) if floor is None else floor)
    search.run()
    return np.where(search.place >= 0, order[np.maximum(search.place, 0)], -1), search.best, search.scored


def _meet(k: int):
    def task(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return pa.table({n: pa.array([], pa.string() if n == "row_key" else pa.int64()) for n in ("row_key", "query_id", "vec_id", "score")})
        width = max(_width(q), _width(c))
        query_ids, ids = q["vec_id"].to_numpy(), c["vec_id"].to_numpy()
        floor = q["floor"].combine_chunks().fill_null(LOW).to_numpy(zero_copy_only=False)
        place, score, _ = search_group(_matrix(q["v"], width), query_ids, _matrix(c["v"], width), ids, k, floor=floor)
        row, rank = np.nonzero(place >= 0)
        return pa.table({
            "row_key": q["row_key"].take(pa.array(row)),
            "query_id": pa.array(query_ids[row], pa.int64()),
            "vec_id": pa.array(ids[place[row, rank]], pa.int64()),
            "score": pa.array(score[row, rank], pa.int64()),
        })

    return task


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, candidates_per_group: int = CANDIDATES, queries_per_group: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score; vectors and queries: vec_id and v, an array of whole numbers.

    Equal query rows are told apart by their number among equals, so each gives its own rows.
    """
    again = F.row_number().over(Window.partitionBy("vec_id", "v").orderBy("vec_id"))
    v = F.col("v").cast("array<double>").alias("v")
    queries = queries.select(F.col("vec_id").alias("vec_id"), v, F.concat_ws(":", "vec_id", F.xxhash64("v"), again).alias("row_key"))
    n, m = vectors.count(), queries.count()
    parts, query_parts = max(1, -(-n // candidates_per_group)), max(1, -(-m // queries_per_group))
    # Both sides carry keys of one type: groups of other types would hash apart.
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    group = lambda count, *of: F.pmod(F.xxhash64(*of), F.lit(count)).cast("int")
    # Ranges of ids would split a hot id badly; hashing the vector too spreads rows that repeat one.
    dealt = vectors.select("vec_id", v, group(parts, "vec_id", "v").alias("c"))
    order = Window.partitionBy("row_key").orderBy(F.desc("score"), "vec_id")

    def best(q: DataFrame, c: DataFrame) -> DataFrame:
        c = c.select("vec_id", "v", "c", every(query_parts).alias("q"))
        found = q.groupBy("q", "c").cogroup(c.groupBy("q", "c")).applyInArrow(_meet(k), RESULT)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    q = queries.withColumn("q", group(query_parts, "row_key")).withColumn("floor", F.lit(None).cast("long"))
    if parts > 1:
        seeds = best(q.withColumn("c", F.lit(0)), dealt.filter("c = 0")).filter(F.col("rank") == k)
        q = q.drop("floor").join(seeds.select("row_key", F.col("score").alias("floor")), "row_key", "left")
    return best(q.withColumn("c", every(parts)), dealt).select("query_id", "rank", "vec_id", "score")
