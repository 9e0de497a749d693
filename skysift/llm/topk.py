"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors are integers, so that scores are exact. Candidates and queries are dealt into blocks of bounded size;
each pair of blocks is one group. Inside a group every dimension has a list of the candidates, sorted by their
component. A query reads the lists from the end that its sign wants, chunk by chunk, always on the list whose
unread rest can still change a score the most, which is a matter of the query's weight and of the list's
values. A candidate that has been read somewhere has a lower and an upper bound: what was read of it, and for
the lists where it wasn't, the far end or the last value read. An outsider, read nowhere, has the sum of the
last values read as its upper bound. Reading stops when outsiders can't reach the k-th best lower bound; the
candidates whose upper bound does, few of all, are resolved exactly. Each group returns its k best for each query, and a
window keeps the k best of all groups.

Defined results: a vector that is null or holds a null or a component that isn't finite once scaled takes no
part. Shorter vectors, empty ones included, count as padded with zeros. A row without an id takes no part. Rows
that repeat an id are one query (the smallest vector) and separate candidates; a query never meets rows of its
own id. Ties go to smaller ids. Scores are ranked by their true value; one beyond the range of a long is given
as the nearest long. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.llm.common import let_workers_import

CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 1024
#: Queries of a block are evaluated together, so many at a time.
BATCH = 256
#: A list is read in so many chunks. Bounds are compared when the unread rest is down to 1 / FIRST, then whenever it has shrunk by SHRUNK.
CHUNKS, FIRST, SHRUNK = 4, 4, 2
#: Reading goes on until at most this fraction of the candidates is left to be resolved.
RESOLVED = 32
LEAST, MOST = -(2**63), 2**63 - 1


def quantized(vectors: DataFrame, scale: float = 64.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * component) of every usable vector, as whole doubles."""
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * scale)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), scaled.alias("x"))
    usable = F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    return rows.filter(usable).select("vec_id", F.transform("x", whole).alias("v"))


def _matrix(vectors: pd.Series, width: int, kind: str) -> np.ndarray:
    """Whole numbers as floats in which all sums are exact, or as Python's integers where none would do."""
    out = np.zeros((len(vectors), width), kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = [int(x) for x in v] if kind == "object" else v
    return out


class SortedLists:
    """The sorted lists of a block of candidates, one for each dimension, cut into chunks."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        n, width = x.shape
        self.chunks = min(CHUNKS, n)
        # whole numbers that no float sums exactly are scaled to 1 for the bounds, which then leave room for rounding
        self.inexact = x.dtype == object
        z = self._floats(x)
        order = np.argsort(z, axis=0, kind="stable")
        edges = np.arange(self.chunks + 1) * n // self.chunks
        values = np.take_along_axis(z, order, axis=0)
        #: the value at the frontier after so many chunks, from the low and from the high end; the last is the far end
        self.frontier = np.stack([values[np.r_[0, edges[1:] - 1]], values[np.r_[n - 1, edges[-2::-1]]]]).transpose(0, 2, 1).copy()
        self.shown, self.mark = (np.zeros((self.chunks, width, n), z.dtype) for _ in range(2))
        for c in range(self.chunks):
            rows = order[edges[c] : edges[c + 1]]
            self.shown[c, np.arange(width), rows] = values[edges[c] : edges[c + 1]]
            self.mark[c, np.arange(width), rows] = 1

    def _floats(self, x: np.ndarray) -> np.ndarray:
        return x if not self.inexact else (x / 2 ** int(np.abs(x).max()).bit_length()).astype("float64")

    def top_k(self, query_id: int, q: np.ndarray, k: int) -> tuple[list[tuple[int, int]], float]:
        """(vec_id, score) of the k best candidates for a query, and the share of the lists that was read."""
        return next((found, share) for _, found, share in self.search(np.array([query_id]), q[None, :], k))

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[int, int]], float]]:
        """(place, the (vec_id, score) of the k best, share of the lists read) for each of a batch of queries."""
        n, width = self.x.shape
        z, dims = self._floats(q), np.arange(width)
        slack = width * width * 2.0**-48 if self.inexact else 0
        side = (z > 0).astype(int)
        at = lambda depth: z[: len(depth)] * self.frontier[side[: len(depth)], dims, depth]
        depth = np.zeros(q.shape, int)
        last, far = at(depth), at(np.full(q.shape, self.chunks))
        rest = (last - far).sum(axis=1)
        goal = rest / FIRST
        place, own = np.arange(len(q)), self.ids[None, :] == query_ids[:, None]
        room = n - own.sum(axis=1) <= k  # too few for any to be left out
        for i in np.flatnonzero(room | (rest == 0)):
            yield self._resolved(i, np.flatnonzero(~own[i]), q[i], 0.0, k)
        go = np.flatnonzero(~room & (rest > 0))
        while len(go):
            place, q, z, side, own, depth, last, far, goal = (v[go] for v in (place, q, z, side, own, depth, last, far, goal))
            self._read(z, side, depth, last, far, goal)
            # bounds of every candidate: what was read of it, and the ends of what is left where it wasn't
            of_low, steps = np.arange(self.chunks)[None, :, None], depth[:, None, :]
            read = np.where(side[:, None, :] == 1, of_low >= self.chunks - steps, of_low < steps)
            over = lambda weights, table: (weights[:, None, :] * read).reshape(len(q), -1) @ table.reshape(-1, n)
            got = over(z, self.shown)
            lower = got + (far.sum(axis=1)[:, None] - over(far, self.mark))
            upper = got
            upper += last.sum(axis=1)[:, None] - over(last, self.mark)
            lower[own] = upper[own] = -np.inf
            kth = np.partition(lower, n - k, axis=1)[:, n - k]
            # outsiders share one upper bound, the sum of the last values read; all of them stay while it reaches the k-th lower bound
            may = upper >= (kth - slack)[:, None]
            left = (last - far).sum(axis=1)
            done = (may.sum(axis=1) <= max(4 * k, n // RESOLVED)) | ~(left > 0)
            for i in np.flatnonzero(done):
                yield self._resolved(place[i], np.flatnonzero(may[i]), q[i], depth[i].sum() / (self.chunks * max(1, np.count_nonzero(q[i]))), k)
            goal, go = left / SHRUNK, np.flatnonzero(~done)

    def _read(self, z: np.ndarray, side: np.ndarray, depth: np.ndarray, last: np.ndarray, far: np.ndarray, goal: np.ndarray) -> None:
        """Read chunk by chunk, always of the list whose rest can change a score the most, until all rests together are down to ``goal``."""
        gap = last - far
        while True:
            i = np.flatnonzero((gap.sum(axis=1) > goal) & (gap.max(axis=1) > 0))
            if not len(i):
                return
            d = gap[i].argmax(axis=1)
            depth[i, d] += 1
            last[i, d] = z[i, d] * self.frontier[side[i, d], d, depth[i, d]]
            gap[i, d] = last[i, d] - far[i, d]

    def _resolved(self, place: int, may: np.ndarray, q: np.ndarray, share: float, k: int) -> tuple[int, list[tuple[int, int]], float]:
        """The exact k best of the candidates that are left."""
        score = self.x[may] @ q
        best = sorted(zip((-score).tolist(), self.ids[may].tolist()))[:k]
        return int(place), [(i, int(-s)) for s, i in best], float(share)


def _search(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, int, int]] = []
        if len(candidates) and len(queries):
            sizes = [max((len(v) for v in side["v"]), default=0) for side in (candidates, queries)]
            peaks = [max((float(np.abs(v).max()) for v in side["v"] if len(v)), default=0.0) for side in (candidates, queries)]
            width = max(1, *sizes)
            largest = peaks[0] * peaks[1] * width
            kind = "float32" if largest < 2**22 else "float64" if largest < 2**50 else "object"
            lists = SortedLists(candidates["vec_id"].to_numpy(), _matrix(candidates["v"], width, kind))
            query_ids, q = queries["vec_id"].to_numpy(), _matrix(queries["v"], width, kind)
            for at in range(0, len(q), BATCH):
                for place, found, _ in lists.search(query_ids[at : at + BATCH], q[at : at + BATCH], k):
                    # a score beyond a long still ranks by its true value: here by its place in the group
                    rows += [(query_ids[at + place], i, min(max(s, LEAST), MOST), f"{s:+d}") for i, s in found]
        out = pd.DataFrame(rows, columns=["query_id", "vec_id", "score", "exact"])
        return out.astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for quantized ``vectors``; ``is_query`` picks queries by vec_id."""
    n, n_queries = vectors.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    c_blocks, q_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries = vectors.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("qb"), each(c_blocks).alias("cb"), F.col("vec_id").alias("vec_id"), "v")  # a column of its own on this side
    candidates = vectors.select(F.pmod(F.monotonically_increasing_id(), F.lit(c_blocks)).cast("int").alias("cb"), each(q_blocks).alias("qb"), "vec_id", "v")
    let_workers_import(vectors.sparkSession)
    best = candidates.groupBy("cb", "qb").cogroup(queries.groupBy("cb", "qb")).applyInPandas(_search(k), "query_id long, vec_id long, score long, exact string")
    # beyond a long, whole numbers compare by sign, number of digits and digits
    digits = F.substring("exact", 2, 1 << 20)
    up = F.col("exact").startswith("+")
    beyond = F.when(F.col("score").isin(LEAST, MOST), F.struct(F.when(up, F.length(digits)).otherwise(-F.length(digits)).alias("size"), F.when(up, digits).otherwise(F.translate(digits, "0123456789", "9876543210")).alias("digits")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(beyond), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
