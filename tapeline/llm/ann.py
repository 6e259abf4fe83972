"""Nearest neighbours by collision counting (query-aware hashing).

Rows are dealt into blocks of about ``BLOCK_ROWS``. A block's index is ``PROJECTIONS`` random
projections of its unit vectors, each kept as one sorted array. A query opens a window around its
own projection in every array and counts how often each vector falls into one; vectors with
at least ``COLLISIONS`` of them are verified on the original vectors. The windows then widen by the
factor ``WIDEN`` (virtual rehashing: no new hash, the same arrays) until the k-th best verified
distance is within the current radius. There is no limit on candidates.

Queries are a stated set, sent to every block; each block answers with its k best and these are
merged by query. Equal vectors of a block are indexed once with their k + 1 smallest ids, which
is all that an answer can name, so that copies by the thousand cost nothing.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite values take no
part; vectors of another length than the query's are no candidates; of rows with equal ``vec_id``
the smallest vector counts; equal scores go to the smaller id; other columns are ignored whatever their
names; an empty table, or one without a query, gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
BLOCK_ROWS = 4096
PROJECTIONS = 40
COLLISIONS = 26
BUCKET = 2.7
START, WIDEN = 0.2, 1.3
SEED = 20


def valid(embedding: str = "embedding") -> Column:
    """Whether a vector takes part."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


class BlockIndex:
    """Distinct vectors of one length with their ids, and a sorted array per projection."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        distinct, inverse = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, inverse.ravel()))
        groups = np.split(ids[order], np.flatnonzero(np.diff(inverse.ravel()[order])) + 1)
        self.k, self.ids = k, [g[: k + 1] for g in groups]
        self.vectors = distinct.astype(np.float64)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.lines = np.random.default_rng(SEED).standard_normal((PROJECTIONS, vectors.shape[1]))
        values = self.lines @ (self.vectors / self.norms[:, None]).T
        self.order = np.argsort(values, axis=1).astype(np.int32)
        # The sorted arrays lie end to end, each shifted beyond the one before, so that one search looks into all.
        self.shift = np.arange(PROJECTIONS) * (4 * float(np.abs(values).max()) + 100)
        self.sorted = (np.take_along_axis(values, self.order, axis=1) + self.shift[:, None]).ravel()
        self.order = self.order.ravel()
        self.start = self._usual_distance()

    def _usual_distance(self) -> float:
        """Two steps below the median k-th distance of a few members: where widening begins."""
        few = np.linspace(0, len(self.norms) - 1, min(8, len(self.norms))).astype(int)
        unit = self.vectors / self.norms[:, None]
        cos = np.sort(unit[few] @ unit.T, axis=1)[:, ::-1]
        far = np.sqrt(np.maximum(2 - 2 * cos[:, min(self.k, cos.shape[1] - 1)], 0))
        return max(START, float(np.median(far)) / WIDEN**2)

    def nearest(self, own: int, query: np.ndarray) -> list[tuple[int, float]]:
        """The k best (id, cosine) for a query, without the id ``own``."""
        q = query.astype(np.float64)
        norm = np.sqrt((q * q).sum())
        at = self.lines @ (q / norm)
        n = len(self.norms)
        at = at + self.shift
        floor = np.arange(PROJECTIONS) * n
        low = high = np.clip(np.searchsorted(self.sorted, at), floor, floor + n)
        counts, score = np.zeros(n, np.int64), np.full(n, -np.inf)
        radius = self.start
        while True:
            half = BUCKET * radius / 2
            a = np.minimum(np.clip(np.searchsorted(self.sorted, at - half), floor, floor + n), low)
            b = np.maximum(np.clip(np.searchsorted(self.sorted, at + half, side="right"), floor, floor + n), high)
            pieces = [self.order[i:j] for i, j in zip([*a, *high], [*low, *b])]
            low, high = a, b
            counts += np.bincount(np.concatenate(pieces), minlength=n)
            fresh = np.flatnonzero((counts >= COLLISIONS) & (score == -np.inf))
            if len(fresh):
                score[fresh] = (self.vectors[fresh] * q).sum(1) / (self.norms[fresh] * norm)
            found, kth = self._best(own, score)
            # On unit vectors the squared distance is 2 - 2 cos; a radius of 2 reaches every vector.
            if len(found) == self.k and 2 - 2 * kth <= radius * radius:
                return found
            if radius >= 2:
                # Few vectors, or far ones: the rest is verified as well.
                score = (self.vectors * q).sum(1) / (self.norms * norm)
                return self._best(own, score)[0]
            radius *= WIDEN

    def _best(self, own: int, score: np.ndarray) -> tuple[list[tuple[int, float]], float]:
        top = np.argsort(-score, kind="stable")[: self.k + 1]
        least = score[top[-1]]
        if least > -np.inf and len(top) > self.k:
            top = np.flatnonzero(score >= least)  # ties with the last one
        rows = [(-score[u], int(i)) for u in top if score[u] > -np.inf for i in self.ids[u] if i != own]
        rows.sort()
        best = [(i, -s) for s, i in rows[: self.k]]
        return best, best[-1][1] if best else -np.inf


def _search(k: int):
    """Rows come sorted by block, then indexed vectors before queries."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, ready, answers = None, [], {}, {}
        for frame in frames:
            out = []
            for b, role, i, v in zip(frame["block"], frame["role"], frame["vec_id"], frame["embedding"]):
                if b != block:
                    block, held, ready, answers = b, [], {}, {}
                if role == 0:
                    held.append((i, v))
                    continue
                if not ready:
                    sizes: dict[int, list] = {}
                    for pair in held:
                        sizes.setdefault(len(pair[1]), []).append(pair)
                    ready = {d: BlockIndex(np.array([p[0] for p in own]), np.array([p[1] for p in own]), k) for d, own in sizes.items()}
                    ready[0], held = None, []
                index = ready.get(len(v))
                if index is None:
                    continue
                key = v.tobytes()
                if key not in answers:
                    # One place more than asked for, so that equal queries can each leave themselves out.
                    answers[key] = BlockAnswer(index, v)
                out += [(i, j, s) for j, s in answers[key].without(i)]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


class BlockAnswer:
    """Answers of one block for equal query vectors."""

    def __init__(self, index: BlockIndex, query: np.ndarray):
        self.index, self.query = index, query
        self.common = None

    def without(self, own: int) -> list[tuple[int, float]]:
        """The answer for the query with this id; only ids named in the common answer need a search of their own."""
        if self.common is None:
            self.common = self.index.nearest(-1, self.query)
        if own not in {i for i, _ in self.common}:
            return self.common
        return self.index.nearest(own, self.query)


def nearest(vectors: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest of all other rows for the rows in ``queries``."""
    rows = vectors.where(F.col("vec_id").isNotNull() & valid()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    total, distinct = rows.agg(F.count("*"), F.countDistinct("vec_id")).first()
    if total != distinct:
        rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, math.ceil(distinct / BLOCK_ROWS))
    indexed = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("role"), "vec_id", "embedding")
    asked = rows.where(queries).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("role"), "vec_id", "embedding")
    dealt = indexed.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "role", "vec_id")
    found = dealt.mapInPandas(_search(k), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark, sf_dir: str) -> DataFrame:
    """Every fiftieth vector of ``embeddings`` against all others."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
