"""Exact top-k search by inner product: columnar branch and bound.

Queries are taken in blocks of at most ``block`` rows, the only thing ever sent to the driver; each block
meets every candidate in one scan without a shuffle. A task holds a batch of candidates dimension by
dimension, adds scores block of dimensions by block, bounds what is left by the product of both sides'
remaining norms, and goes on with the candidates whose bound still reaches the query's k-th best score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .vectors import matrices

DIMENSIONS = 16  # a block
GROUP = 128  # queries whose partial scores are held at once
EXACT = 2.0**53
LAST = 2**63 - 1  # scores beyond it, of either sign, are set to it


class Best:
    """The k best (score, id) of each query so far: higher scores first, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.found = k, [(np.empty(0), np.empty(0, np.int64)) for _ in range(n)]
        self.floor = np.full(n, -np.inf)  # the k-th best score

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.found[q][0], scores]), np.concatenate([self.found[q][1], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.floor[q] = scores[order[-1]]


def remaining(matrix: np.ndarray, axis: int) -> np.ndarray:
    """Norms of what follows each block of dimensions, a little enlarged against rounding."""
    mass = np.add.reduceat(matrix * matrix, np.arange(0, matrix.shape[axis], DIMENSIONS), axis=axis)
    tail = np.flip(np.cumsum(np.flip(mass, axis), axis), axis) - mass
    return np.sqrt(np.maximum(tail, 0)) * (1 + 1e-9)


def scaled(ids: np.ndarray, matrix: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of the rows where it is finite, with their ids."""
    with np.errstate(over="ignore"):
        whole = np.floor(scale * matrix)
    finite = np.isfinite(whole).all(axis=1)
    return ids[finite], whole[finite]


def search(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Add one batch of candidates (rows) to ``best``."""
    width = queries.shape[1]
    # per candidate: whether its scores may be beyond doubles' integers, which are Python's own then
    large = width * np.abs(queries).max(initial=0) * np.abs(candidates).max(axis=1, initial=0) >= EXACT
    if large.any():
        for q, row in enumerate(queries):
            mine = large & (ids != query_ids[q])
            scores = [sum(int(a) * int(b) for a, b in zip(row, c, strict=True)) for c in candidates[mine]]
            best.add(q, np.array([max(-LAST, min(LAST, x)) for x in scores], dtype=object), ids[mine])
        candidates, ids = candidates[~large], ids[~large]
    columns = np.ascontiguousarray(candidates.T)
    q_left, c_left = remaining(queries, 1), remaining(columns, 0)
    starts = range(0, width, DIMENSIONS)
    warm = min(len(ids), 16 * best.k)  # a first floor
    if np.isinf(best.floor).any():
        first = queries @ columns[:, :warm]
        for q in range(len(queries)):
            mine = ids[:warm] != query_ids[q]
            best.add(q, first[q, mine], ids[:warm][mine])
        columns, ids, c_left = columns[:, warm:], ids[warm:], c_left[:, warm:]
    if not len(ids):
        return
    for g in range(0, len(queries), GROUP):
        group = queries[g : g + GROUP]
        floor = best.floor[g : g + GROUP, None]
        partial = np.zeros((len(group), len(ids)))
        for b, d in enumerate(starts):
            partial += group[:, d : d + DIMENSIONS] @ columns[d : d + DIMENSIONS]
            alive = partial + q_left[g : g + GROUP, b, None] * c_left[b][None, :] >= floor
            if alive.mean() < 0.1:
                break
        for i in range(len(group)):
            q = g + i
            at = np.flatnonzero(alive[i])
            scores = partial[i, at]
            for b2 in range(b + 1, len(starts)):
                if not len(at):
                    break
                d = starts[b2]
                scores = scores + group[i, d : d + DIMENSIONS] @ columns[d : d + DIMENSIONS, at]
                keep = scores + q_left[q, b2] * c_left[b2, at] >= best.floor[q]
                at, scores = at[keep], scores[keep]
            mine = ids[at] != query_ids[q]
            if mine.any():
                best.add(q, scores[mine], ids[at][mine])


def top_k(df: DataFrame, is_query, *, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 16384) -> DataFrame:
    """(query_id, rank, id, score): each query's ``k`` best candidates by inner product of floor(scale * x).

    ``is_query`` is a condition on ``id_col``. Candidates are all rows whose id is not the query's own; ties
    go to the smaller id. Vectors that are null, empty or hold null or non-finite components, and rows with
    a null id, take no part. Only vectors of equal length meet. A repeated row is a candidate each time;
    queries with the same id and vector are one. Other columns are not read. With no queries or candidates
    the result is empty. Vectors whose scaled components are not finite take no part; scores beyond a long's
    range are set to its end.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null")
    queries = rows.where(is_query(F.col("id")))
    blocks = max(1, math.ceil(queries.select("id").count() / block))
    parts = []
    for n in range(blocks):
        mine = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n)
        own = pa.table(mine.dropDuplicates().toArrow()).combine_chunks()
        sets = {}
        for batch in own.to_batches():
            for at, matrix in matrices(batch, 1):
                ids, whole = scaled(np.asarray(batch.column(0))[at], matrix, scale)
                sets.setdefault(matrix.shape[1], []).append((ids, whole))
        sets = {w: (np.concatenate([i for i, _ in x]), np.concatenate([m for _, m in x])) for w, x in sets.items()}

        def run(batches: Iterator[pa.RecordBatch], sets=sets) -> Iterator[pa.RecordBatch]:
            best = {w: Best(len(q_ids), k) for w, (q_ids, _) in sets.items()}
            for batch in batches:
                ids = np.asarray(batch.column(0))
                for at, matrix in matrices(batch, 1):
                    if (width := matrix.shape[1]) in sets:
                        q_ids, q = sets[width]
                        own, whole = scaled(ids[at], matrix, scale)
                        search(q, q_ids, whole, own, best[width])
            for w, found in best.items():
                n_each = [len(i) for _, i in found.found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(sets[w][0], n_each), pa.int64()),
                        pa.array(np.concatenate([i for _, i in found.found]) if found.found else [], pa.int64()),
                        pa.array([int(s) for scores, _ in found.found for s in scores], pa.int64()),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

        part = rows.mapInArrow(run, "query_id long, vec_id long, score long")
        parts.append(part if blocks == 1 else materialise(part))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
