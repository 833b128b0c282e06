"""Exact top-k by an impact-ordered index, a score at a time, with proof before stopping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.llm.vectors import finite, one_length, search

#: Impact levels a dimension, rounds a query's segments are cut into, share of rows worth rescoring at once.
LEVELS, ROUNDS, RESCORED = 32, 12, 0.02


def build_index(v: np.ndarray, least: np.ndarray) -> dict[str, np.ndarray]:
    """Posting segments: for each dimension and quantised value the rows that have it, with its least and largest value."""
    shift = max(0, int(np.abs(v).max(initial=0)).bit_length() + 1 - LEVELS.bit_length() + 1)
    level = v >> shift
    dims = v.shape[1]
    rows, starts, low, high, dim = [], [0], [], [], []
    for d in range(dims):
        order = np.lexsort((np.arange(len(v)), level[:, d]))
        cut = np.flatnonzero(np.diff(level[order, d])) + 1
        for part in np.split(order, cut):
            rows.append(part)
            starts.append(starts[-1] + len(part))
            low.append(v[part, d].min())
            high.append(v[part, d].max())
            dim.append(d)
    return {
        "v": v,
        "least": least,
        "rows": np.concatenate(rows).astype(np.int32),
        "starts": np.array(starts),
        "low": np.array(low),
        "high": np.array(high),
        "dim": np.array(dim),
    }


def top(index: dict[str, np.ndarray], q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and exact products of the k best, ties to the smaller least id.

    A segment's impact is the most that its values can add to the product. Segments
    go by how far their impact lies above the smallest of their dimension. After
    each round no row can lie above what it has gathered plus, for every dimension
    it was not met in, the gain of the next segment. Once few enough rows can
    still reach the k-th best known product, those are rescored and all others are
    proven out.
    """
    v, starts, dim = index["v"], index["starts"], index["dim"]
    n, dims = v.shape
    if n <= k:
        members = np.arange(n)
        return _best(index, members, v @ q, k)
    impact = np.maximum(q[dim] * index["low"], q[dim] * index["high"])
    floor = np.full(dims, np.iinfo(np.int64).max)
    np.minimum.at(floor, dim, impact)
    gain = impact - floor[dim]
    order = np.argsort(-gain, kind="stable")
    ends = np.cumsum((starts[1:] - starts[:-1])[order])
    base, gathered, met = int(floor.sum()), np.zeros(n), np.zeros(n, np.int64)
    known = -np.inf
    at = 0
    for turn in range(1, ROUNDS + 1):
        stop = len(order) if turn == ROUNDS else max(at + 1, int(np.searchsorted(ends, ends[-1] * turn / ROUNDS)))
        part = order[at:stop]
        rows = np.concatenate([index["rows"][starts[s] : starts[s + 1]] for s in part] or [np.zeros(0, np.int32)])
        sizes = starts[part + 1] - starts[part]
        gathered += np.bincount(rows, np.repeat(gain[part], sizes).astype(float), n)
        met += np.bincount(rows, minlength=n)
        at = stop
        left = int(gain[order[at]]) if at < len(order) else 0
        if turn < 3:
            continue
        most = base + gathered + (dims - met) * left
        leaders = np.argpartition(-most, k - 1)[:k]
        known = max(known, (v[leaders] @ q).min())
        members = np.flatnonzero(most >= known)
        if at == len(order) or len(members) <= max(4 * k, RESCORED * n):
            return _best(index, members, v[members] @ q, k)
    raise AssertionError("the last round always ends")


def _best(index, members, scores, k) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((index["least"][members], -scores))[:k]
    return members[order], scores[order]


def _answer(index: dict[str, np.ndarray], q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [top(index, one, k) for one in q]
    numbers = np.repeat(np.arange(len(q)), [len(rows) for rows, _ in found])
    return numbers, np.concatenate([r for r, _ in found]), np.concatenate([s for _, s in found])


def exact_top(
    vectors: DataFrame,
    is_query: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = 5,
    scale: int = 256,
    shard_rows: int = 8192,
) -> DataFrame:
    """For every query row the k rows of largest inner product of floor(scale * x): query_id, rank, vec_id, score.

    `is_query` is a condition on a column `id`. The result is exact, ties go to the smaller id; rows are told apart by
    id, so a repeated row counts once. Null vectors, those with null or
    non-finite components, of another length than most, or with a null id take
    no part; zero vectors do. Products must fit a long. An empty table gives an
    empty result; other columns are not read.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & finite(F.col("v")))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))
    return search(one_length(rows), is_query, k, build_index, _answer, int, shard_rows)
