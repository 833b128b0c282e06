"""Approximate nearest neighbours: robust-pruned directed graphs, one a shard, searched by beams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.llm.vectors import finite, one_length, search

DEGREE, BUILD_BEAM, ALPHA, STEP = 24, 48, 1.2, 4
_BATCH = 512


def beam_search(x: np.ndarray, graph: np.ndarray, start: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the `width` rows of largest inner product met on the way, best first (-1: none)."""
    n = len(x)
    ids = np.full((len(q), width), -1, np.int64)
    sims = np.full((len(q), width), -np.inf, np.float32)
    done = np.ones((len(q), width), bool)
    seen = np.zeros((len(q), n), bool)
    first = start[:width]
    ids[:, : len(first)], done[:, : len(first)] = first, False
    sims[:, : len(first)] = q @ x[first].T
    seen[:, first] = True
    active = np.arange(len(q))
    while len(active):
        open_ = ~done[active]
        chosen = open_ & (np.cumsum(open_, axis=1) <= STEP)
        order = np.argsort(~chosen, axis=1, kind="stable")[:, :STEP]
        picked = np.take_along_axis(ids[active], order, 1)
        picked[~np.take_along_axis(chosen, order, 1)] = -1
        done[active] |= chosen
        near = np.where(picked[:, :, None] >= 0, graph[picked], -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[(near >= 0) & seen[active[:, None], near]] = -1
        real = near >= 0
        at = np.nonzero(real)
        seen[active[at[0]], near[at]] = True
        found = np.full(near.shape, -np.inf, np.float32)
        found[at] = np.einsum("ij,ij->i", q[active[at[0]]], x[near[at]])
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_sims = np.concatenate([sims[active], found], axis=1)
        all_done = np.concatenate([done[active], ~real], axis=1)
        best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(all_sims, best, 1), axis=1, kind="stable"), 1)
        ids[active], sims[active] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
        done[active] = np.take_along_axis(all_done, best, 1)
        active = active[~done[active].all(axis=1)]
    return ids, sims


def robust_prune(x: np.ndarray, square: float, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node the nearest candidate, then the nearest that no kept one is clearly closer to, and so on.

    All rows of x have the same squared length, so the squared distance is twice what its product lacks of it.
    """
    rows = np.arange(len(nodes))
    others = x[candidates]
    to_node = 2 * (square - np.einsum("bcd,bd->bc", others, x[nodes]))
    alive = (candidates >= 0) & (candidates != nodes[:, None])
    out = np.full((len(nodes), degree), -1, np.int64)
    for slot in range(degree):
        if not alive.any():
            break
        best = np.where(alive, to_node, np.inf).argmin(axis=1)
        some = alive[rows, best]
        out[some, slot] = candidates[rows, best][some]
        between = 2 * (square - np.einsum("bcd,bd->bc", others, others[rows, best]))
        alive &= ~((alpha**2 * between <= to_node) & some[:, None])
        alive[rows, best] = False
    return out


def build_graph(
    x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 1
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows lifted to one length, so that the largest product is the least distance; their graph; where searches begin."""
    norms = (x**2).sum(axis=1)
    square = float(norms.max(initial=1e-12)) * (1 + 1e-6)
    lifted = np.c_[x, np.sqrt(np.maximum(square - norms, 0))].astype(np.float32)
    n = len(x)
    order = np.random.default_rng(seed).permutation(n)
    middle = int((lifted @ lifted.mean(axis=0)).argmax())
    order = np.r_[middle, order[order != middle]]
    start = order[:1]
    graph = np.full((n, 3 * degree), -1, np.int64)
    at = 0
    while at < n:
        batch = order[at : at + min(_BATCH, max(16, at))]
        if at < 2 * beam:
            known = order[: at + len(batch)]
            near = np.broadcast_to(known, (len(batch), len(known)))
        else:
            near, _ = beam_search(lifted, graph, start, lifted[batch], beam)
        own = graph[batch]
        near = np.concatenate([near, own], axis=1) if (own >= 0).any() else near
        kept = robust_prune(lifted, square, batch, near, degree, alpha)
        graph[batch] = -1
        graph[batch, :degree] = kept
        _add_reverse(lifted, square, graph, batch, kept, degree, alpha)
        at += len(batch)
    full = np.flatnonzero((graph[:, degree:] >= 0).any(axis=1))
    for part in np.array_split(full, max(1, len(full) // _BATCH)):
        if len(part):
            kept = robust_prune(lifted, square, part, graph[part], degree, alpha)
            graph[part] = -1
            graph[part, :degree] = kept
    return lifted, graph[:, :degree], start


def _add_reverse(x, square, graph, nodes, kept, degree, alpha) -> None:
    rows, slots = np.nonzero(kept >= 0)
    target, source = kept[rows, slots], nodes[rows]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    while len(target):
        heads = np.r_[True, target[1:] != target[:-1]]
        place = np.arange(len(target)) - np.maximum.accumulate(np.where(heads, np.arange(len(target)), 0))
        taken = (graph >= 0).sum(axis=1)[target] if len(target) * 4 > len(graph) else (graph[target] >= 0).sum(axis=1)
        slot = taken + place
        fits = slot < graph.shape[1]
        graph[target[fits], slot[fits]] = source[fits]
        target, source = target[~fits], source[~fits]
        full = np.unique(target)
        for part in np.array_split(full, max(1, len(full) // _BATCH)):
            if len(part):
                pruned = robust_prune(x, square, part, graph[part], degree, alpha)
                graph[part] = -1
                graph[part, :degree] = pruned


def _build(v: np.ndarray, least: np.ndarray) -> dict[str, np.ndarray]:
    lifted, graph, start = build_graph(v)
    return {"v": v, "least": least, "lifted": lifted, "graph": graph.astype(np.int32), "start": start}


def _answer(beam: int):
    def answer(index: dict[str, np.ndarray], q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = []
        width = max(beam, k)
        for at in range(0, len(q), _BATCH):
            part = q[at : at + _BATCH]
            lifted = np.c_[part, np.zeros(len(part))].astype(np.float32)
            ids, _ = beam_search(index["lifted"], index["graph"].astype(np.int64), index["start"], lifted, width)
            exact = np.where(ids >= 0, (index["v"][ids] * part[:, None, :]).sum(axis=2), -np.inf)
            order = np.lexsort((index["least"][ids], -exact), axis=1)[:, :k]
            ids, exact = np.take_along_axis(ids, order, 1), np.take_along_axis(exact, order, 1)
            rows, places = np.nonzero(ids >= 0)
            out.append((rows + at, ids[rows, places], exact[rows, places]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    return answer


def nearest(
    vectors: DataFrame,
    is_query: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = 20,
    beam: int = 96,
    shard_rows: int = 8192,
) -> DataFrame:
    """For every query row the k rows of largest inner product that beam searches find: query_id, rank, vec_id, score.

    `is_query` is a condition on a column `id`. Every row is in the graph of its shard; a query
    searches all shards. Scores are exact products in double precision, ties go to the smaller id; rows are told
    apart by id, so a repeated row counts once. Null and zero vectors, those
    with null or non-finite components, of another length than most, or with a
    null id take no part. An empty table gives an empty result; other columns are not read.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    return search(one_length(rows), is_query, k, _build, _answer(beam), float, shard_rows)
