"""Operator 10, approximate nearest neighbours in robust-pruned directed graphs.

Rows are dealt by hash to shards, and each shard has a graph. Inner product becomes distance by one more component
that gives all rows the same length. Points are inserted in random order, in batches: a greedy search from the
shard's centre proposes neighbours; pruning keeps the nearest one and drops whatever is nearer to it, by a factor
``alpha``, than to the point, then the next, so edges are diverse; reverse edges are added and pruned when a list
overflows. A query searches every shard with a beam, and the shards' results are merged. Equal vectors share a node,
which stands for all their ids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textvec.llm.shared import stash
from textvec.llm.vector_rows import deal, matrix, once, usable, widen

DEGREE, BEAM, ALPHA, BATCH = 32, 64, 1.2, 256


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest points found for each query, nearest first, and their squared distances; -1 where none."""
    b, norm = len(queries), (points * points).sum(1)
    ids = np.full((b, beam), -1)
    dist = np.full((b, beam), np.inf, np.float32)
    opened = np.ones((b, beam), bool)
    seen = np.zeros((b, len(points)), bool)
    ids[:, 0], opened[:, 0], seen[:, start] = start, False, True
    dist[:, 0] = norm[start] - 2 * queries @ points[start]
    live = np.arange(b)
    while len(live):
        todo = np.where(opened[live], np.inf, dist[live])
        at = todo.argmin(1)
        more = np.isfinite(todo[np.arange(len(live)), at])
        live, at = live[more], at[more]
        if not len(live):
            break
        opened[live, at] = True
        near = graph[ids[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(fresh, near, start)] = True
        d = norm[near] - 2 * np.matmul(points[near], queries[live][:, :, None])[:, :, 0]
        d[~fresh] = np.inf
        all_d = np.concatenate((dist[live], d), 1)
        best = np.argpartition(all_d, beam - 1, 1)[:, :beam]
        rows = np.arange(len(live))[:, None]
        dist[live] = all_d[rows, best]
        ids[live] = np.where(np.isfinite(dist[live]), np.concatenate((ids[live], near), 1)[rows, best], -1)
        opened[live] = np.concatenate((opened[live], ~fresh), 1)[rows, best]
    order = np.argsort(dist, 1, kind="stable")
    rows = np.arange(b)[:, None]
    return ids[rows, order], dist[rows, order]


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each point of ``own`` among its row of ``candidates`` (-1: none)."""
    rows = np.arange(len(own))[:, None]
    candidates = np.sort(candidates, 1)
    bad = (candidates < 0) | (candidates == own[:, None])
    bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
    x = points[candidates]
    diff = x - points[own][:, None, :]
    d = (diff * diff).sum(2)
    d[bad] = np.inf
    norm = (x * x).sum(2)
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
    out = np.full((len(own), degree), -1)
    for n in range(degree):
        at = d.argmin(1)
        some = np.isfinite(d[rows[:, 0], at])
        if not some.any():
            break
        out[some, n] = candidates[rows[:, 0], at][some]
        d[alpha * alpha * between[rows[:, 0], at] <= d] = np.inf
        d[rows[:, 0], at] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """The neighbours of each point (-1: none) and the entry point."""
    n = len(points)
    points = points.astype(np.float32)
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin()) if n else 0
    if n <= degree + 1:
        full = np.tile(np.arange(n), (n, 1))
        return np.where(full == np.arange(n)[:, None], -1, full), start
    rng = np.random.default_rng(7)
    wide = 2 * degree
    graph = np.full((n, wide), -1)
    graph[:, : degree // 2] = rng.integers(0, n, (n, degree // 2))
    filled = np.full(n, degree // 2)
    for factor in (1.0, alpha):
        for own in np.array_split(rng.permutation(n), -(-n // BATCH)):
            found, _ = beam_search(points, graph, start, points[own], beam)
            graph[own] = -1
            graph[own, :degree] = robust_prune(points, own, np.concatenate((found, graph[own]), 1), degree, factor)
            filled[own] = (graph[own] >= 0).sum(1)
            to, back = graph[own, :degree].ravel(), np.repeat(own, degree)
            to, back = to[to >= 0], back[to >= 0]
            order = np.argsort(to, kind="stable")
            to, back = to[order], back[order]
            while len(to):  # one reverse edge for each target at a time
                first = np.concatenate(([True], to[1:] != to[:-1]))
                t, s = to[first], back[first]
                new = ~(graph[t] == s[:, None]).any(1)
                t, s = t[new], s[new]
                full = t[filled[t] >= wide]
                if len(full):
                    graph[full, :degree] = robust_prune(points, full, graph[full], degree, factor)
                    graph[full, degree:] = -1
                    filled[full] = (graph[full] >= 0).sum(1)
                graph[t, filled[t]] = s
                filled[t] += 1
                to, back = to[~first], back[~first]
    for own in np.array_split(np.arange(n), -(-n // BATCH)):
        graph[own, :degree] = robust_prune(points, own, graph[own], degree, alpha)
    return graph[:, :degree], start


def _build(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("vec_id")
    x = matrix(table)
    x = x[:, : max(1, int(np.flatnonzero(x.any(0))[-1]) + 1)] if x.any() else x
    distinct, first, node = np.unique(x, axis=0, return_index=True, return_inverse=True)
    length = (distinct * distinct).sum(1)
    graph, start = build_graph(np.hstack((distinct, np.sqrt(np.maximum(length.max(initial=0) - length, 0))[:, None])))
    return pa.table({
        "shard": pa.array([key[0].as_py()], pa.int32()), "start": pa.array([start], pa.int64()), "dim": pa.array([distinct.shape[1]], pa.int64()), "ids": pa.array([table["vec_id"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
        "node": pa.array([node.ravel().astype(np.int32).tobytes()], pa.binary()), "points": pa.array([distinct.tobytes()], pa.binary()), "graph": pa.array([graph.astype(np.int32).tobytes()], pa.binary()),
    })


def _search(k: int, beam: int) -> Callable:
    def run(key: tuple, queries: pa.Table, index: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(queries) and len(index):
            at = {c: index[c][0].as_py() for c in ("start", "dim", "ids", "node", "points", "graph")}
            ids, node = np.frombuffer(at["ids"], np.int64), np.frombuffer(at["node"], np.int32)
            points, q = widen(np.frombuffer(at["points"]).reshape(-1, at["dim"]), matrix(queries))
            graph = np.frombuffer(at["graph"], np.int32).reshape(len(points), -1)
            order = np.argsort(node, kind="stable")  # ids of a node, smallest first
            begin = np.searchsorted(node[order], np.arange(len(points) + 1))
            length = (points * points).sum(1)
            near = np.hstack((points, np.sqrt(np.maximum(length.max() - length, 0))[:, None])).astype(np.float32)
            for rows in np.array_split(np.arange(len(q)), -(-len(q) // BATCH)):
                found, _ = beam_search(near, graph, at["start"], np.pad(q[rows], ((0, 0), (0, 1))).astype(np.float32), max(beam, 2 * k))
                for i, nodes in zip(rows, found):
                    nodes = nodes[nodes >= 0]
                    scores = (points[nodes] * q[i]).sum(1)
                    own, mine = queries["vec_id"][int(i)].as_py(), []
                    for s, x in zip(scores.tolist(), nodes.tolist()):
                        mine += [(own, v, s) for v in ids[order[begin[x] : min(begin[x + 1], begin[x] + k + 1)]].tolist() if v != own]
                    out += sorted(mine, key=lambda r: (-r[2], r[1]))[:k]
        cols = list(zip(*out)) or [[], [], []]
        return pa.table({"query_id": pa.array(list(cols[0]), pa.int64()), "vec_id": pa.array(list(cols[1]), pa.int64()), "score": pa.array(list(cols[2]), pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 4096, query_rows: int = 4096, beam: int = BEAM) -> DataFrame:
    """The ``k`` nearest rows found for each query, its own id left out, by inner product: query_id, rank, vec_id, score.

    Null, empty, zero and non-finite vectors, and null ids, take no part; shorter vectors count as if they ended in
    zeros. Scores are exact. Ties go to smaller ids. A query id that repeats is asked once, with its smallest vector; rows of one id and vector
    that repeat are ranked as often as they occur. Every row is indexed; other columns are ignored."""
    some = F.exists("v", lambda x: x != 0)
    rows, asked, parts = deal(usable(vectors, id_col, vector_col).where(some), once(usable(queries, id_col, vector_col).where(some)), shard_rows, query_rows)
    index = rows.groupBy("shard").applyInArrow(_build, "shard int, start long, dim long, ids binary, node binary, points binary, graph binary")
    index = stash(index, "graphs").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = asked.groupBy("shard", "part").cogroup(index.groupBy("shard", "part")).applyInArrow(_search(k, beam), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
