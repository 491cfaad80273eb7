"""Operator 2, exact top-k search, block at a time.

Components are terms with integer weights. A shard's rows are put in an order in which similar rows are close and
cut into ranges; a block keeps each term's largest and smallest weight and a forward index, the rows themselves. A
query sums, over its terms, its weight times the largest weight (the smallest, where its own is negative): no row
of the block scores more. Blocks are taken by falling bound and scored from the forward index until the next bound
is below the kth score so far. Shards are independent; their best k are merged by rank."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textvec.llm.vector_rows import deal, matrix, once, usable, widen

#: Rows of a block; rows below which a shard is not split for the sake of more cores.
BLOCK, SPREAD = 64, 1024


class Blocks:
    """A shard as document-range blocks."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, block: int = BLOCK):
        lead = np.abs(rows).argmax(1) if rows.size else np.zeros(len(rows), np.int64)
        order = np.lexsort((ids, -rows[np.arange(len(rows)), lead], lead))
        self.ids, self.rows, self.starts = ids[order], rows[order], np.arange(0, len(rows), block)
        self.high, self.low = np.maximum.reduceat(self.rows, self.starts), np.minimum.reduceat(self.rows, self.starts)
        self.ends = np.minimum(self.starts + block, len(rows))
        self.doubles, self.most = self.rows.astype(np.float64), float(np.abs(self.rows).max(initial=0)) * self.rows.shape[1]

    def top(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, vec_id) for one query, ties to smaller ids."""
        scores, ids, last = np.empty(0, np.int64), np.empty(0, np.int64), None
        exact = self.most * float(np.abs(query).max(initial=0)) < 2**52  # no double rounds
        index, query = (self.doubles, query.astype(np.float64)) if exact else (self.rows, query)
        for b in np.argsort(-bounds, kind="stable"):
            if last is not None and bounds[b] < last:
                break
            part = slice(self.starts[b], self.ends[b])
            own = self.ids[part] != query_id
            scores = np.concatenate((scores, (index[part] @ query).astype(np.int64)[own]))
            ids = np.concatenate((ids, self.ids[part][own]))
            best = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[best], ids[best]
            last = scores[-1] if len(scores) == k else None
        return list(zip(scores.tolist(), ids.tolist()))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return _product(np.maximum(queries, 0), self.high.T) + _product(np.minimum(queries, 0), self.low.T)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: through doubles where they cannot round, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if most < 2**52 else a @ b


def _search(k: int) -> Callable:
    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if len(queries) and len(rows):
            q, x = widen(matrix(queries), matrix(rows))
            q, x = np.floor(q * 1024).astype(np.int64), np.floor(x * 1024).astype(np.int64)
            blocks = Blocks(rows["vec_id"].to_numpy(), x)
            asked = queries["vec_id"].to_pylist()
            for at in range(0, len(q), 256):
                for i, bounds in enumerate(blocks.bounds(q[at : at + 256]), at):
                    out += [(asked[i], vec_id, score) for score, vec_id in blocks.top(asked[i], q[i], bounds, k)]
        cols = list(zip(*out)) or [[], [], []]
        return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols)})

    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 32768, query_rows: int = 32768) -> DataFrame:
    """The ``k`` largest integer inner products of each query with all rows but its own id: query_id, rank, vec_id, score.

    A component x is floor(1024 x). Null and non-finite vectors, and null ids, take no part; shorter vectors, empty ones
    too, count as if they ended in zeros. A query id that repeats is asked once, with its smallest vector; rows that
    repeat are ranked as often as they occur. Products must fit 64 bits. Other columns are ignored.

    Each query meets each shard and each row each block of queries, so what is shuffled falls with ``shard_rows`` and
    ``query_rows``; a task holds that many vectors. A table too small for that is dealt to all cores."""
    rows, asked, parts = deal(usable(vectors, id_col, vector_col), once(usable(queries, id_col, vector_col)), shard_rows, query_rows, SPREAD)
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = asked.groupBy("shard", "part").cogroup(rows.groupBy("shard", "part")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
