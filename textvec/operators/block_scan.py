"""The best rows of many queries by dot product or cosine, as products of matrices.

Rows are packed into matrices, each meets the queries of a block, and a task keeps each query's best rows so far. A product of
matrices gives an upper bound of every score, rounding included; only pairs whose bound reaches the query's kth score are
scored, in the order of operations of the Columns of ``search``. So scores are the same to the last bit, and ranks do not
depend on how rows are dealt."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a packed matrix; queries that are scored at once; the largest k: a task keeps k rows for each query of its block.
ROWS, QUERIES, MOST = 8192, 256, 1000
PACKED = "dim int, ids binary, known binary, cells binary"


def _matrices(vectors: pa.Array, spoilt: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(components, positions, matrix) for each number of components, without null vectors and, unless ``spoilt``, those that hold null or NaN."""
    at = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    vectors = vectors.take(pa.array(at))
    sizes = np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    cells, starts = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == dim)
        rows = cells[starts[own][:, None] + np.arange(dim)]
        fine = np.full(len(own), True) if spoilt else ~np.isnan(rows).any(1)
        yield dim, at[own[fine]], rows[fine]


def _pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        ids = part.column("row_id")
        known, numbers = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        for dim, at, rows in _matrices(part.column("v")):
            for i in range(0, len(at), ROWS):
                cut = at[i : i + ROWS]
                cells = (numbers[cut].tobytes(), known[cut].tobytes(), rows[i : i + ROWS].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], ["dim", "ids", "known", "cells"])


class Side:
    """Vectors with their squares, and what bounds their products; a NaN bound says that the pair is to be scored."""

    def __init__(self, rows: np.ndarray, metric: str):
        self.parts, dim = np.ascontiguousarray(rows.T), rows.shape[1]
        self.square = np.zeros(len(rows))
        with np.errstate(all="ignore"):
            for x in self.parts:
                self.square += x * x
            self.length = np.sqrt(self.square)
            bounds, slack = rows, self.length
            if metric == "cosine":
                some = self.square > 0
                bounds, slack = np.where(some[:, None], rows / self.length[:, None], 0.0), some.astype(np.float64)
            odd = ~((self.square > 1e-200) & (self.square < 1e200)) & (rows != 0).any(1)
        self.bounds = np.where(odd[:, None], np.nan, np.column_stack((bounds, slack)))
        #: Of the product of two lengths; several times what both ways of summing can round.
        self.error = 8 * (dim + 8) * np.finfo(np.float64).eps


class Best:
    """The k best rows of some queries so far."""

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.side, self.k, self.metric, self.count = Side(queries, metric), k, metric, len(queries)
        self.query, self.row, self.known, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0)
        self.last = np.full(self.count, -np.inf)  # the kth score, once there are k
        self.asked = self.side.bounds.copy()
        self.asked[:, -1] *= self.side.error

    def meet(self, ids: np.ndarray, known: np.ndarray, rows: Side) -> None:
        with np.errstate(all="ignore"):
            high, last = self.asked @ rows.bounds.T, self.last
            if len(ids) >= self.k and np.isneginf(last).any():
                low = high - 2 * np.outer(self.asked[:, -1], rows.bounds[:, -1])
                low[np.isnan(low)] = -np.inf
                last = np.maximum(last, np.partition(low, -self.k, axis=1)[:, -self.k])
            q, r = np.nonzero(~(high < last[:, None]))
            score = np.zeros(len(q))
            for a, b in zip(self.side.parts, rows.parts):
                score += a[q] * b[r]
            if self.metric == "cosine":
                both = self.side.square[q] * rows.square[r]
                both = np.where((both > 1e-290) & (both < np.inf), np.sqrt(both), self.side.length[q] * rows.length[r])
                score = np.where(rows.square[r] > 0, score / both, 0.0)
            fine = score > -np.inf  # nor NaN
        q, r, score = q[fine], r[fine], score[fine]
        self.query, self.row, self.known, self.score = (np.concatenate(x) for x in ((self.query, q), (self.row, ids[r]), (self.known, known[r]), (self.score, score)))
        self._cut()

    def _cut(self) -> None:
        """Highest scores first, ties to smaller ids, null before all."""
        order = np.lexsort((self.row, self.known, -self.score, self.query))
        sizes = np.bincount(self.query, minlength=self.count)
        starts = np.cumsum(sizes) - sizes
        order = order[np.arange(len(order)) - np.repeat(starts, sizes) < self.k]
        self.query, self.row, self.known, self.score = self.query[order], self.row[order], self.known[order], self.score[order]
        sizes = np.minimum(sizes, self.k)
        full = sizes == self.k
        self.last[full] = self.score[np.cumsum(sizes)[full] - 1]


def _scan(k: int, metric: str) -> Callable:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[pa.Array, list[Best]]] = {}
        for part in parts:
            asked = part.column("asked")
            for i, dim in enumerate(part.column("dim").to_pylist()):
                if dim not in found:  # a task has one block of queries
                    own = asked.slice(i, 1).flatten()
                    _, at, rows = next(_matrices(own.field("q"), metric == "cosine"))  # a query with NaN has 0 with zero rows
                    found[dim] = own.field("query_id").take(pa.array(at)), [Best(rows[j : j + QUERIES], k, metric) for j in range(0, len(rows), QUERIES)]
                ids, known, cells = (np.frombuffer(part.column(n)[i].as_buffer(), t) for n, t in (("ids", np.int64), ("known", bool), ("cells", np.float64)))
                side = Side(cells.reshape(len(ids), dim), metric)
                for best in found[dim][1]:
                    best.meet(ids, known, side)
        for ids, bests in found.values():
            for j, best in enumerate(bests):
                cols = [ids.take(pa.array(j * QUERIES + best.query)), pa.array(best.row, mask=~best.known), pa.array(best.score)]
                yield pa.RecordBatch.from_arrays(cols, ["query_id", "row_id", "score"])

    return run


def best_rows(rows: DataFrame, block: DataFrame, k: int, metric: str) -> DataFrame:
    """query_id, row_id, score: of each task of ``rows`` (row_id, v), the ``k`` best for each query (query_id, q) of a block that can be broadcast."""
    packed = rows.select(F.col("row_id").cast("long"), F.col("v").cast("array<double>")).mapInArrow(_pack, PACKED)
    asked = block.select("query_id", F.col("q").cast("array<double>")).groupBy(F.size("q").alias("dim")).agg(F.collect_list(F.struct("query_id", "q")).alias("asked"))
    pairs = packed.join(F.broadcast(asked), "dim")
    kinds = block.schema["query_id"].dataType.simpleString(), rows.schema["row_id"].dataType
    return pairs.mapInArrow(_scan(k, metric), f"query_id {kinds[0]}, row_id long, score double").withColumn("row_id", F.col("row_id").cast(kinds[1]))
