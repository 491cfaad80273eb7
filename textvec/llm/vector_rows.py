"""Vectors that take part in a search, and the dealing of queries and rows to tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of rows whose vector is not null and holds neither null nor non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def once(queries: DataFrame) -> DataFrame:
    """One row for each id, with the smallest vector."""
    return queries.groupBy("vec_id").agg(F.min("v").alias("v"))


def deal(rows: DataFrame, queries: DataFrame, shard_rows: int, query_rows: int, spread: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """Give each row a ``shard``, each query every shard and a query block ``part``; also the number of blocks.

    With ``spread``, there are as many shards as cores if each has as many rows as that."""
    n = rows.count()
    shards = max(1, -(-n // shard_rows), min(rows.sparkSession.sparkContext.defaultParallelism, n // spread) if spread else 0)
    parts = max(1, -(-queries.count() // query_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    return rows, queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))), parts


def matrix(table: pa.Table, column: str = "v") -> np.ndarray:
    """The vectors of a column; shorter ones end in zeros."""
    col = table[column].combine_chunks()
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    wide = int(sizes.max(initial=1))
    if len(sizes) and sizes.min() == wide:
        return flat.reshape(len(sizes), wide).astype(np.float64)
    out = np.zeros((len(sizes), wide))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])] = flat
    return out


def widen(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with as many columns as the wider one."""
    n = max(a.shape[1], b.shape[1])
    return np.pad(a, ((0, 0), (0, n - a.shape[1]))), np.pad(b, ((0, 0), (0, n - b.shape[1])))
