"""Runs of consecutive numbers, and checks of order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers in one block; no task of the first steps holds more of one key.
BLOCK = 4096


def coalesce_ranges(numbers: DataFrame, col: str, block: int = BLOCK, steps: int = 2) -> DataFrame:
    """lo, hi of each maximal run of consecutive integers; nulls take no part and repeats count once.

    Runs are found within blocks of ``block`` numbers. Full blocks are numbers themselves, so their runs are found the
    same way, ``steps`` deep; what is left then, one number for ``block ** steps`` rows, is ordered in one window. A run
    is at most a tail, a run of full blocks and a head, which joins put together."""
    n = numbers.select(F.col(col).cast("long").alias("n")).where("n is not null").distinct()
    if not steps:
        return _runs(n, Window.orderBy("n"), F.lit(0))
    block_of = lambda x: F.expr(f"({x} - pmod({x}, {block}L)) div {block}L")
    runs = _runs(n.withColumn("at", block_of("n")), Window.partitionBy("at").orderBy("n"), F.col("at"))
    full = F.col("hi") - F.col("lo") == block - 1
    whole = coalesce_ranges(runs.where(full).select(block_of("lo").alias("n")), "n", block, steps - 1)
    pieces = runs.where(~full).unionByName(whole.select((F.col("lo") * block).alias("lo"), (F.col("hi") * block + block - 1).alias("hi")))
    out = pieces.join(pieces.select((F.col("hi") + 1).alias("lo")), "lo", "left_anti")  # those that begin a run
    for _ in range(2):
        after = pieces.select((F.col("lo") - 1).alias("hi"), F.col("hi").alias("next"))
        out = out.join(after, "hi", "left").select("lo", F.coalesce("next", "hi").alias("hi"))
    return out


def _runs(n: DataFrame, order: Window, key) -> DataFrame:
    island = n.select(key.alias("key"), "n", (F.col("n") - F.row_number().over(order)).alias("island"))
    return island.groupBy("key", "island").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).select("lo", "hi")


def unsorted_neighbours(rows: DataFrame, position: str, value: str) -> DataFrame:
    """position, value, next of the rows at ``position`` that do not come strictly before the row at ``position`` + 1.

    Neighbours meet by an equi-join on the position, so no task sees the whole order. Nulls are never in order."""
    a = rows.select(F.col(position).alias("position"), F.col(value).alias("value"))
    b = rows.select((F.col(position) - 1).alias("position"), F.col(value).alias("next"))
    return a.join(b, "position").where(~F.coalesce(F.col("value") < F.col("next"), F.lit(False)))
