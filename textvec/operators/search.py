"""Exhaustive vector search by dot product, cosine or a distance, for one query or many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from textvec.errors import InvalidOption
from textvec.operators import block_scan

#: Queries in one block of a batched search; the broadcast is bounded by it.
BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def square(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(square(a))


def l2_normalize(a: Column) -> Column:
    """At length one; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    """0 against a zero row, NaN against a row with NaN."""
    n = square(b)
    return F.when(n > 0, dot(a, b) / F.sqrt(square(a) * n)).when(n == 0, F.lit(0.0)).otherwise(F.lit(float("nan")))


def _differences(a: Column, b: Column, of) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: of(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_differences(a, b, lambda x: x * x))


def manhattan(a: Column, b: Column) -> Column:
    return _differences(a, b, F.abs)


def with_norms(rows: DataFrame, vector_col: str = "vec", norm_col: str = "norm") -> DataFrame:
    """``rows`` with the length of each vector, to be written with them, so that cosine searches need not find it again."""
    return rows.withColumn(norm_col, norm(F.col(vector_col)))


#: Distances rank by their negative, so that a higher score is a nearer row throughout.
SCORES = {"dot": dot, "cosine": cosine, "euclidean": lambda a, b: -euclidean(a, b), "manhattan": lambda a, b: -manhattan(a, b)}


def _score(a: Column, b: Column, metric: str, length: Column | None = None) -> Column:
    """``length``: the stored norm of ``b``, if there is one."""
    if metric not in SCORES:
        raise InvalidOption(f"metric must be one of {sorted(SCORES)}, not {metric!r}")
    if metric != "cosine" or length is None:
        return SCORES[metric](a, b)
    return F.when(length > 0, dot(a, b) / (norm(a) * length)).when(length == 0, F.lit(0.0)).otherwise(F.lit(float("nan")))


def _admit(scored: DataFrame) -> DataFrame:
    """NaN and -inf never rank."""
    return scored.where(~F.isnan("score") & (F.col("score") > float("-inf")))


def top_k(rows: DataFrame, query: list[float], k: int, metric: str = "cosine", id_col: str = "row_id", vector_col: str = "vec", norm_col: str | None = None) -> DataFrame:
    """rank, row_id, score of the ``k`` best rows, ties to smaller ids; fewer if fewer qualify. ``norm_col``: see `with_norms`."""
    if k < 1:
        raise InvalidOption("k must be positive")
    if metric == "cosine" and not sum(float(x) ** 2 for x in query) > 0:
        if rows.limit(1).count():
            raise InvalidOption("cosine needs a query that is not zero")
    q = F.array(*(F.lit(float(x)) for x in query))
    same = F.when(F.size(vector_col) == len(query), F.col(vector_col)).otherwise(F.raise_error(F.lit(f"rows must have {len(query)} components")))
    length = F.col(norm_col) if norm_col else None
    best = _admit(rows.select(F.col(id_col).alias("row_id"), _score(q, same, metric, length).alias("score"))).orderBy(F.desc("score"), "row_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "row_id"))).select("rank", "row_id", "score")


def top_k_batched(rows: DataFrame, queries: DataFrame, k: int | None, metric: str = "cosine", id_col: str = "row_id", vector_col: str = "vec", query_col: str = "query_id", norm_col: str | None = None) -> DataFrame:
    """query_id, rank, row_id, score for every query; ``k`` None ranks all rows. Zero queries have no cosine.

    Queries are taken in blocks of about ``BLOCK``, dealt by a hash of their id: each block meets every row once, and a per-query limit within the
    tasks comes before the shuffle. Dot products and cosines with integer row ids and a ``k`` up to ``block_scan.MOST`` are found as products of matrices,
    others pair by pair."""
    if k is not None and k < 1:
        raise InvalidOption("k must be positive")
    q = queries.select(F.col(query_col).alias("query_id"), F.col(vector_col).alias("q"))
    if metric == "cosine":
        q = q.where(square(F.col("q")) > 0)
    length = F.col(norm_col) if norm_col else F.lit(None).cast("double")
    slim, scored = rows.select(F.col(id_col).alias("row_id"), F.col(vector_col).alias("v"), length.alias("n")), None
    matrices = k is not None and k <= block_scan.MOST and metric in ("dot", "cosine") and not norm_col and isinstance(slim.schema["row_id"].dataType, IntegralType)
    for block in _blocks(q):
        if matrices:
            part = block_scan.best_rows(slim, block, k, metric)
        else:
            pairs = slim.join(F.broadcast(block), F.size("v") == F.size("q"))
            part = _admit(pairs.select("query_id", "row_id", _score(F.col("q"), F.col("v"), metric, F.col("n") if norm_col else None).alias("score")))
        scored = part if scored is None else scored.unionByName(part)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).select("query_id", "rank", "row_id", "score")


def _blocks(queries: DataFrame) -> list[DataFrame]:
    """The queries in as many parts as hold about ``BLOCK`` each; every part is broadcast by itself."""
    parts = max(1, -(-queries.count() // BLOCK))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [queries]


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """query_id, rank, row_id, score from several (query_id, rank, row_id): the sum of 1 / (constant + rank)."""
    parts = rankings[0].select("query_id", "row_id", "rank")
    for r in rankings[1:]:
        parts = parts.unionByName(r.select("query_id", "row_id", "rank"))
    fused = parts.groupBy("query_id", "row_id").agg(F.sum(1.0 / (F.lit(constant) + F.col("rank"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "row_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "row_id", "score")
