"""Retrieval evaluation from full rankings and relevance judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textvec.errors import InvalidOption, InvalidSource
from textvec.operators.embed import Kernel
from textvec.operators.search import top_k_batched


def unknown_references(qrels: DataFrame, documents: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Judgements of documents that do not exist."""
    return qrels.join(documents.select(F.col(doc_col).alias("doc_id")).distinct(), "doc_id", "left_anti")


def check_references(qrels: DataFrame, documents: DataFrame, doc_col: str = "doc_id") -> None:
    if bad := unknown_references(qrels, documents, doc_col).limit(1).collect():
        raise InvalidSource(f"unknown document {bad[0].doc_id!r}")


def query_metrics(ranking: DataFrame, qrels: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """query_id, rr, rr_at_k, ndcg_at_k, recall_at_k, hit_at_k; queries without a ranking count as zero, and so do those of
    ``queries`` (query_id) without a judgement."""
    if queries is not None:
        none = queries.select("query_id").distinct().join(qrels.select("query_id").distinct(), "query_id", "left_anti")
        return query_metrics(ranking, qrels, k).unionByName(none.select("query_id", *(F.lit(0.0).alias(m) for m in METRICS)))
    relevant = qrels.select("query_id", "doc_id").distinct()
    hits = relevant.join(ranking.select("query_id", F.col("row_id").alias("doc_id"), "rank"), ["query_id", "doc_id"], "left")
    shown = ranking.where(F.col("rank") <= k).groupBy("query_id").agg(F.count(F.lit(1)).alias("shown"))
    near = F.col("rank") <= k
    per = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"), F.sum(F.when(near, 1 / F.log2(F.col("rank") + 1))).alias("dcg"), F.sum(F.when(near, 1).otherwise(0)).alias("found"))
    per = per.join(shown, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n"), F.coalesce("shown", F.lit(1))).cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return per.select(
        "query_id",
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.when(F.col("first") <= k, 1 / F.col("first")).otherwise(0.0).alias("rr_at_k"),
        F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg_at_k"),
        (F.col("found") / F.col("n")).alias("recall_at_k"),
        F.when(F.col("first") <= k, 1.0).otherwise(0.0).alias("hit_at_k"),
    )


METRICS = ("rr", "rr_at_k", "ndcg_at_k", "recall_at_k", "hit_at_k")


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """metric, value."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))
    return per_query.select(F.explode(pairs).alias("m")).groupBy("m.metric").agg(F.avg("m.value").alias("value"))


def bootstrap(per_query: DataFrame, rounds: int = 1000, seed: int = 1) -> DataFrame:
    """metric, ci_lo, ci_hi: the 2.5 and 97.5 per cent points of the means of resampled queries.

    A query's weight in a round is the number of times it is drawn; weights come from a hash of (seed, round,
    query), as independent Poisson(1) counts, so that no round gathers the queries in one place."""
    u = F.pmod(F.xxhash64(F.lit(seed), "round", "query_id"), F.lit(1 << 30)) / float(1 << 30)
    steps, total, weight = [], 0.0, 0.36787944117144233
    for n in range(8):
        total += weight
        steps.append(total)
        weight /= n + 1
    draws = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))
    drawn = per_query.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", draws).where("w > 0")
    means = drawn.select("round", "w", F.explode(pairs).alias("m")).groupBy("round", "m.metric").agg((F.sum(F.col("m.value") * F.col("w")) / F.sum("w")).alias("mean"))
    points = means.groupBy("metric").agg(F.array_sort(F.collect_list("mean")).alias("all"))
    at = lambda q: F.get("all", F.round(F.lit(q) * (F.size("all") - 1)).cast("int"))
    return points.select("metric", at(0.025).alias("ci_lo"), at(0.975).alias("ci_hi"))


def _harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: added up to 64, from there by its expansion, to 13 digits."""
    x = n.cast("double")
    far = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)
    near = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(64))).cast("int")), F.lit(0.0), lambda s, i: s + 1 / i)
    return F.when(n < 1, F.lit(0.0)).when(n <= 64, near).otherwise(far)


def random_baseline(qrels: DataFrame, documents: int, k: int) -> DataFrame:
    """query_id and the metrics of `query_metrics` that a random order of ``documents`` is expected to reach.

    They are exact, from the number r of a query's judged documents, so nothing is shuffled into orders: the first hit is
    at i with probability C(n - i, r - 1) / C(n, r), whose mean reciprocal is r (H(n) - H(r - 1)) / (n - r + 1)."""
    if k < 1 or documents < 1:
        raise InvalidOption("k and the number of documents must be positive")
    n, r, top = F.lit(documents).cast("double"), F.col("r"), min(k, documents)
    counts = qrels.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("r"))
    ranks = F.sequence(F.lit(1), F.lit(top))
    start = F.struct(F.lit(1.0).alias("none"), F.lit(0.0).alias("rr"))  # none: no hit so far
    first = F.aggregate(ranks, start, lambda s, i: F.struct((s["none"] * F.greatest(F.lit(0.0), 1 - r / (n - i + 1))).alias("none"), (s["rr"] + s["none"] * F.least(F.lit(1.0), r / (n - i + 1)) / i).alias("rr")))
    gain = lambda upto: F.aggregate(F.sequence(F.lit(1), upto.cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    counts = counts.withColumn("first", first)
    return counts.select(
        "query_id",
        (r * (_harmonic(F.lit(documents)) - _harmonic(r - 1)) / (n - r + 1)).alias("rr"),
        F.col("first.rr").alias("rr_at_k"),
        (r / n * gain(F.lit(top)) / gain(F.least(r, F.lit(top)))).alias("ndcg_at_k"),
        (F.lit(float(top)) / n).alias("recall_at_k"),
        (1 - F.col("first.none")).alias("hit_at_k"),
    )


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, text), queries (query_id, text) and judgements (query_id, doc_id) of a JSON file with ``documents``
    of id and text, and ``queries`` of text, relevant and, if wanted, id; a query without id goes by its text."""
    schema = "documents array<struct<id: string, text: string>>, queries array<struct<id: string, text: string, relevant: array<string>>>"
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    documents = whole.select(F.explode("documents").alias("d")).select(F.col("d.id").alias("doc_id"), "d.text")
    asked = whole.select(F.explode("queries").alias("q")).select(F.coalesce("q.id", "q.text").alias("query_id"), "q.text", "q.relevant")
    for name, part in (("documents", documents), ("queries", asked)):
        if part.isEmpty():
            raise InvalidSource(f"dataset has no {name}")
    qrels = asked.select("query_id", F.explode("relevant").alias("doc_id")).distinct()
    check_references(qrels, documents)
    return documents, asked.select("query_id", "text"), qrels


def evaluate_dataset(kernel: Kernel, documents: DataFrame, queries: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """The metrics of each query when all documents are ranked by cosine; a query whose vector is zero ranks none and counts as zero."""
    docs = documents.select(F.col("doc_id").alias("row_id"), kernel.embed(F.coalesce("text", F.lit(""))).alias("vec"))
    asked = queries.select("query_id", kernel.embed(F.coalesce("text", F.lit(""))).alias("vec"))
    return query_metrics(top_k_batched(docs, asked, None), qrels, k, queries)
