"""Comparison of the engine with recorded results of another implementation.

A record file is one JSON object: ``schema_version``, ``reference`` (settings) and ``rows``, each with a label, a text, its
raw ids, the ids that are pooled and the vector. Both sides of a row are compared in one task; only a summary comes back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textvec.errors import InvalidSource
from textvec.operators.embed import Kernel
from textvec.operators.search import cosine, square

# Names and versions in files.
VERSIONS = (1, 2, 3)
REFERENCE = "max_length int, truncation string, unk_token_id int"
ROW = "label string, text string, hf_raw_token_ids array<int>, static_pooled_token_ids array<int>, static_usable_token_ids array<int>, model2vec_token_ids array<int>, model2vec_vector array<double>, st_vector array<double>"


def read_records(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """Settings, and rows (label, text, raw_ids, pooled_ids, other_ids, vector)."""
    whole = spark.read.schema(f"schema_version int, reference struct<{REFERENCE.replace(' ', ':').replace(',:', ',')}>, rows array<struct<{', '.join(c.replace(' ', ': ', 1) for c in ROW.split(', '))}>>").option("multiLine", True).json(path)
    head = whole.select("schema_version", "reference").first()
    if head is None or head.schema_version not in VERSIONS:
        raise InvalidSource(f"unknown version {head and head.schema_version} of records")
    rows = whole.select(F.posexplode("rows").alias("at", "r")).select("at", "r.*")
    pooled = F.coalesce("static_pooled_token_ids", "static_usable_token_ids")
    settings = head.reference.asDict() if head.reference else {}
    return settings, rows.select(F.coalesce("label", F.col("at").cast("string")).alias("label"), "text", F.col("hf_raw_token_ids").alias("raw_ids"), pooled.alias("pooled_ids"), F.col("model2vec_token_ids").alias("other_ids"), F.coalesce("model2vec_vector", "st_vector").alias("vector"))


def write_records(kernel: Kernel, cases: DataFrame, path: str) -> None:
    """Records of this engine for ``cases`` (label, text), a small test set that is written as one file."""
    m = kernel.model.meta
    raw, kept = kernel.tokenize("text", False), _pooled(kernel, F.col("raw"))
    rows = cases.select("label", "text", raw.alias("raw")).select("label", "text", F.col("raw").alias("hf_raw_token_ids"), kept.alias("static_pooled_token_ids"), kept.alias("model2vec_token_ids"), kernel.embed("text", kind="double").alias("model2vec_vector"))
    reference = {"max_length": m.max_tokens, "truncation": m.truncation, "unk_token_id": m.unk_id if m.unk_policy == "drop" else None}
    with open(path, "w", encoding="utf-8") as f:
        head = json.dumps({"schema_version": VERSIONS[-1], "reference": reference}, ensure_ascii=False)
        f.write(head[:-1] + ', "rows": [')
        for n, row in enumerate(rows.toJSON().toLocalIterator()):
            f.write((",\n" if n else "\n") + row)
        f.write("\n]}\n")


def _pooled(kernel: Kernel, ids):
    """The ids of a column of raw ids that a vector is made of."""
    m = kernel.model.meta
    known = lambda a: F.filter(a, lambda i: i != m.unk_id) if m.unk_policy == "drop" else a
    first = lambda a: F.slice(a, 1, m.max_tokens) if m.max_tokens else a
    return known(first(ids)) if m.truncation == "raw_ids" else first(known(ids))


def compare(kernel: Kernel, settings: dict, records: DataFrame, min_cosine: float = 1 - 1e-6, max_abs: float = 1e-5) -> DataFrame:
    """label, raw_at and pooled_at (first place of a difference, null if none), same_by_ids, cosine, max_abs, ok.

    Records made under other limits are refused. Rows whose recorded vector is of other ids than the pooled ones, or that
    have none, have no cosine and are judged by ids. Two zero vectors count as equal."""
    m = kernel.model.meta
    for name, mine in (("truncation", m.truncation), ("max_length", m.max_tokens), ("unk_token_id", m.unk_id)):
        if settings.get(name) is not None and settings[name] != mine:
            raise InvalidSource(f"records have {name} {settings[name]!r}, the model {mine!r}")
    mine = records.withColumn("raw", kernel.tokenize("text", False))
    mine = mine.select("*", _pooled(kernel, F.col("raw")).alias("pooled"), kernel.embed("text", kind="double").alias("v"), kernel.embed_ids("raw").getField("vec").alias("by_ids"), kernel.embed("text").alias("by_text"))
    away = lambda a, b: F.when(F.col(a) != F.col(b), F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False) - 1)
    a, b = F.col("vector"), F.col("v")
    held = a.isNotNull() & F.coalesce(F.col("other_ids") == F.col("pooled_ids"), F.lit(True))
    both, one = (square(a) == 0) & (square(b) == 0), (square(a) == 0) | (square(b) == 0)
    cos = F.when(held & (F.size(a) != F.size(b)), 0.0).when(held, F.when(both, 1.0).when(one, 0.0).otherwise(cosine(a, b)))
    far = F.when(held, F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))))
    out = mine.select("label", away("raw", "raw_ids").alias("raw_at"), away("pooled", "pooled_ids").alias("pooled_at"), (F.col("by_ids") == F.col("by_text")).alias("same_by_ids"), cos.alias("cosine"), far.alias("max_abs"))
    good = F.col("raw_at").isNull() & F.col("pooled_at").isNull() & F.col("same_by_ids")
    return out.withColumn("ok", good & F.coalesce((F.col("cosine") >= min_cosine) & (F.col("max_abs") <= max_abs), F.col("cosine").isNull()))


def summary(compared: DataFrame) -> DataFrame:
    """rows, vectors, raw_failures, pooled_failures, invariant_failures, failures, min_cosine, max_abs."""
    count = lambda c: F.count_if(c)
    return compared.agg(
        F.count(F.lit(1)).alias("rows"), F.count("cosine").alias("vectors"), count(F.col("raw_at").isNotNull()).alias("raw_failures"), count(F.col("pooled_at").isNotNull()).alias("pooled_failures"),
        count(~F.col("same_by_ids")).alias("invariant_failures"), count(~F.col("ok")).alias("failures"), F.min("cosine").alias("min_cosine"), F.max("max_abs").alias("max_abs"),
    )
