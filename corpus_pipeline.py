"""The corpus pipeline: language ID, line dedup, near-duplicate removal, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textvec.llm.jaccard_join import jaccard_components
from textvec.llm.language_id import UNKNOWN, annotate, learn
from textvec.llm.line_dedup import line_dedup
from textvec.llm.packing import packing
from textvec.llm.queries import tokenizer_json
from textvec.llm.shared import stash
from textvec.session import ship


def _free(name: str, columns: list[str]) -> str:
    return name if name not in columns else _free(name + "_", columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: rows go whose text is null or has no letter, or has a cosine of 0 or less with
    every language, which is no nearer to any than noise is on average.

    Profiles are learned from all labelled documents. Without labels only texts without a letter go. Each row is
    decided by itself, whatever its doc_id, and nothing is shuffled."""
    ship(spark)
    prototypes = learn(docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    if not prototypes:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    pred, score = _free("lang_pred", docs.columns), _free("score", docs.columns)
    known = annotate(docs, prototypes, "text", pred, score)
    return known.where((F.col(pred) != UNKNOWN) & (F.col(score) > 0)).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier documents have, up to one edit."""
    ship(spark)
    return line_dedup(docs).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles: the first.

    Texts without words are in no group and stay, as do those without a doc_id. Of rows that repeat a doc_id, which
    must repeat its text, one stays."""
    ship(spark)
    found = jaccard_components(docs, 5, 80, 100).where("doc_id is not null")
    mark, own = _free("mark", docs.columns), _free("id", docs.columns)
    marks = found.groupBy(F.col("doc_id").alias(own)).agg(F.max(F.when(F.col("component_id") != F.col("doc_id"), 2).otherwise(1)).alias(mark), F.count(F.lit(1)).alias("rows"))
    marks = stash(marks.where(f"{mark} = 2 or rows > 1").drop("rows"), "marks")  # 2: goes; 1: one of its rows stays
    marks = F.broadcast(marks) if marks.count() <= BROADCAST else marks
    known = docs.join(marks, docs.doc_id == marks[own], "left")
    once = known.where(F.col(mark) == 1).dropDuplicates(["doc_id"])
    return known.where(F.col(mark).isNull()).unionByName(once).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    ship(spark)
    return packing(docs, tokenizer_json("word_bpe_49k.json"), 2048, 1)


#: Marked documents that are broadcast (12 bytes each); more are joined by a shuffle.
BROADCAST = 1 << 20

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("packing", packing_stage),
]

#: SQL has no byte-pair merges and no random vectors; tests/llm hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the scratch folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
