"""Made-up inputs for measurements, as DataFrames of any length: every row is made from its number alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textvec.errors import InvalidOption

_PROSE = "columns of text become vectors and vectors are searched by their nearness in one pass over all rows "
_CORNERS = "Съешь ещё\tэтих\nбулок naïve naïve 文字列 한글 🧪🛰 zero\u200bwidth no break dots... "


def _cycle(seed: str, size: int) -> Column:
    """``seed`` over and over, up to ``size`` bytes of whole characters."""
    return F.lit((seed * (size // len(seed.encode()) + 1)).encode()[:size].decode("utf-8", "ignore"))


def _many(one, size: int, width: int) -> Column:
    """Words made by ``one(row, k)``, each with its space about ``width`` bytes long, to a text of about ``size``."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(max(1, size // width) - 1)), lambda k: one(F.col("row_id"), k)), " ")


def _modes(size: int) -> dict[str, Column]:
    mark = lambda row, k: F.concat_ws("-", row, k)
    return {
        "ascii": F.concat(F.col("row_id").cast("string"), F.lit(" "), _cycle(_PROSE, size)),
        "hashes": _many(lambda row, k: F.sha2(mark(row, k), 256), size, 65),
        "base64": _many(lambda row, k: F.base64(F.encode(F.sha2(mark(row, k), 256), "utf-8")), size, 89),
        "identifiers": _many(lambda row, k: F.concat(F.lit("measuredIdentifierOf"), F.hex(row), F.lit("x"), F.hex(k), F.lit("withoutAnyBreakInIt")), size, 48),
        "long_words": _many(lambda row, k: F.substring(F.repeat(F.sha2(mark(row, k), 224), 2), F.lit(1), (F.lit(100) - (row + k) % 7).cast("int")), size, 98),
        "unicode": F.concat(F.col("row_id").cast("string"), F.lit(" "), _cycle(_CORNERS, size)),
    }


MODES = ("ascii", "hashes", "base64", "identifiers", "long_words", "unicode")


def texts(spark: SparkSession, mode: str, rows: int, size: int) -> DataFrame:
    """row_id, text of about ``size`` bytes."""
    if mode not in MODES:
        raise InvalidOption(f"mode must be one of {MODES}, not {mode!r}")
    if rows < 0 or size < 1:
        raise InvalidOption("rows must not be negative, and size positive")
    return spark.range(rows).select(F.col("id").alias("row_id")).withColumn("text", _modes(size)[mode])


def id_sets(spark: SparkSession, vocabulary: int, tokens: int, sets: int, seed: int = 1) -> DataFrame:
    """row_id, ids: ``tokens`` token ids out of ``vocabulary``, by a hash of the seed and their place."""
    if min(vocabulary, tokens) < 1 or sets < 0:
        raise InvalidOption("vocabulary and tokens must be positive, sets not negative")
    one = lambda k: F.pmod(F.xxhash64(F.lit(seed), "row_id", k), F.lit(vocabulary)).cast("int")
    return spark.range(sets).select(F.col("id").alias("row_id")).withColumn("ids", F.transform(F.sequence(F.lit(1), F.lit(tokens)), one))
