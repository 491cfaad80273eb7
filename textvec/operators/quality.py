"""How well a model suits texts, what half floats cost, how much of a text is read, and statistics of timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textvec.errors import InvalidOption
from textvec.functions import codec
from textvec.model import Model
from textvec.operators import search
from textvec.operators.embed import Kernel, bytes_ids, capped, pool, tokenizer_of

#: From here on a share of unknown tokens, or a number of tokens a word, tells of a model that is wrong for a language.
MANY_UNKNOWN, MANY_PIECES = 0.3, 2.5


def language_safety(kernel: Kernel, docs: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """``by``, unk_ratio, tokens_per_word, unsafe: whether either is above its bound. Groups without tokens have nulls and are safe."""
    words = F.size(F.filter(F.split(text_col, r"\s+"), lambda x: x != ""))
    rows = docs.where(F.col(text_col).isNotNull()).select(*by, kernel.embed_with_stats(text_col, False).alias("s"), words.alias("words"))
    ratio = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b))
    out = rows.groupBy(*by).agg(ratio("s.unk_count", "s.token_count").alias("unk_ratio"), ratio("s.token_count", "words").alias("tokens_per_word"))
    unsafe = F.coalesce(F.col("unk_ratio") > MANY_UNKNOWN, F.lit(False)) | F.coalesce(F.col("tokens_per_word") > MANY_PIECES, F.lit(False))
    return out.withColumn("unsafe", unsafe)


def half_float_quality(rows: DataFrame, vector: Column | str = "vec") -> DataFrame:
    """rows, min_cosine, mean_cosine, max_abs, max_norm_delta of vectors against themselves in half floats."""
    x = F.transform(vector, lambda v: v.cast("double"))
    both = rows.select(x.alias("x")).withColumn("y", F.transform("x", codec.f16_column))
    nx, ny = search.norm(F.col("x")), search.norm(F.col("y"))
    cos = F.when((nx == 0) & (ny == 0), 1.0).when((nx == 0) | (ny == 0), 0.0).otherwise(search.cosine(F.col("x"), F.col("y")))
    one = both.select(cos.alias("cos"), F.array_max(F.zip_with("x", "y", lambda a, b: F.abs(a - b))).alias("diff"), F.abs(nx - ny).alias("delta"))
    return one.agg(F.count(F.lit(1)).alias("rows"), F.min("cos").alias("min_cosine"), F.avg("cos").alias("mean_cosine"), F.max("diff").alias("max_abs"), F.max("delta").alias("max_norm_delta"))


def bytes_that_count(model: Model, text: str) -> int | None:
    """Length of the shortest beginning of a truncated text, in bytes, that has its vector's ids; None if the text is not cut.

    Ids of a beginning are found by halving: once a beginning has them, so have all longer ones that end between words."""
    m, own, raw = model.meta, tokenizer_of(model), text.encode()
    usable = m.truncation == "usable_ids" and m.unk_policy == "drop"
    ids = lambda n: capped(bytes_ids(own, raw[:n].decode("utf-8", "ignore").encode(), 0, usable), m.max_tokens, m.unk_id, usable)
    want, cut = ids(len(raw))
    if not cut:
        return None
    goal, low, high = pool(model, want)[0].tolist(), 0, len(raw)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if pool(model, ids(middle)[0])[0].tolist() == goal else (middle, high)
    return high


def timing_stats(seconds: list[float], **amounts: float) -> dict[str, float]:
    """median, best, worst, spread_pct of runs, and a rate ``<name>_per_s`` at the median for each of ``amounts``."""
    if not seconds:
        raise InvalidOption("no runs")
    runs = sorted(seconds)
    half = len(runs) // 2
    median = runs[half] if len(runs) % 2 else (runs[half - 1] + runs[half]) / 2
    out = {"median": median, "best": runs[0], "worst": runs[-1], "spread_pct": 100 * (runs[-1] - runs[0]) / median if median else 0.0}
    return out | {f"{k}_per_s": v / median if median else 0.0 for k, v in amounts.items()}
