"""Tokenize and embed: WordPiece over distinct words, gathering of rows, pooling. One kernel, called per Arrow batch."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textvec.errors import EmptyInput, EncodingError, InvalidOption
from textvec.functions.codec import normalize_format, pack
from textvec.functions.normalize import normalize, words
from textvec.model import Model, body, is_continuation

STATS = "token_count bigint, unk_count bigint, pooled_count bigint, truncated boolean"
_MEMO = 500_000


class _Memo(dict):
    """Pieces of words, found when first asked for; emptied when it is full."""

    def __init__(self, find: Callable[[str], list[int]]):
        self.find = find

    def __missing__(self, word: str) -> list[int]:
        if len(self) > _MEMO:
            self.clear()
        self[word] = out = self.find(word)
        return out


class Tokenizer:
    """Greedy longest-match WordPiece with a bounded memo of words."""

    def __init__(self, model: Model):
        m = self.meta = model.meta
        self.root = {body(t): i for i, t in enumerate(model.tokens) if not is_continuation(t)}
        self.inner = {body(t): i for i, t in enumerate(model.tokens) if is_continuation(t)}
        self.longest = max(len(body(t)) for t in model.tokens)
        self.added = {t: model.tokens.index(t) for t in m.added_tokens}
        self.split = re.compile("(" + "|".join(map(re.escape, m.added_tokens)) + ")") if m.added_tokens else None
        self.memo = _Memo(self._pieces)

    def _pieces(self, word: str) -> list[int]:
        if len(word) > self.meta.max_input_chars_per_word:
            return [self.meta.unk_id]
        out, at, table = [], 0, self.root
        while at < len(word):
            for to in range(min(len(word), at + self.longest), at, -1):
                if (i := table.get(word[at:to])) is not None:
                    break
            else:
                return [self.meta.unk_id]
            out.append(i)
            at, table = to, self.inner
        return out

    def ids(self, text: str, enough: int | None = None) -> list[int]:
        """All ids of a text; with ``enough``, at least so many if the text has them."""
        m, out = self.meta, []
        for part in self.split.split(text) if self.split and "[" in text else [text]:
            if part in self.added:
                out.append(self.added[part])
                continue
            found = words(normalize(part, m.lowercase, m.strip_accents, m.handle_chinese_chars))
            if enough is None:
                out.extend(chain.from_iterable(map(self.memo.__getitem__, found)))
                continue
            for word in found:
                out += self.memo[word]
                if enough is not None and len(out) > enough:
                    return out
        return out


_TOKENIZERS: dict[int, tuple[Model, Tokenizer]] = {}


def tokenizer_of(model: Model) -> Tokenizer:
    """The tokenizer of a model, with its memo, for the life of the Python process."""
    if id(model) not in _TOKENIZERS:
        if len(_TOKENIZERS) > 8:
            _TOKENIZERS.clear()
        _TOKENIZERS[id(model)] = model, Tokenizer(model)
    return _TOKENIZERS[id(model)][1]


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores if its files are too few to keep them busy; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bytes_ids(own: Tokenizer, raw: bytes, limit: int, usable: bool) -> list[int]:
    """The ids of UTF-8 bytes; with ``limit``, of a beginning that has more than the limit, if there is one. It ends at a
    space, where a text can be cut without changing what comes before, and doubles until it is long enough."""
    take = min(max(16 * limit, 4096), 65536)
    while limit and take < len(raw):
        end = max(raw.rfind(space, 0, take) for space in (b" ", b"\t", b"\n", b"\r")) + 1
        if end:
            ids = own.ids(decode_utf8(raw[:end]))
            if sum(i != own.meta.unk_id for i in ids) > limit if usable else len(ids) > limit:
                return ids
        take *= 2
    return own.ids(decode_utf8(raw))


def decode_utf8(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise EncodingError(f"no UTF-8 at byte {e.start}") from e


def capped(ids: list[int], limit: int, unk_id: int, usable: bool) -> tuple[list[int], bool]:
    """The ids that count, and whether some were cut: the first ``limit``, or up to the ``limit``-th that is known."""
    if not limit:
        return ids, False
    if not usable:
        return ids[:limit], len(ids) > limit
    seen = 0
    for n, i in enumerate(ids):
        seen += i != unk_id
        if seen > limit:
            last = next(k for k in range(n - 1, -1, -1) if ids[k] != unk_id)
            return ids[: last + 1], True
    return ids, False


def limit_of(model: Model, max_tokens: int | bool | None) -> int:
    """None: the model's limit; False: unlimited."""
    if max_tokens is None:
        return model.meta.max_tokens
    if max_tokens is False:
        return 0
    if isinstance(max_tokens, bool) or max_tokens < 1:
        raise InvalidOption("max_tokens must be positive, None or False")
    return max_tokens


def pool(model: Model, ids: list[int]) -> tuple[np.ndarray, int]:
    """The vector of token ids, summed in double precision, and how many were pooled: the mean of their rows, at length
    one if the model says so."""
    m = model.meta
    used = np.asarray(ids, np.int64)
    if len(used) and (used.min() < 0 or used.max() >= model.vocab_size):
        raise InvalidOption("token id out of range")
    if m.unk_policy == "drop":
        used = used[used != m.unk_id]
    if not len(used):
        if m.empty_policy == "raise":
            raise EmptyInput("no usable tokens")
        return np.zeros(m.dim), 0
    total = model.matrix[used].sum(0, dtype=np.float64)
    if m.normalization == "none":
        return total / len(used), len(used)
    square = float((total**2).sum())
    return (total / square**0.5 if square > 0 else np.zeros(m.dim)), len(used)


class Kernel:
    """Functions of a broadcast model as Columns; ``register`` makes them callable from SQL."""

    def __init__(self, spark: SparkSession, model: Model):
        self.model, self.shared = model, spark.sparkContext.broadcast(model)
        self.spark = spark

    def tokenize(self, text: Column | str, max_tokens: int | bool | None = None) -> Column:
        """Raw ids, unknown ones included; a limit always counts raw ids. Null stays null."""
        return self._tokenize(max_tokens)(text)

    def _tokenize(self, max_tokens):
        shared, limit = self.shared, limit_of(self.model, max_tokens)

        @F.pandas_udf("array<int>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = tokenizer_of(shared.value)
            for part in parts:
                yield part.map(lambda t: None if t is None else own.ids(t, limit or None)[: limit or None])

        return run

    def embed(self, text: Column | str, max_tokens: int | bool | None = None, kind: str = "float") -> Column:
        """The vector of a text; null for null, zeros for a text without usable tokens. ``kind``: float or double."""
        return self._embed(max_tokens, False, kind)(text).getField("vec")

    def embed_blob(self, text: Column | str, fmt: str | None = None, max_tokens: int | bool | None = None) -> Column:
        name = normalize_format(fmt)

        @F.pandas_udf("binary")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield part.map(lambda v: None if v is None else pack(v, name))

        return run(self.embed(text, max_tokens))

    def embed_with_stats(self, text: Column | str, max_tokens: int | bool | None = None) -> Column:
        return self._embed(max_tokens, False)(text)

    def embed_ids(self, ids: Column | str, max_tokens: int | bool | None = None) -> Column:
        """Like ``embed_with_stats``, from token ids; ids out of range are an error."""
        return self._embed(max_tokens, True)(ids)

    def embed_bytes(self, raw: Column | str, max_tokens: int | bool | None = None, validate: str = "full") -> Column:
        """Like ``embed_with_stats``, from the bytes of UTF-8 texts. ``validate`` ``full`` refuses any byte that is no UTF-8;
        ``prefix`` reads, and so checks, no more of a text than its limit needs."""
        if validate not in ("full", "prefix"):
            raise InvalidOption(f"validate must be full or prefix, not {validate!r}")
        return self._embed(max_tokens, False, read=validate)(raw)

    def _embed(self, max_tokens, from_ids: bool, kind: str = "float", read: str | None = None):
        shared, limit = self.shared, limit_of(self.model, max_tokens)

        @F.pandas_udf(f"struct<vec: array<{kind}>, {STATS.replace(' ', ': ').replace(',: ', ', ')}>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = shared.value
            own, m = tokenizer_of(model), model.meta
            usable = m.truncation == "usable_ids" and m.unk_policy == "drop"
            for part in parts:
                rows = []
                for x in part:
                    if x is None:
                        rows.append((None, None, None, None, None))
                        continue
                    if read:
                        ids = bytes_ids(own, bytes(x), limit if read == "prefix" else 0, usable)
                    else:
                        ids = [int(i) for i in x] if from_ids else own.ids(x, limit if limit and not usable else None)
                    ids, cut = capped(ids, limit, m.unk_id, usable)
                    vec, used = pool(model, ids)
                    rows.append((vec.tolist(), len(ids), ids.count(m.unk_id), used, cut))
                yield pd.DataFrame(rows, columns=["vec", "token_count", "unk_count", "pooled_count", "truncated"]).astype({"token_count": "Int64", "unk_count": "Int64", "pooled_count": "Int64", "truncated": "boolean"})

        return run

    def register(self) -> None:
        self.spark.udf.register("tv_tokenize", self._tokenize(None))
        self.spark.udf.register("tv_embed", self._embed(None, False))


def embed_relational(tokens: DataFrame, matrix: DataFrame, model: Model) -> DataFrame:
    """The same from (doc_id, pos, token_id) rows by a join and aggregations: doc_id, vec as doubles.

    ``matrix`` has a row per vocabulary entry, which bounds the side that is broadcast."""
    m = model.meta
    if m.max_tokens:
        order = Window.partitionBy("doc_id").orderBy("pos")
        if m.truncation == "usable_ids" and m.unk_policy == "drop":
            known = F.sum((F.col("token_id") != m.unk_id).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
            tokens = tokens.withColumn("n", known).where(F.col("n") <= m.max_tokens)
        else:
            tokens = tokens.withColumn("n", F.row_number().over(order)).where(F.col("n") <= m.max_tokens)
    if m.unk_policy == "drop":
        tokens = tokens.where(F.col("token_id") != m.unk_id)
    counts = tokens.groupBy("doc_id", "token_id").agg(F.count(F.lit(1)).alias("k"))
    cells = counts.join(F.broadcast(matrix), "token_id").select("doc_id", "k", F.posexplode("vec").alias("i", "x"))
    sums = cells.groupBy("doc_id", "i").agg(F.sum(F.col("x").cast("double") * F.col("k")).alias("s"), F.sum("k").alias("n"))
    scale = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("doc_id"))) if m.normalization == "l2" else F.col("n")
    sums = sums.withColumn("scale", scale).withColumn("v", F.when(F.col("scale") > 0, F.col("s") / F.col("scale")).otherwise(0.0))
    return sums.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c.v).alias("vec"))
