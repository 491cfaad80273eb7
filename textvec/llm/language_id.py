"""Operator 8, language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code point, so alphabets are open. A
letter trigram is the product of its letters' vectors, rotated by their position; a text is the sum of its
trigrams, a language the sum of its texts. A text gets the language with the largest cosine. Case, digits and
punctuation are ignored: any run of them is one space, which counts as a letter. Sums are taken through trigram
counts, whole chunks of texts at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from textvec.llm.bpe import chunks
from textvec.llm.shared import mix

#: Components of a vector.
DIM = 512
#: Most cells of a chunk's counts (64 MB while they are summed), and trigrams whose vectors are made at a time (32 MB).
CELLS, GRAMS = 1 << 23, 1 << 14
UNKNOWN = "und"
_FOLD: list[np.ndarray] = []
_U = np.uint64


def _fold() -> np.ndarray:
    """For each code point its lower-case letter, or 0."""
    if not _FOLD:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(table)
    return _FOLD[0]


def letter_vectors(letters: np.ndarray, dim: int = DIM) -> np.ndarray:
    """A row of +1 and -1 for each code point."""
    words = mix(mix(letters.astype(np.uint64) + _U(1))[:, None] + np.arange(1, dim // 64 + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    bits = np.unpackbits(words.view(np.uint8).reshape(len(letters), -1), axis=1)[:, :dim]
    return bits.astype(np.float32) * 2 - 1


def profile(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For a chunk of texts: their vectors (texts x DIM), and which of them have a letter.

    Counts are a matrix (texts x trigrams) of CELLS at most; a chunk with more of them is halved. Vectors of trigrams are
    made GRAMS at a time. So memory is bounded by the chunk's text, whatever its script."""
    sizes = np.array([len(t) + 2 for t in texts])
    raw = np.frombuffer(" ".join(f"{t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _fold()[np.concatenate((np.array([32], np.uint32), raw))]
    code = np.pad(code, (0, int(sizes.sum()) - len(code)))
    doc = np.repeat(np.arange(len(texts)), sizes)
    keep = (code != 0) | np.concatenate(([True], (code[:-1] != 0) | (doc[1:] != doc[:-1])))
    code, doc = code[keep], doc[keep]
    lettered = np.bincount(doc[code != 0], minlength=len(texts)) > 0
    present = np.flatnonzero(np.bincount(code)) if len(code) else np.zeros(1, np.int64)
    number = np.zeros(int(present[-1]) + 1, np.int64)
    number[present] = np.arange(len(present))
    n, size = number[code], len(present)
    inside = doc[2:] == doc[:-2]
    gram = ((n[:-2] * size + n[1:-1]) * size + n[2:])[inside]
    owner = doc[:-2][inside]
    if size**3 <= 1 << 22:
        found = np.flatnonzero(np.bincount(gram, minlength=1))
        at = np.zeros(int(found[-1]) + 1 if len(found) else 1, np.int64)
        at[found] = np.arange(len(found))
        gram = at[gram]
    else:
        found, gram = np.unique(gram, return_inverse=True)
    if len(texts) > 1 and len(texts) * len(found) > CELLS:
        halves = [profile(part) for part in (texts[: len(texts) // 2], texts[len(texts) // 2 :])]
        return np.concatenate([v for v, _ in halves]), np.concatenate([x for _, x in halves])
    counts = np.bincount(owner * max(1, len(found)) + gram, minlength=len(texts) * max(1, len(found))).reshape(len(texts), -1).astype(np.float32)
    base = letter_vectors(present)
    first, second, own = np.roll(base, 2, 1), np.roll(base, 1, 1), np.zeros((len(texts), DIM), np.float32)
    for lo in range(0, len(found), GRAMS):
        g = found[lo : lo + GRAMS]
        own += counts[:, lo : lo + GRAMS] @ (first[g // (size * size)] * second[g // size % size] * base[g % size])
    return own, lettered


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        at = 0
        for texts in chunks(x.as_py() for x in batch.column("text")):
            langs = batch.column("lang").slice(at, len(texts)).to_pylist()
            at += len(texts)
            own, _ = profile(texts)
            names = sorted(set(langs))
            for name, vector in zip(names, np.array([[x == name for x in langs] for name in names], np.float64) @ own):
                total[name] = total.get(name, 0) + vector
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([np.rint(v).astype(np.int64) for v in total.values()], pa.list_(pa.int64()))], ["lang", "v"])


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototypes from all rows of ``docs(text, lang)`` with both; one vector for each language."""
    rows = docs.where("text is not null and lang is not null").mapInArrow(_bundle, "lang string, v array<long>")
    total = rows.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in total.collect():  # languages x DIM rows
        out.setdefault(r.lang, np.zeros(DIM))[r.i] = r.x
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if v.any()}


def _predict(model, text: str, names: list[str]) -> Callable:
    """Append the language and the score of the column ``text`` to each batch; ``names`` are the columns that come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, matrix = model.value
        for batch in batches:
            at = 0
            for texts in chunks(x.as_py() for x in batch.column(text)):
                rows = batch.slice(at, len(texts))
                at += len(texts)
                langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                own, lettered = profile(texts)
                if known:
                    cosine = (own @ matrix.T) / np.maximum(np.linalg.norm(own, axis=1), 1e-9)[:, None]
                    best = cosine.argmax(1)
                    for i in np.flatnonzero(lettered):
                        langs[i], scores[i] = known[best[i]], min(1.0, max(0.0, float(cosine[i, best[i]])))
                cols = [rows.column(c) for c in names[:-2]]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    return run


def _model(spark, prototypes: dict[str, np.ndarray]):
    return spark.sparkContext.broadcast((list(prototypes), np.array(list(prototypes.values()), np.float32)))


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the cosine, at least 0) of every row.

    A text that is null or has no letter is `und` with score 0; so is every text if nothing was learned. Ties go to
    the language first in order. Repeated rows are predicted row by row; other columns are ignored."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "lang_pred", "score"]
    return slim.mapInArrow(_predict(_model(docs.sparkSession, prototypes), "text", names), "doc_id long, lang_pred string, score double")


def annotate(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with two more, as `identify` gives them; nothing is shuffled. Columns that have the
    names of the new ones already are an error: choose others."""
    if {pred, score} & set(docs.columns):
        raise ValueError(f"{pred} or {score} is a column already")
    schema = StructType([*docs.schema.fields, StructField(pred, StringType()), StructField(score, DoubleType())])
    return docs.mapInArrow(_predict(_model(docs.sparkSession, prototypes), text_col, schema.names), schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the labelled documents that are not held out, and predict all: doc_id, held_out, lang_pred, score.

    Held out are documents with crc32(doc_id as text) mod 5 = 0; a null id is neither held out nor learned from."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = identify(slim, learn(slim.where(~out)))
    return found.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score")
