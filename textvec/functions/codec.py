"""Vectors as little-endian binary: 32-bit floats, or 16-bit ones rounded half up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textvec.errors import InvalidOption


def normalize_format(fmt: str | None) -> str:
    name = {None: "f32", "f32": "f32", "float32": "f32", "f16": "f16", "float16": "f16"}.get(fmt)
    if not name:
        raise InvalidOption(f"format must be f32 or f16, not {fmt!r}")
    return name


def encode_f16(values) -> np.ndarray:
    """16-bit patterns of 32-bit floats; halfway cases go away from zero, not to even."""
    x = np.asarray(values, "<f4")
    size = np.abs(x.astype(np.float64))
    with np.errstate(all="ignore"):
        _, exponent = np.frexp(size)
        step = np.exp2(np.maximum(exponent - 1, -14) - 10.0)
        rounded = np.floor(size / step + 0.5) * step
        rounded[size < 2.0**-25] = 0
        out = np.where(rounded > 65504, np.inf, rounded)
    out[np.isinf(size)] = np.inf
    bits = np.where(np.isnan(size), 0, out).astype("<f2").view("<u2")
    raw = x.view("<u4")
    payload = (raw >> 13 & 0x3FF).astype("<u2")
    bits = np.where(np.isnan(size), 0x7C00 | np.where(payload == 0, 1, payload), bits)
    return (bits | (raw >> 31 << 15)).astype("<u2")


def decode_f16(bits) -> np.ndarray:
    return np.asarray(bits, "<u2").view("<f2").astype("<f4")


def pack(rows, fmt: str | None = None) -> bytes:
    flat = np.asarray(rows, "<f4").ravel()
    return flat.tobytes() if normalize_format(fmt) == "f32" else encode_f16(flat).tobytes()


def unpack(blob: bytes, dim: int, fmt: str | None = None) -> np.ndarray:
    """The rows of ``dim`` floats in ``blob``."""
    if dim < 1:
        raise InvalidOption("dim must be positive")
    width = 4 if normalize_format(fmt) == "f32" else 2
    if len(blob) % (dim * width):
        raise InvalidOption(f"{len(blob)} bytes are no multiple of {dim} x {width}")
    return (np.frombuffer(blob, "<f4") if width == 4 else decode_f16(np.frombuffer(blob, "<u2"))).reshape(-1, dim)


def pack_column(vec: Column | str, fmt: str | None = None) -> Column:
    name = normalize_format(fmt)

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda v: None if v is None else pack(v, name))

    return run(vec)


def unpack_column(blob: Column | str, dim: int, fmt: str | None = None) -> Column:
    name = normalize_format(fmt)

    @F.pandas_udf("array<array<float>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda b: None if b is None else unpack(b, dim, name).tolist())

    return run(blob)


def f16_column(x: Column) -> Column:
    """The value of a finite double after 16-bit rounding, in built-in functions."""
    size = F.abs(x)
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)), F.lit(-14)) - 10)
    return F.when(size < 2.0**-25, F.lit(0.0)).otherwise(F.signum(x) * F.floor(size / step + 0.5) * step)
