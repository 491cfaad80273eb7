"""Bytes as text. Only UTF-8 and ASCII are read as they are; other encodings have to be named and decoded first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textvec.errors import EncodingError

_LABELS = {"utf-8", "utf8", "us-ascii", "ascii"}


def text_column(raw: Column | str, label: str = "UTF-8") -> Column:
    """The string of binary ``raw``. Bytes that are not in the encoding fail the query; a null stays null."""
    if label.lower() not in _LABELS:
        raise EncodingError(f"expected UTF-8 or US-ASCII, not {label!r}; transcode first")
    raw = F.col(raw) if isinstance(raw, str) else raw
    text = F.validate_utf8(raw.cast("string"))
    if "ascii" not in label.lower():
        return text
    return F.when(F.octet_length(raw) == F.char_length(text), text).when(text.isNotNull(), F.raise_error(F.lit("bytes that are no ASCII")))
