"""Embedding of a stream: stateless, so the batch kernel applies and no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textvec.operators.embed import Kernel


def embed_stream(stream: DataFrame, kernel: Kernel, text_col: str = "text") -> DataFrame:
    """The stream with a struct column ``embedded`` of vector and token counts."""
    return stream.withColumn("embedded", kernel.embed_with_stats(text_col))


def write_stream(embedded: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to a parquet folder, each input once."""
    out = embedded.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
