"""What the operators of this package share: scratch tables, link components, text hashing."""

from __future__ import annotations

import atexit
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RUNS: dict[str, str] = {}
#: Tables in the catalogue that this session has made.
_TABLES_MADE: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A folder of this session's own below ``spark.checkpoint.dir``; in local mode without it, below the temp folder."""
    app = spark.sparkContext.applicationId
    if app not in _RUNS:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="textvec-")
        _RUNS[app] = f"{root.rstrip('/')}/textvec-{uuid.uuid4().hex}"
        atexit.register(sweep, spark, _RUNS[app])
    return _RUNS[app]


def sweep(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder and the catalogue's entries of its tables; silent once the session has ended."""
    try:
        for name in _TABLES_MADE:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        pass


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends there, and a lost executor costs nothing.

    Shuffle files of finished steps are released, which Spark does for those that the driver's memory no longer holds."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    schema = df.schema
    del df
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def bucketed(df: DataFrame, key: str, dealt: bool = False) -> DataFrame:
    """``df`` written to the scratch folder in buckets of ``key``: joins on it read them without a shuffle.

    ``dealt`` says that its last shuffle was by ``key`` already, so that none is needed for few files."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"textvec_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(n, key)
    _TABLES_MADE.append(name)
    rows.write.bucketBy(n, key).option("path", f"{scratch(spark)}/{name}").option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (id, component) per end, component = smallest id.

    Minimum labels spread along the edges and are then followed to their own label, so a chain of n links
    settles in about log n rounds. Every round is two aggregations and is written to the scratch folder.
    No edges give no rows; loops and repeated edges are harmless."""
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stash(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        step = stash(step, "step")
        up = step.select(F.col("id").alias("u"), F.col("label").alias("up"))
        step = stash(step.join(up, step.label == up.u).select("id", F.col("up").alias("label"), "old"), "labels")
        labels = step.select("id", "label")
        if not step.where("label <> old").limit(1).count():
            return labels.select("id", F.col("label").alias("component"))


# ---- hashing of words, whole chunks at a time -------------------------------------------------------------

_CHUNK = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_TABLES: dict[str, np.ndarray] = {}
#: Bytes of a word that are hashed by a polynomial.
LONG = 64
#: Fixed value: the bytes that separate words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _tables(n: int) -> dict[str, np.ndarray]:
    """Letter values, and powers of the base and of its inverse up to ``n``."""
    if "letter" not in _TABLES:
        low = np.arange(256, dtype=np.uint64)
        low[65:91] += _U(32)
        _TABLES["letter"] = mix(low + _U(0x51ED270B)) | _U(1)
        space = np.zeros(256, bool)
        space[list(SPACES)] = True
        _TABLES["space"] = space
    if len(_TABLES.get("power", ())) < n:
        size = max(n, _CHUNK + (_CHUNK >> 3))
        step = np.full(size, _BASE, np.uint64)
        step[0] = 1
        _TABLES["power"] = np.cumprod(step)
        step[1:] = _U(pow(int(_BASE), -1, 1 << 64))
        _TABLES["inverse"] = np.cumprod(step)
    return _TABLES


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of ``data``; A-Z count as a-z.

    Words of up to LONG bytes are hashed by a polynomial modulo 2^64. There are longer words that differ and have the
    same polynomial whatever its base, so longer words take a cryptographic hash each."""
    raw = np.frombuffer(data, np.uint8)
    t = _tables(len(raw) + 1)
    inside = np.concatenate(([False], ~t["space"][raw], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(t["letter"][raw] * t["power"][: len(raw)], out=total[1:])
    hashes = mix((total[end] - total[start]) * t["inverse"][start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG):
        word = data[start[i] : end[i]].lower()
        hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return start, hashes


def _long(data: bytes) -> np.ndarray:
    """Word hashes of one long text, in pieces cut at spaces."""
    out, at = [], 0
    while at < len(data):
        to = min(len(data), at + _CHUNK)
        while to < len(data) and data[to] not in SPACES:
            to += 1
        out.append(_words(data[at:to])[1])
        at = to
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text, in order, the hashes of its words; null and blank texts give none."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if held:
            start, hashes = _words(b" ".join(held))
            ends = np.cumsum([len(x) + 1 for x in held])
            yield from np.split(hashes, np.searchsorted(start, ends[:-1]))

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > _CHUNK:
            yield from flush()
            held, size = [], 0
            yield _long(data)
            continue
        held.append(data)
        size += len(data)
        if size > _CHUNK:
            yield from flush()
            held, size = [], 0
    yield from flush()


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; a shorter text is one shingle, no words none."""
    if not len(words):
        return words
    runs = max(1, len(words) - width + 1)
    take = min(width, len(words))
    out = np.full(runs, take, np.uint64)
    for j in range(take):
        out = mix(out * _U(0xD1342543DE82EF95) + words[j : j + runs])
    return np.unique(out)
