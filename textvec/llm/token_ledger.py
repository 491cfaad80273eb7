"""Operator 6, token counts in delta-maintained rollups.

A ledger is a folder of committed batches and of totals. A batch holds signed changes of documents and tokens for each
source, language and tokenizer version: an insert adds, a delete subtracts, a revision does both. A batch is written
under a name of its own and renamed, which fails if its name is taken: committing a name again changes nothing,
whoever does it, and a broken attempt leaves no batch. Each commit then adds the new batches to the newest totals and
writes totals of the next number, with the names of the batches in them, so a change costs its own size and that of the
totals, not that of the history. If two committers write the same number, one of them loses; a batch that the newest
totals do not name is added when they are read, so what is read is right at any time."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textvec.llm.bpe import chunks, load

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
#: The version name of plain words, runs of other characters than ASCII white space.
WORDS = "words-1"


def _count(specs: dict) -> Callable:
    """Sums of a task's documents for each source, language and tokenizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpes = {name: load(spec.value) for name, spec in specs.items()}
        total: dict[tuple, list[int]] = {}

        def out() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in total.items()]
            total.clear()
            kinds = [pa.string()] * 3 + [pa.int64()] * 2
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], [*KEYS, "docs", "tokens"])

        for batch in batches:
            at = 0
            for texts in chunks(x.as_py() for x in batch.column("text")):
                keys = list(zip(*(batch.column(c).slice(at, len(texts)).to_pylist() for c in ("source", "lang"))))
                at += len(texts)
                counts = {WORDS: [len(t.encode("utf-8", "surrogatepass").split()) for t in texts]}
                for name, bpe in bpes.items():
                    pieces = [bpe.word_pieces(t) for t in texts]
                    ids = bpe.encode([p or [] for p in pieces], 400_000)
                    counts[name] = [len(x) // 4 if p is not None else len(bpe.library.encode(t, add_special_tokens=False).ids) for p, x, t in zip(pieces, ids, texts)]
                for name, own in counts.items():
                    for key, n in zip(keys, own):
                        cell = total.setdefault((*key, name), [0, 0])
                        cell[0] += 1
                        cell[1] += n
                if len(total) > 100_000:
                    yield out()
        if total:
            yield out()

    return run


def count_tokens(docs: DataFrame, tokenizers: dict[str, str], sign: int = 1, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The change that inserting (``sign`` 1) or deleting (-1) ``docs`` makes: source, lang, tokenizer, docs, tokens.

    ``tokenizers`` maps version names to the content of tokenizer files of lower-cased words; plain words are always
    counted. A null text counts as a document without tokens; null sources and languages are groups of their own.
    Repeated rows count as often as they occur."""
    specs = {name: docs.sparkSession.sparkContext.broadcast(text) for name, text in tokenizers.items()}
    slim = docs.select(*(F.col(c).cast("string").alias(n) for c, n in ((text_col, "text"), (source_col, "source"), (lang_col, "lang"))))
    sums = slim.mapInArrow(_count(specs), SCHEMA).groupBy(*KEYS)
    return sums.agg((F.sum("docs") * sign).alias("docs"), (F.sum("tokens") * sign).alias("tokens"))


def revision(before: DataFrame, after: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """The change that replaces the documents ``before`` by ``after``."""
    return count_tokens(before, tokenizers, -1).unionByName(count_tokens(after, tokenizers))


def negated(change: DataFrame) -> DataFrame:
    """The change that takes ``change`` back."""
    return change.withColumn("docs", -F.col("docs")).withColumn("tokens", -F.col("tokens"))


def _summed(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return sums.where("docs <> 0 or tokens <> 0")


class Ledger:
    """Committed batches of changes and their totals, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        fs = self._fs()
        names = [x.getPath().getName() for x in fs.listStatus(self._at(""))] if fs.exists(self._at("")) else []
        return sorted(n.removeprefix(kind) for n in names if n.startswith(kind))

    def _publish(self, rows: DataFrame, name: str) -> bool:
        """Write ``rows`` and give them their name; False, and nothing stays, if the name is taken."""
        part = f"part-{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(f"{self.path}/{part}")
        jvm = self.spark._jvm
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._at(part), self._at(name), plain)
        except Py4JJavaError:
            self._fs().delete(self._at(part), True)
            if not self._fs().exists(self._at(name)):
                raise
            return False
        return True

    def batches(self) -> list[str]:
        """The names of the committed batches, in order."""
        return self._names("batch-")

    def _newest(self) -> tuple[int, DataFrame | None, set[str]]:
        """Number, rows and batch names of the newest totals."""
        numbers = sorted(map(int, self._names("totals-")))
        if not numbers:
            return 0, None, set()
        rows = self.spark.read.schema(SCHEMA + ", batch string").parquet(f"{self.path}/totals-{numbers[-1]}")
        return numbers[-1], rows.where("batch is null").drop("batch"), {r.batch for r in rows.where("batch is not null").select("batch").collect()}

    def commit(self, name: str, change: DataFrame) -> bool:
        """Add a batch; False if a batch of this name is there already, whatever it holds."""
        if not name or not all(c.isalnum() or c in "-_." for c in name):
            raise ValueError(f"no batch name: {name!r}")
        fresh = name not in self.batches() and self._publish(_summed(change.select(*KEYS, "docs", "tokens")), f"batch-{name}")
        self.maintain()
        return fresh

    def maintain(self) -> None:
        """Bring the totals up to date; those before the last two are removed."""
        number, _, included = self._newest()
        names = self.batches()
        if set(names) <= included:
            return
        marks = self.spark.createDataFrame([(n,) for n in names], "batch string")
        empty = [F.lit(None).cast(kind).alias(c) for c, kind in (x.split(" ") for x in SCHEMA.split(", "))]
        self._publish(self._sum(names).withColumn("batch", F.lit(None).cast("string")).unionByName(marks.select(*empty, "batch")), f"totals-{number + 1}")
        for old in self._names("totals-"):
            if int(old) < number:
                self._fs().delete(self._at(f"totals-{old}"), True)

    def _sum(self, names: list[str]) -> DataFrame:
        _, rows, included = self._newest()
        new = [f"{self.path}/batch-{n}" for n in names if n not in included]
        if new:
            more = self.spark.read.schema(SCHEMA).parquet(*new)
            rows = more if rows is None else rows.unionByName(more)
        return _summed(rows if rows is not None else self.spark.createDataFrame([], SCHEMA))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all batches; groups that have come to nothing are left out."""
        return self._sum(self.batches())
