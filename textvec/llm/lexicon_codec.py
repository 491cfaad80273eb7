"""Operator 7, BPE encoding and decoding with a minimal acyclic transducer.

The most frequent pieces of the corpus, counted over all documents, are compiled into the smallest acyclic
automaton that accepts them: equal suffixes share states. Arcs carry additive outputs whose sum is a piece's number,
and the number leads to its ids. The driver compiles at most ``size`` pieces, so the broadcast image is bounded by
that parameter; a Python worker writes it once to an unlinked temporary file and maps it into memory. Pieces walk
the arcs together, a letter at a time. Pieces that the lexicon lacks are merged exactly (`bpe.Bpe.merge`)."""

from __future__ import annotations

import hashlib
import mmap
import tempfile
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textvec.llm.bpe import chunks, load
from textvec.llm.shared import stash

#: Steps of counts to a doubling, by which frequent pieces are told.
STEPS = 16

_MAPPED: dict[str, "Lexicon"] = {}


def compile_lexicon(entries: dict[bytes, bytes]) -> bytes:
    """The memory image of the minimal transducer of ``entries`` (piece -> ids, both as bytes)."""
    words = sorted(entries)
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(states)
            states.append(key)
        return known[key]

    path: list[list] = [[False, []]]
    before = b""
    for word in words:
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        while len(path) > same + 1:
            node = path.pop()
            path[-1][1].append((before[len(path) - 1], settle(node)))
        for _ in word[same:]:
            path.append([False, []])
        path[-1][0] = True
        before = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((before[len(path) - 1], settle(node)))
    root = settle(path[0])
    count = np.zeros(len(states), np.int64)  # words accepted from each state; targets have smaller numbers
    keys, targets, adds = [], [], []
    for s, (final, arcs) in enumerate(states):
        total = int(final)
        for letter, to in arcs:
            keys.append((s << 8) | letter)
            targets.append(to)
            adds.append(total)
            total += int(count[to])
        count[s] = total
    ids = [entries[w] for w in words]
    parts = [
        np.array([root], np.int64), np.array(keys, np.int64), np.array(targets, np.int32), np.array(adds, np.int32),
        np.array([f for f, _ in states], np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64), np.frombuffer(b"".join(ids), np.uint8),
    ]
    head = np.array([len(p.tobytes()) for p in parts], np.int64).tobytes()
    return head + b"".join(p.tobytes() + bytes(-len(p.tobytes()) % 8) for p in parts)


class Lexicon:
    """A compiled lexicon in mapped memory."""

    def __init__(self, image: bytes):
        with tempfile.TemporaryFile() as f:  # has no name, so nothing stays behind
            f.write(image)
            f.flush()
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(data, np.int64, 7)
        at, parts = 56, []
        for size, kind in zip(sizes.tolist(), (np.int64, np.int64, np.int32, np.int32, np.uint8, np.int64, np.uint8)):
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size + -size % 8
        self.root, self.keys, self.targets, self.adds, self.final, self.starts, self.ids = parts
        self.root = int(self.root[0])

    def find(self, pieces: list[str]) -> list[bytes | None]:
        """The ids of each piece, or None where the lexicon lacks it."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        if not len(self.keys):
            return [None] * len(raw)
        size = np.array([len(x) for x in raw])
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        data = np.frombuffer(b"".join(raw), np.uint8)
        state, number, at = np.full(len(raw), self.root, np.int64), np.zeros(len(raw), np.int64), 0
        live = np.flatnonzero(size > 0)
        state[size == 0] = -1
        while len(live):
            key = (state[live] << 8) | data[start[live] + at]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            state[live] = np.where(hit, self.targets[arc], -1)
            number[live] += np.where(hit, self.adds[arc], 0)
            at += 1
            live = live[hit & (size[live] > at)]
        good = (state >= 0) & (self.final[np.maximum(state, 0)] > 0)
        ids = self.ids
        return [ids[self.starts[n] : self.starts[n + 1]].tobytes() if ok else None for n, ok in zip(number.tolist(), good.tolist())]


def mapped(name: str, image: bytes) -> Lexicon:
    if name not in _MAPPED:
        _MAPPED.clear()
        _MAPPED[name] = Lexicon(image)
    return _MAPPED[name]


def _count(spec, held: int) -> Callable:
    """Counts of the pieces of each task's documents, given out whenever ``held`` are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, counts = load(spec.value), Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["piece", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for at in range(0, len(batch), 256):
                for text in batch.column("text").slice(at, 256).to_pylist():
                    for part in bpe.split.split(text or ""):
                        if part not in bpe.special:
                            counts.update(bpe.byte_pieces(part))
                    if len(counts) > held:
                        yield out()
        if counts:
            yield out()

    return run


def frequent_pieces(docs: DataFrame, tokenizer_json: str, size: int, text_col: str = "text") -> list[str]:
    """The most frequent pieces of all texts, ``size`` at most; those seen once are left out.

    Counts are summed up by STEPS steps to a doubling. The pieces from the lowest step on with which there are not more
    than ``size`` come to the driver, and no others."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count(spec, 200_000), "piece string, n long")
    step = F.floor(F.log2("n") * STEPS).cast("int")
    total = stash(counts.groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1").withColumn("step", step), "pieces")
    left, least = size, None
    for r in sorted(total.groupBy("step").count().collect(), key=lambda r: -r.step):  # 63 * STEPS rows at most
        left -= r["count"]
        if left < 0:
            break
        least = r.step
    if least is None:
        return []
    return sorted(r.piece for r in total.where(F.col("step") >= least).select("piece").collect())


def encode(bpe, lexicon: Lexicon | None, texts: list[str], memo: int) -> list[bytes]:
    """The ids of each text as little-endian 32-bit integers."""
    runs, plan = [], []  # stretches between special tokens, and for each text its stretches and special ids
    for text in texts:
        own: list[int | bytes] = []
        for part in bpe.split.split(text):
            if part in bpe.special:
                own.append(bpe.special[part].to_bytes(4, "little"))
            else:
                own.append(len(runs))
                runs.append(bpe.byte_pieces(part))
        plan.append(own)
    ids = bpe.encode(runs, memo, lexicon and lexicon.find)
    return [ids[own[0]] if len(own) == 1 and isinstance(own[0], int) else b"".join(x if isinstance(x, bytes) else ids[x] for x in own) for own in plan]


def decode(bpe, ids: bytes) -> str:
    """The text of ``ids``, special tokens included; bytes that are not UTF-8 become U+FFFD."""
    return b"".join(map(bpe.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _round_trip(spec, image, name: str, memo: int, keep_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, lexicon = load(spec.value), mapped(name, image.value)
        for batch in batches:
            at = 0
            for texts in chunks(x.as_py() for x in batch.column("text")):
                rows = batch.slice(at, len(texts))
                at += len(texts)
                n, ids_sha, text_sha, ids = [], [], [], []
                for x in encode(bpe, lexicon, texts, memo):
                    n.append(len(x) // 4)
                    ids_sha.append(hashlib.sha256(x).hexdigest())
                    text_sha.append(hashlib.sha256(decode(bpe, x).encode("utf-8", "surrogatepass")).hexdigest())
                    if keep_ids:
                        ids.append(np.frombuffer(x, "<u4").astype(np.int64))
                cols = [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.list_(pa.int64()))] if keep_ids else []), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    return run


def bpe_codec(docs: DataFrame, tokenizer_json: str, size: int = 65_536, memo: int = 300_000, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode it again: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if ``keep_ids``, ids.

    ``tokenizer_json`` is the content of a byte-level BPE tokenizer file, ``size`` bounds the lexicon and ``memo``
    a worker's memo of pieces; neither changes a result. Null is the empty text, with no ids. Repeated rows and ids
    are encoded row by row; other columns are ignored."""
    sc = docs.sparkSession.sparkContext
    bpe = load(tokenizer_json)
    pieces = frequent_pieces(docs, tokenizer_json, size, text_col)
    entries = {p.encode("utf-8", "surrogatepass"): x for at in range(0, len(pieces), 20_000) for part in [pieces[at : at + 20_000]] for p, x in zip(part, bpe.merge(part))}
    image = compile_lexicon(entries)
    spec, shared, name = sc.broadcast(tokenizer_json), sc.broadcast(image), hashlib.sha256(image).hexdigest()
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_round_trip(spec, shared, name, memo, keep_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * keep_ids)
