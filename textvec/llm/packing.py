"""Operator 9, packing by Karmarkar-Karp multiway differencing.

Documents are cut every ``window`` ids. Whole windows are sequences of their own; the tails are dealt by a hash
into groups of about ``GROUP`` windows, and a group is packed in one task from lengths alone. Multiway differencing
keeps partial partitions in a heap and joins the two with the largest imbalance, the largest sums of one with the
smallest of the other; if a window then exceeds its capacity, the count of windows rises and the group is
partitioned anew. One tail in eight is kept back and cut into powers of two; these fill what the windows leave
open, and the rest of them makes full windows and, at the end, sequences whose length is a power of two."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textvec.llm.bpe import chunks, load
from textvec.llm.shared import stash

#: Windows of a group, about.
GROUP = 256


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """``k`` sets of the indices of ``sizes`` with nearly equal sums."""
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        large, small = a[2], b[2]  # both with falling sums; what is missing to k sets is empty
        over = max(0, len(large) + len(small) - k)
        met = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(large[len(large) - over :], reversed(small[len(small) - over :]))] if over else []
        both = large[: len(large) - over] + met + small[: len(small) - over]
        both.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (-(both[0][0] - (both[-1][0] if len(both) == k else 0)), min(a[1], b[1]), both))
    sets = [m for _, m in heap[0][2]] if heap else []
    return sets + [[] for _ in range(k - len(sets))]


def pack(tails: list[int], window: int) -> list[list[tuple[int, int | None]]]:
    """Sequences as lists of (tail, chunk): chunk None for the whole tail, else the bit that the chunk stands for."""
    order = sorted(range(len(tails)), key=lambda i: (-tails[i], i))
    spare, whole = order[::8], [i for n, i in enumerate(order) if n % 8]
    sizes = [tails[i] for i in whole]
    k = -(-sum(sizes) // window)
    sets = differencing(sizes, k)
    while k and max(sum(sizes[i] for i in s) for s in sets) > window:
        k += max(1, k // 64)
        sets = differencing(sizes, k)
    out: list[list[tuple[int, int | None]]] = [[(whole[i], None) for i in s] for s in sets if s]
    pool: dict[int, list[tuple[int, int]]] = {b: [] for b in range(window.bit_length())}
    for i in spare:
        for b in pool:
            if tails[i] >> b & 1:
                pool[b].append((i, b))

    def fill(sequence: list, room: int) -> int:
        for b in sorted(pool, reverse=True):
            while room >= 1 << b and pool[b]:
                sequence.append(pool[b].pop())
                room -= 1 << b
        return room

    for sequence in sorted(out, key=lambda s: sum(tails[i] for i, _ in s)):
        fill(sequence, window - sum(tails[i] for i, _ in sequence))
    left = sum(len(x) << b for b, x in pool.items())
    while left >= window:
        out.append([])
        left -= window - fill(out[-1], window)
    for b in sorted(pool, reverse=True):
        if left >> b & 1:
            out.append([])
            fill(out[-1], 1 << b)
    return out


def _crc(ids: bytes) -> int:
    return zlib.crc32(ids)


def _encode(spec, window: int, end_id: int, memo: int) -> Callable:
    """Per document its whole windows and its tail; a tail also has the checksums of its powers of two."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(spec.value)
        for batch in batches:
            at = 0
            for texts in chunks(x.as_py() for x in batch.column("text")):
                keys = batch.column("doc_id").slice(at, len(texts)).to_pylist()
                at += len(texts)
                pieces = [bpe.word_pieces(t) for t in texts]
                encoded, rows = bpe.encode([p or [] for p in pieces], memo), []
                for doc, text, own, done in zip(keys, texts, pieces, encoded):
                    if own is None:
                        ids = np.array(bpe.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + end
                    else:
                        ids = done + end
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        part = ids[4 * start : 4 * (start + window)]
                        size, bits, from_ = len(part) // 4, [], 0
                        if size < window:
                            for b in reversed(range(size.bit_length())):
                                if size >> b & 1:
                                    bits.append(_crc(part[4 * from_ : 4 * (from_ + (1 << b))]))
                                    from_ += 1 << b
                        rows.append((doc, start, size, _crc(part), n, bits))
                cols = list(zip(*rows)) or [[]] * 6
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bits"])

    return run


def _pack(window: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        doc, start, length, crc, total = (table[c].to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens"))
        bits = table["bits"].to_pylist()
        base = key[0].as_py() << 32
        rows, number = [], 0
        for i, n in enumerate(length):
            if n == window:
                rows.append((doc[i], start[i], n, crc[i], total[i], base + number, 0))
                number += 1
        tails = [i for i, n in enumerate(length) if n < window]
        for sequence in pack([length[i] for i in tails], window):
            at = 0
            for t, b in sequence:
                i = tails[t]
                n = length[i] if b is None else 1 << b
                higher = 0 if b is None else length[i] >> (b + 1) << (b + 1)
                rows.append((doc[i], start[i] + higher, n, crc[i] if b is None else bits[i][higher.bit_count()], total[i], base + number, at))
                at += n
            number += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table({c: pa.array([r[j] for r in rows], pa.int64()) for j, c in enumerate(names)})

    return run


def packing(docs: DataFrame, tokenizer_json: str, window: int = 2048, end_id: int = 1, memo: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids (a power of two): doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset.

    Ids come from a BPE tokenizer of lower-cased words, then ``end_id``. A null text is empty: its one id is
    ``end_id``. Repeated rows are packed row by row; other columns are ignored."""
    if window < 2 or window & (window - 1):
        raise ValueError("window must be a power of two")
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = stash(slim.mapInArrow(_encode(spec, window, end_id, memo), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bits array<long>"), "pieces")
    total = pieces.where(F.col("length") < window).agg(F.sum("length").alias("n")).first().n or 0
    groups = max(1, -(-total // (window * GROUP)))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("part").applyInArrow(_pack(window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
