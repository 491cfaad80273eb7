"""Operator 1, n-gram Jaccard join: all pairs of documents whose shingle sets are within a Jaccard distance.

The Jaccard distance 1 - |x & y| / |x | y| is a metric, and so is the size of the symmetric difference. Both
are used, in three layers, each exact:

* *Cells.* Texts meet only by sizes in levels that grow by ``grow``: linked texts are in the same or in neighbouring
  levels, and a text near the upper end of its level is replicated to the next one (the triangle-inequality window
  around the empty set). Within a level there are two kinds of cells, and the similarity decides which is used:

  - *Parts*, if they hold PART shingles or more on average, as for 0.9. In a level, linked sets differ in D
    shingles at most. Hashes deal the shingles to more than D parts, and a part that holds no difference is equal in
    both: each part with all its shingles is a cell. Parts of fewer than two shingles are *weak*. A text with fewer
    weak parts than parts in excess of D has an equal part that is not weak with each partner, so its weak parts make
    no cells; a text with more of them shows all. Unrelated texts hardly ever meet, so candidates do not grow
    faster than the input.
  - *Rare shingles*, for lower similarities, where parts would be too small. The overlap of a linked pair is at least
    t of either set. So in any order that all texts have in common, the first n - ceil(t * n) + 1 shingles of both
    sets meet in one, and each of these is a cell. The order is by frequency: common shingles come last, so texts that
    only share a common passage or phrase do not meet. Frequencies are counted over all documents, in windows of
    WINDOW shingles, each of which reports what it has seen LEAST times; the COMMON most frequent are ranked. A
    shingle that is missed is in the place of a rare one: no link is lost.
* *Regions.* The smallest document of a cell is its pivot; the documents that share cells with a pivot are its
  region, and every linked pair is in a common region. A small region is joined in memory: pivots, Voronoi
  regions, replication to each pivot whose distance is within twice the radius of the nearest, recursion.
  Before that, histograms of the hashes, whose differences are a lower bound of the distance, rule out most texts,
  so that few sets have to travel.
* *Recursion.* A large region is never gathered. Its texts are compared with the pivot and then stand for their
  symmetric differences with it, which keeps all distances. By the triangle inequality the sizes a and b of two
  linked differences are at most D apart, and unless the pivot connects both they share at least (a + b - D) / 2
  elements, so one of the rarest a - (a + b - D) / 2 + 1 of each. Those elements, by classes of a and b, make new
  cells with pivots of their own.

Texts with equal sets are one class throughout. Every text is first compared with the smallest of its pivots, and regions
that are one such pair are done. `jaccard_links` and `jaccard_join` find every link between classes: small regions are
joined as said, and of a large one each two blocks of BLOCK texts meet in a task. `jaccard_components` asks for no link
that only repeats a component: regions, and later cells, that known links already connect are left out, and large
regions go through the recursion. Links become components by `shared.components`."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textvec.llm.shared import bucketed, components, mix, shingle_set, stash, word_hashes

#: Regions of up to so many texts and shingles (32 MB) are joined in one task; larger ones are split further.
REGION, WEIGHT = 1024, 1 << 22
#: Bits of the bitmap of candidates (8 MB), through which their texts are found without moving the others. When more
#: candidates fill it, more sets travel than are needed; none is missed.
SLOTS = 1 << 26
#: Texts that are compared with a pivot in one task.
SALTED = 1024
#: Texts of a block, of which each two of a large region are compared for all links.
BLOCK = 512
#: Classes of copies that are broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST = 1 << 20
#: Fingerprints that a task remembers to show copies once.
SHOWN = 1 << 17
#: Shingles that are counted together in a task's memory, and how often one must come among them to be reported.
WINDOW, LEAST = 1 << 21, 3
#: Most shingles that are ranked by frequency (2 MB, broadcast); all others rank as rare ones.
COMMON = 1 << 17
#: Shingles of an average part, from which on parts are the cells; how levels of sizes grow then, and parts a difference.
PART, GROW, SPARE = 4, 1.5, 1.2
_U = np.uint64


class Bound:
    """What a similarity of ``num / den`` or more says about sizes."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the similarity must be in (0, 1]")
        self.num, self.den = num, den
        self.parts = 2 * PART * GROW * SPARE * (den - num) <= den + num
        grow = GROW if self.parts else 2
        self.levels = [1]
        while self.levels[-1] < 1 << 40:
            b = self.levels[-1]
            self.levels.append(max(int(grow * b), b + 1, -(-b * den // num)))

    def differ(self, total: int) -> int:
        """Most shingles in which a linked pair of ``total`` shingles can differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def overlaps(self, n: int) -> list[tuple[int, int]]:
        """The size levels in which a set of ``n`` meets linked ones, and how many shingles they share at least."""
        k = int(np.searchsorted(self.levels, n, "right")) - 1
        out, b = [(k, -(-n * self.num // self.den))], self.levels[k + 1]
        if n * self.den // self.num >= b:
            out.append((k + 1, -(-(n + b) * self.num // (self.num + self.den))))
        return out

    def cells(self, shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The cells of a set, sorted as ``shingles`` and ``common`` are: parts, or else the rarest shingles, of each level."""
        if self.parts:
            return np.concatenate([self._parts(shingles, level) for level, _ in self.overlaps(len(shingles))])
        order = shingles
        if len(common):
            at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
            known = common[at] == shingles
            rest, often = shingles[known], counts[at[known]]
            order = np.concatenate((shingles[~known], rest[np.argsort(often, kind="stable")]))
        n = len(shingles)
        return np.concatenate([mix(order[: n - least + 1] + _U(level)) for level, least in self.overlaps(n)])

    def _parts(self, shingles: np.ndarray, level: int) -> np.ndarray:
        most = self.differ(2 * (self.levels[level + 1] - 1))
        parts = max(most + 1, int(most * SPARE))
        spread = mix(shingles + _U(level))
        part = ((spread >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
        size = np.bincount(part, minlength=parts)
        order = np.argsort(part, kind="stable")
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(mix(spread)[order])))
        ends = np.cumsum(size)
        whole = mix(sums[ends] - sums[ends - size] + mix(np.arange(parts, dtype=_U) + _U(level << 40)))
        strong = size > 1
        return whole[strong] if parts - most > parts - np.count_nonzero(strong) else whole


def _shingles(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    texts = batch.column("text")
    for at in range(0, len(texts), 256):
        for words in word_hashes(texts.slice(at, 256).to_pylist()):
            yield shingle_set(words, width)


def _print(s: np.ndarray, empty: bytes = b"") -> bytes:
    return hashlib.blake2b(s.tobytes() if len(s) else empty, digest_size=16).digest()


def _frequent(sets: list[np.ndarray]) -> pa.RecordBatch:
    """A window's frequent shingles, in the columns of sketches: (shingle, count, null, null, null)."""
    values, counts = np.unique(np.concatenate([*sets, np.empty(0, _U)]), return_counts=True)
    some = counts >= LEAST
    none = pa.nulls(int(some.sum()), pa.int64())
    cols = [pa.array(values[some].view(np.int64)), pa.array(counts[some].astype(np.int64)), none, none, pa.nulls(len(none), pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "f1", "f2", "hist"])


def _histogram(s: np.ndarray) -> bytes:
    """How many shingles fall into each of 256 equal ranges, 255 at most. The sum of all differences between two
    histograms is no more than the sets' symmetric difference."""
    return np.minimum(np.bincount((s >> _U(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def _sketch(width: int, often: bool) -> Callable:
    """Per document: size, fingerprint and histogram of its set. If ``often``, further rows without a fingerprint: shingles
    that are frequent in a window, and how often. Copies within a window count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        total = 0
        for batch in batches:
            sizes, prints, hists = [], [], []
            for i, s in enumerate(_shingles(batch, width)):
                sizes.append(len(s))
                hists.append(_histogram(s))
                prints.append(_print(s, b"empty %d %d" % (batch.column("doc_id")[i].as_py() or 0, i)))
                if often and len(s) and prints[-1] not in held:
                    held[prints[-1]] = s
                    total += len(s)
                    if total >= WINDOW:
                        yield _frequent(list(held.values()))
                        held, total = {}, 0
            f = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(hists, pa.binary())], ["doc_id", "n", "f1", "f2", "hist"])
        yield _frequent(list(held.values()))

    return run


def _ranked(sketches: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their counts: COMMON of them at most."""
    counts = sketches.where("f1 is null").groupBy(F.col("doc_id").alias("e")).agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "e").limit(COMMON).toArrow()
    values = top["e"].to_numpy().view(_U)
    order = np.argsort(values)
    return values[order], top["n"].to_numpy()[order]


def _entries(width: int, bound: Bound, ranked) -> Callable:
    """The cells of each text as (id, sig). Copies within a task are shown once, like a map-side combine; the memory
    of what was shown is emptied when full, after which a copy is shown again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown: set[bytes] = set()
        common, often = ranked.value
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                sigs, ids = [np.empty(0, _U)], batch.column("doc_id").to_numpy()
                counts = np.zeros(len(batch), np.int64)
                for i, s in enumerate(_shingles(batch, width)):
                    if len(s) and (key := _print(s)) not in shown:
                        if len(shown) >= SHOWN:
                            shown.clear()
                        shown.add(key)
                        sigs.append(bound.cells(s, common, often))
                        counts[i] = len(sigs[-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(np.concatenate(sigs).view(np.int64))], ["id", "sig"])

    return run


def _slots(ids: DataFrame) -> bytes:
    """A bitmap of fixed size with the hash of every id: what is not in it is not among ``ids``."""
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS))
    words = ids.select(slot.alias("b")).groupBy(F.expr("b div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(SLOTS // 64, np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out.tobytes()


def _sets(width: int, slots) -> Callable:
    """The sets of the texts that the bitmap may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(slots.value, np.int64)
        for whole in batches:
            slot = whole.column("slot").to_numpy()
            some = whole.filter(pa.array((words[slot // 64] >> (slot % 64)) & 1 == 1))
            for at in range(0, len(some), 1024):
                batch = some.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in _shingles(batch, width)], pa.binary())], ["id", "shingles"])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))


def region_links(ids: list[int], sets: list[np.ndarray], num: int, den: int, every: bool = False) -> list[tuple[int, int]]:
    """Every link within a region, or else links that connect all that is linked: Voronoi regions around pivots, joined recursively; texts
    whose distances to the nearest and to another pivot differ by up to twice the radius are members of both. Unless
    ``every`` link is asked for, texts that found links connect already are not compared."""
    radius = 1 - num / den
    seen: dict[tuple[int, int], float] = {}
    links = []
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def distance(i: int, j: int) -> float:
        if i == j:
            return 0.0
        key = (i, j) if i < j else (j, i)
        if key not in seen:
            both = _common(sets[i], sets[j])
            union = len(sets[i]) + len(sets[j]) - both
            seen[key] = 1 - both / union
            if den * both >= num * union:
                links.append((ids[key[0]], ids[key[1]]))
                parent[root(i)] = root(j)
        return seen[key]

    def join(members: list[int]) -> None:
        if len(members) <= 4:
            for k, i in enumerate(members):
                for j in members[k + 1 :]:
                    if every or root(i) != root(j):
                        distance(i, j)
            return
        pivots = [members[0]]
        near = [distance(members[0], i) for i in members]
        far = max(range(len(members)), key=near.__getitem__)
        if members[far] not in pivots:
            pivots.append(members[far])
        to = [[distance(p, i) for i in members] for p in pivots]
        parts: list[list[int]] = [[] for _ in pivots]
        for k, i in enumerate(members):
            best = min(d[k] for d in to)
            for part, d in zip(parts, to):
                if d[k] <= best + 2 * radius + 1e-9:
                    part.append(i)
        if sum(map(len, parts)) <= 1.25 * len(members) and max(map(len, parts)) < len(members):
            for part in parts:
                join(part)
            return
        for k, i in enumerate(members):  # no pivot separates these: only the windows do
            for m in range(k + 1, len(members)):
                if (every or root(i) != root(members[m])) and all(abs(d[k] - d[m]) <= radius + 1e-9 for d in to):
                    distance(i, members[m])

    join(sorted(range(len(ids)), key=ids.__getitem__))
    return links


SPAN = "a long, b long, n long"


def _span(links: list[tuple[int, int]], pivot: int, pivots: dict[int, list[int]]) -> pa.Table:
    """What a region gives of its links, in proportion to its texts: (a, b, null) for links that connect all that is linked,
    and (a, null, n) for the number of links of each text. A link of texts that also meet at a smaller pivot counts there."""
    bit: dict[int, int] = {}
    mask = {i: sum(1 << bit.setdefault(p, len(bit)) for p in own if p < pivot) for i, own in pivots.items()}
    parent: dict[int, int] = {}
    often: dict[int, int] = {}
    tree = []

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = i = parent[parent[i]]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            tree.append((a, b))
        if not mask[a] & mask[b]:
            often[a] = often.get(a, 0) + 1
            often[b] = often.get(b, 0) + 1
    cols = [a for a, _ in tree] + list(often), [b for _, b in tree] + [None] * len(often), [None] * len(tree) + list(often.values())
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip("abn", cols)})


def _join_region(num: int, den: int, every: bool = False, count: bool = False) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = region_links(table["id"].to_pylist(), [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()], num, den, every)
        if count:
            return _span(found, key[0].as_py(), dict(zip(table["id"].to_pylist(), table["pivots"].to_pylist())))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _join_blocks(bound: Bound, count: bool) -> Callable:
    """Every link between two blocks of a region (or within one): histograms rule out, then sets are compared."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, block = table["id"].to_numpy(), table["block"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        n = np.array([len(x) for x in sets], np.int64)
        hist = np.array([np.bincount((x & _U(255)).astype(np.int64), minlength=256) for x in sets], np.int32)
        low, high = (k.as_py() for k in key[1:])
        a, b = [], []
        for i in np.flatnonzero(block == low):
            to = np.flatnonzero((block == high) if low < high else (np.arange(len(ids)) > i))
            to = to[np.abs(hist[to] - hist[i]).sum(axis=1, dtype=np.int64) * (bound.den + bound.num) <= (n[to] + n[i]) * (bound.den - bound.num)]
            for j in to:
                both = _common(sets[i], sets[j])
                if bound.den * both >= bound.num * (n[i] + n[j] - both):
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
        if count:
            return _span(list(zip(map(int, a), map(int, b))), key[0].as_py(), dict(zip(ids.tolist(), table["pivots"].to_pylist())))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _block_links(large: DataFrame, sets: DataFrame, bound: Bound, count: bool) -> DataFrame:
    """Every link within large regions (pivot, id): each two blocks of a region's texts meet in one task."""
    whole = large.union(large.select("pivot", F.col("pivot").alias("id")).distinct())
    sizes = large.groupBy("pivot").agg(F.ceil((F.count(F.lit(1)) + 1) / BLOCK).alias("parts"))
    dealt = whole.join(sizes, "pivot").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("pivot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "block")
    return dealt.join(sets, "id").groupBy("pivot", "low", "high").applyInArrow(_join_blocks(bound, count), SPAN if count else "a long, b long")


def _possible(bound: Bound) -> Callable:
    """Those texts of a region that can be linked with another, by their histograms; the smallest is the new pivot."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, n = table["id"].to_numpy(), table["n"].to_numpy()
        hist = np.frombuffer(b"".join(table["hist"].to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16)
        keep = np.zeros(len(ids), bool)
        for i in range(len(ids) - 1):
            apart = np.abs(hist[i + 1 :] - hist[i]).sum(axis=1, dtype=np.int64)
            near = apart * (bound.den + bound.num) <= (n[i + 1 :] + n[i]) * (bound.den - bound.num)
            keep[i] |= near.any()
            keep[i + 1 :] |= near
        ids, n = ids[keep], n[keep]
        return pa.table({"pivot": pa.array(np.repeat(ids[:1], max(0, len(ids) - 1)), pa.int64()), "id": pa.array(ids[1:]), "n": pa.array(n[1:])})

    return run


def _class(a: int) -> int:
    """Classes of the sizes of differences, about four to a doubling: 0, 1, 2, 3, 4, 5, 6, 7, 8-9, 10-11, ..."""
    return a if a < 8 else 4 * (a.bit_length() - 2) + (a >> (a.bit_length() - 3) & 3)


def _least(c: int) -> int:
    """The smallest size of a class."""
    return c if c < 8 else (4 + (c & 3)) << (c // 4 - 1)


def _keeps(a: int, differ: int) -> list[tuple[int, int]]:
    """For each class of partner sizes, how many of the rarest of ``a`` elements a text has to show. Every
    pair that the pivot does not connect overlaps in one or more."""
    out = []
    for c in range(_class(max(0, a - differ)), _class(a + differ) + 1):
        least = max(_least(c), a - differ, 1)
        share = max(1, -(-(a + least - differ) // 2))
        if share <= a and share < _least(c + 1):
            out.append((c, a - share + 1))
    return out


def _from_pivot(bound: Bound) -> Callable:
    """Each text of a large region against its pivot: link or not, and the symmetric difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                sizes, linked, own, keep, diffs = [], [], [], [], []
                for p, x in zip(batch.column("pivot_set").to_pylist(), batch.column("shingles").to_pylist()):
                    a, b = np.frombuffer(p, np.uint64), np.frombuffer(x, np.uint64)
                    sizes.append(len(b))
                    diff = np.setxor1d(a, b, assume_unique=True)
                    both = (len(a) + len(b) - len(diff)) // 2
                    linked.append(bound.den * both >= bound.num * (len(a) + len(b) - both))
                    own.append(_class(len(diff)))
                    keep.append([{"c": c, "k": k} for c, k in _keeps(len(diff), bound.differ(len(b) + len(b) * bound.den // bound.num))])
                    diffs.append(diff.view(np.int64))
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.struct([("c", pa.int64()), ("k", pa.int64())])), pa.list_(pa.int64())]
                cols = [pa.array(c, k) for c, k in zip((sizes, linked, own, keep, diffs), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("id"), *cols], ["pivot", "id", "n", "linked", "own", "keep", "diff"])

    return run


def _star(cells: DataFrame, key: list[str], *more: str) -> DataFrame:
    """Each cell's texts with its smallest one: distinct (pivot, id), and columns that follow from id."""
    pivot = F.min("id").over(Window.partitionBy(*key))
    return cells.withColumn("pivot", pivot).where("id <> pivot").select("pivot", "id", *more).distinct()


def _with_pivot(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, id, pivot_set, shingles). A pivot's texts are dealt over tasks of about SALTED; its set goes to each."""
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / SALTED).alias("parts"))
    pivots = sizes.join(sets, sizes.pivot == sets.id).select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.col("shingles").alias("pivot_set"))
    salted = pairs.join(sizes, "pivot").select("pivot", "id", F.pmod(F.xxhash64("id"), F.col("parts")).alias("salt"))
    return salted.join(sets, "id").join(pivots, ["pivot", "salt"]).select("pivot", "id", "pivot_set", "shingles")


def _linked(num: int, den: int) -> Callable:
    """Those texts that are linked with their pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                keep = []
                for p, x in zip(batch.column("pivot_set"), batch.column("shingles")):
                    a, b = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(x.as_buffer(), np.uint64)
                    both = _common(a, b)
                    keep.append(den * both >= num * (len(a) + len(b) - both))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("pivot").filter(mask), batch.column("id").filter(mask)], ["a", "b"])

    return run


def _unsettled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of those regions whose texts are not all in one component yet."""
    labels = labels.select(F.col("id").alias("l"), "component")
    own = pairs.join(labels, pairs.id == labels.l, "left").select("pivot", F.coalesce("component", "id").alias("c"))
    seen = own.groupBy("pivot").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    seen = seen.join(labels, seen.pivot == labels.l, "left").where("low <> high or low <> coalesce(component, pivot)")
    return pairs.join(seen.select("pivot"), "pivot", "left_semi")


def jaccard_links(docs: DataFrame, width: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text", every: bool = True, count: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of documents with equal shingle sets, and the links between classes.

    Returns ``(members, links, labels)``: members(doc_id, n_shingles, rep) has a row per input row, rep being the smallest
    doc_id with the same set (null for a set without shingles); links(a, b) holds pairs of reps with
    ``den * |a & b| >= num * |a | b|``, a < b: every one of them once, or, without ``every``, enough true ones to connect every
    component, in any order and maybe repeated; labels(id, component) has the smallest reachable id of each rep that is linked.
    With ``count``, links(id, n) has the number of links of each rep instead, for which every one is verified but none travels.
    ``doc_id`` identifies a text: rows that repeat it must repeat its text. A null id has a null rep of its own
    text only if no other row has that text."""
    bound = Bound(num, den)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = stash(docs.mapInArrow(_sketch(width, not bound.parts), "doc_id long, n long, f1 long, f2 long, hist binary"), "sketches")
    ranked = docs.sparkSession.sparkContext.broadcast((np.empty(0, _U), np.empty(0, np.int64)) if bound.parts else _ranked(sketches))
    sketches = sketches.where("f1 is not null")
    classes = sketches.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    classes = stash(classes.where("rows > 1").drop("rows"), "classes")
    classes = F.broadcast(classes) if classes.count() <= BROADCAST else classes
    rep = F.when(F.col("n") > 0, F.coalesce("rep", "doc_id"))
    members = stash(sketches.join(classes, ["f1", "f2"], "left").select("doc_id", F.col("n").alias("n_shingles"), rep.alias("rep")), "members")
    entries = docs.where("doc_id is not null").mapInArrow(_entries(width, bound, ranked), "id long, sig long")
    raw = stash(_star(entries, ["sig"]), "raw")
    reps = members.where("rep is not null").select(F.col("doc_id").alias("id"), "rep", F.col("n_shingles").alias("n"))
    pairs = raw.join(reps, "id").select("pivot", F.col("rep").alias("to"), "n").join(reps.drop("n"), F.col("pivot") == reps.id)
    pairs = stash(pairs.select(F.col("rep").alias("pivot"), F.col("to").alias("id"), "n").where("id <> pivot").distinct(), "pairs")
    sized = pairs.join(pairs.groupBy("pivot").agg((F.count(F.lit(1)) < REGION).alias("fits")), "pivot")
    small = sized.where("fits").select("pivot", "id")
    small = small.union(small.select("pivot", F.col("pivot").alias("id")).distinct())
    met = small.select("id").distinct()
    hists = sketches.where("n > 0").select(F.col("doc_id").alias("id"), "n", "hist").join(met, "id", "left_semi").dropDuplicates(["id"])
    small = small.join(hists, "id").groupBy("pivot").applyInArrow(_possible(bound), "pivot long, id long, n long")
    pairs = stash(small.union(sized.where("not fits").select("pivot", "id", "n")).distinct(), "pairs")
    wanted = pairs.select("id").union(pairs.select("pivot")).distinct()
    wanted = stash(wanted, "wanted")
    slots = docs.sparkSession.sparkContext.broadcast(_slots(wanted))
    near = docs.where("doc_id is not null").withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))).mapInArrow(_sets(width, slots), "id long, shingles binary")
    sets = bucketed(near.join(wanted, "id", "left_semi").dropDuplicates(["id"]), "id", dealt=True)
    links, counts = [], []
    labels = None
    if count:
        within = pairs.select("pivot", "id").union(pairs.select("pivot", F.col("pivot").alias("id"))).distinct()
        lists = within.groupBy("id").agg(F.collect_list("pivot").alias("pivots"))
        rich = sets.join(lists, "id")
    else:
        rich = sets
    if pairs.limit(1).count():
        one = pairs.groupBy("id").agg(F.min("pivot").alias("pivot"))
        near = _with_pivot(one, sets).mapInArrow(_linked(num, den), "a long, b long")
        links.append(stash(near, "links"))
        labels = None if every else components(links[0])
        single = pairs.groupBy("pivot").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size")).where("size = 1").join(one, ["pivot", "id"], "left_semi")
        if count:
            alone = links[0].join(single.select(F.col("pivot").alias("a"), F.col("id").alias("b")), ["a", "b"], "left_semi")
            counts.append(alone.select(F.explode(F.array("a", "b")).alias("id"), F.lit(1).cast("long").alias("n")))
        pairs = pairs.join(single.select("pivot"), "pivot", "left_anti")
        pairs = stash(pairs if every else _unsettled(pairs, labels), "pairs")
    while pairs.limit(1).count():
        fits = (F.count(F.lit(1)) < REGION) & (F.sum("n") + F.max("n") * den / num <= WEIGHT)
        sized = pairs.select("pivot", "id").join(pairs.groupBy("pivot").agg(fits.alias("fits")), "pivot")
        small = sized.where("fits").select("pivot", "id")
        small = small.union(small.select("pivot", F.col("pivot").alias("id")).distinct())
        links.append(stash(small.join(rich, "id").groupBy("pivot").applyInArrow(_join_region(num, den, every, count), SPAN if count else "a long, b long"), "links"))
        if every:
            links.append(stash(_block_links(sized.where("not fits").select("pivot", "id"), rich, bound, count), "links"))
            if count:
                counts += [found.where("b is null").select(F.col("a").alias("id"), "n") for found in links[1:]]
                links[1:] = [found.where("b is not null").select("a", "b") for found in links[1:]]
            break
        known = labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links[-1])
        large = sized.where("not fits").select("pivot", "id")
        if not large.limit(1).count():
            labels = components(known)
            break
        schema = "pivot long, id long, n long, linked boolean, own long, keep array<struct<c: long, k: long>>, diff array<long>"
        seen = stash(_with_pivot(large, sets).mapInArrow(_from_pivot(bound), schema), "seen")
        links.append(seen.where("linked").select(F.col("pivot").alias("a"), F.col("id").alias("b")))
        labels = components(known.union(links[-1]))
        parts = seen.select("pivot", "id", F.explode("diff").alias("e"))
        rare = parts.groupBy("pivot", "e").agg(F.count(F.lit(1)).alias("df"))
        order = F.row_number().over(Window.partitionBy("pivot", "id").orderBy("df", "e"))
        ranked = parts.join(rare, ["pivot", "e"]).withColumn("rank", order).where("df > 1")
        shown = ranked.join(seen.select("pivot", "id", "n", "own", F.explode("keep").alias("to")), ["pivot", "id"]).where("rank <= to.k")
        cells = shown.select("pivot", "e", F.least("own", "to.c").alias("low"), F.greatest("own", "to.c").alias("high"), "id", "n", "own")
        cells = cells.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        cell = Window.partitionBy("pivot", "e", "low", "high")
        cells = cells.withColumn("open", F.min("component").over(cell) != F.max("component").over(cell)).withColumn("both", (F.min("own").over(cell) == F.col("low")) & (F.max("own").over(cell) == F.col("high")))
        cells = cells.where("open and both").select(F.col("pivot").alias("old"), "e", "low", "high", "id", "n")
        pairs = stash(_star(cells, ["old", "e", "low", "high"], "n"), "pairs")
    found = links[0] if links else pairs.select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    for more in links[1:]:
        found = found.union(more)
    if count:
        whole = counts[0] if counts else found.select(F.col("a").alias("id"), F.lit(1).cast("long").alias("n"))
        for more in counts[1:]:
            whole = whole.union(more)
        return members, stash(whole.groupBy("id").agg(F.sum("n").alias("n")), "counts"), components(found)
    if every:
        found = stash(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return members, found, components(found) if labels is None else labels


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest doc_id with the same set) and component_id
    (smallest doc_id reachable by links, itself included).

    Null and empty texts have no shingles and stand alone, as do texts of a null id. An empty table gives an empty
    result; further columns of ``docs`` are ignored whatever their names."""
    members, _, labels = jaccard_links(docs, width, num, den, id_col, text_col, every=False)
    found = members.join(labels, members.rep == labels.id, "left")
    return found.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def jaccard_join(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `jaccard_components`, and n_links: the links of the document's class with other classes, every one of them verified."""
    members, counts, labels = jaccard_links(docs, width, num, den, id_col, text_col, count=True)
    found = members.join(labels.join(counts, "id"), members.rep == F.col("id"), "left")
    return found.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("component", "rep", "doc_id").alias("component_id"), F.coalesce("n", F.lit(0)).alias("n_links"))
