"""Operator 5, line dedup, in DataFrame functions only.

A line's key is its text, trimmed and lower-cased. Lines of ``min_chars`` or more take part. A line goes if an
earlier line (smaller doc_id, then position) has the same key, or a key within ``edits`` edits, where both keys
have ``min_edit_chars`` or more. "Earlier" ranks first occurrences, so the outcome depends on no order of work; a
line that goes itself still counts as an earlier one.

Segment-partition edit join. One edit leaves one of two segments whole; the other, which holds the edit, is cut
again, and so on. Two rounds of this are done at once: a key of length L meets keys of its own length (as index and
as probe) and keys of length L - 1 (as probe), each under the four quarters that may hold the edit. A cell is a place
of the edit and all the text around it. Cells with two keys or more, one of them an index, are *live*:

* In a live cell of up to SMALL keys, each index meets each probe.
* A crowded cell is never paired out. Its keys keep only the part with the edit, which is cut into four again, and
  meet in narrower cells. In the end the part holds at most one letter of the index. Keys of equal length that differ
  in this one letter are all within one edit of each other, so the earliest of them decides for all; keys with one
  letter more meet the index under that letter. Both are stars, so candidates grow in proportion to the keys.

Candidates are verified on whole keys with Spark's banded edit distance, `levenshtein(a, b, edits)`, the native
counterpart of a bit-parallel one. Cells are counted by partial aggregation, so none is gathered in a task.

Documents are written once in buckets of doc_id, so that the joins that need texts move none of them: the one that
finds first occurrences, the reading of candidates, and the result. Of other lines only hashes travel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textvec.llm.shared import bucketed, stash

#: Keys of a cell that are paired with each other; larger cells are cut further.
SMALL = 8
#: Live cells that are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST = 1 << 20
AT = ["doc_id", "pos"]


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.select("doc_id", "pos", F.lower(F.trim("line")).alias("key")).where(F.char_length("key") >= min_chars)


def _quarters(cell: Column, gap: Column, n: Column) -> list[tuple[Column, Column, Column]]:
    """The cells of ``gap``, which stands for ``n`` letters of an index, if the edit is in each of its quarters: (cell,
    what is left of the gap, letters of the index that it stands for)."""
    more = F.char_length(gap) - n
    at = [F.shiftright(n * c, 2) for c in range(5)]
    out = []
    for c in range(4):
        size = at[c + 1] - at[c]
        around = F.substring(gap, F.lit(1), at[c]), F.substring(gap, at[c + 1] + more + 1, n - at[c + 1])
        out.append((F.xxhash64(cell, F.lit(c), size, *around), F.substring(gap, at[c] + 1, size + more), size))
    return out


def _entry(cell: Column, gap: Column, n: Column, side: Column) -> Column:
    return F.struct(cell.alias("cell"), gap.alias("gap"), n.cast("int").alias("n"), side.alias("side"))


def entries(gaps: bool) -> Column:
    """The first cells of the column ``key``, as probe (side 2) or as index and probe (3), with or without the gaps."""
    length, out = F.char_length("key"), []
    for less, side in ((0, F.lit(3)), (1, F.lit(2))):
        for cell, gap, n in _quarters(length - less, F.col("key"), length - less):
            out.append(_entry(cell, gap, n, side) if gaps else F.struct(cell.alias("cell"), side.alias("side")))
    return F.array(*out)


def narrower() -> Column:
    """The next cells of an entry (cell, gap, n, side); those that stand for no letter stay as they are."""
    cell, gap, n, side = (F.col(c) for c in ("cell", "gap", "n", "side"))
    empty, none = F.lit(""), F.lit(0)
    cut = F.filter(F.array(*(_entry(*x, side) for x in _quarters(cell, gap, n))), lambda e: e["n"] > 0)
    under = lambda letter: _entry(F.xxhash64(cell, F.lit(5), letter), empty, none, side)
    same = F.array(_entry(F.xxhash64(cell, F.lit(4)), empty, none, side), under(gap))
    longer = F.array(under(F.substring(gap, 1, 1)), under(F.substring(gap, 2, 1)))
    return F.when(n > 1, cut).when((n == 1) & (F.char_length(gap) == 1), same).when(n == 1, longer).otherwise(F.array(_entry(cell, gap, n, side)))


def _live(met: DataFrame) -> tuple[DataFrame, bool]:
    """The live cells of ``met``: (cell, crowded), to be joined by broadcast if they are few; and whether any is crowded."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in AT for f in (F.min, F.max)]
    cut = F.max("n") > 0 if "n" in met.columns else F.lit(True)
    cells = met.groupBy("cell").agg(F.bit_or("side").alias("sides"), F.count(F.lit(1)).alias("keys"), cut.alias("cut"), *ends)
    cells = cells.where("sides = 3 and (min_doc_id <> max_doc_id or min_pos <> max_pos)")
    cells = stash(cells.select("cell", ((F.col("keys") > SMALL) & F.col("cut")).alias("crowded")), "cells")
    size = cells.agg(F.count(F.lit(1)).alias("n"), F.max("crowded").alias("crowded")).first()
    return (F.broadcast(cells) if size.n <= BROADCAST else cells), bool(size.crowded)


def _pairs(members: DataFrame) -> DataFrame:
    """(x, y), x the earlier one, of each index and each other key of a cell."""
    at = F.struct(*AT)
    met = members.where("side = 3").select("cell", at.alias("x")).join(members.select("cell", at.alias("y")), "cell").where("x <> y")
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _stars(members: DataFrame) -> DataFrame:
    """(x, y), x the earlier one, of the earliest index of a cell and each other key."""
    at = F.struct(*AT)
    centre = members.where("side = 3").groupBy("cell").agg(F.min(at).alias("x"))
    met = centre.join(members.select("cell", at.alias("y")), "cell").where("x <> y")
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def candidates(keys: DataFrame, texts_of) -> tuple[list[DataFrame], DataFrame]:
    """Pairs (x, y) of places among which are all that decide, and the keys (doc_id, pos, key) of these places.

    ``keys`` has doc_id, pos and key; ``texts_of`` gives the keys of some places."""
    met = stash(keys.select(*AT, F.explode(entries(False)).alias("e")).select(*AT, "e.*"), "segments")
    cells, crowded = _live(met)
    members = stash(met.join(cells, "cell"), "members")
    pairs = [_pairs(members.where("not crowded"))]
    texts = stash(texts_of(members), "texts")
    if crowded:
        full = texts.join(members.where("crowded").select(*AT).distinct(), AT, "left_semi").select(*AT, F.explode(entries(True)).alias("e")).select(*AT, "e.*")
        live = full.join(cells.where("crowded"), "cell").drop("crowded")
    while crowded:
        met = stash(live.select(*AT, F.explode(narrower()).alias("e")).select(*AT, "e.*"), "segments")
        cells, crowded = _live(met)
        members = stash(met.join(cells, "cell"), "members")
        pairs += [_pairs(members.where("n > 0 and not crowded")), _stars(members.where("n = 0"))]
        live = members.where("crowded").drop("crowded")
    return pairs, texts


def _bits(at: DataFrame, name: str) -> DataFrame:
    """(doc_id, pos) rows as a map for each document from pos div 64 to a word of 64 bits."""
    words = at.groupBy("doc_id", F.expr("pos div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("b"))
    return words.groupBy(F.col("doc_id").alias("__id")).agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias(name))


def _bit(words: str, i: Column) -> Column:
    word = F.coalesce(F.try_element_at(words, F.floor(i / 64).cast("bigint")), F.lit(0).cast("bigint"))
    return F.call_function("getbit", word, (i % 64).cast("int")) == 1


def dropped_near(docs: DataFrame, firsts: DataFrame, min_edit_chars: int) -> DataFrame:
    """Those of the first occurrences (doc_id, pos) that have an earlier key within one edit."""
    own = _bits(firsts.where(F.col("size") >= min_edit_chars), "__own")
    lines = docs.join(own, docs.doc_id == own["__id"]).select("doc_id", "__own", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.where(_bit("__own", F.col("pos"))).select("doc_id", "pos", F.lower(F.trim("line")).alias("key"))

    def texts_of(places: DataFrame) -> DataFrame:
        wanted = places.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("pos").alias("at"))
        found = docs.join(wanted, docs.doc_id == wanted.id).select("doc_id", F.split("text", "\n").alias("lines"), F.explode("at").alias("pos"))
        return found.select("doc_id", "pos", F.lower(F.trim(F.get("lines", "pos"))).alias("key")).distinct()

    pairs, texts = candidates(keys, texts_of)
    known = texts.select(F.struct(*AT).alias("at"), "key")
    whole = pairs[0]
    for more in pairs[1:]:
        whole = whole.union(more)
    both = whole.distinct().join(known.select(F.col("at").alias("x"), F.col("key").alias("a")), "x").join(known.select(F.col("at").alias("y"), F.col("key").alias("b")), "y")
    return both.where(F.levenshtein("a", "b", 1) >= 0).select("y.doc_id", "y.pos").distinct()


def line_dedup(docs: DataFrame, edits: int = 1, min_chars: int = 20, min_edit_chars: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeated lines taken out of ``text_col``, plus n_lines and n_dropped.

    ``edits`` is 0 (equal keys only) or 1. Null texts stay null with no lines; shorter lines and line breaks between
    kept lines stay as they are; a text of which no line is left becomes empty. ``id_col`` identifies a document; rows
    that repeat an id must repeat its text and get the same result; rows without an id keep all their lines and drop
    none elsewhere. Other columns pass through, whatever their names, but for n_lines and n_dropped, which are replaced."""
    if edits not in (0, 1) or min_edit_chars < 8:
        raise ValueError("edits must be 0 or 1, and min_edit_chars 8 or more")
    docs = bucketed(docs.drop(*(c for c in ("n_lines", "n_dropped") if c not in (id_col, text_col))), id_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    h = (F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.char_length("key").alias("size"))
    firsts = stash(_lines(slim, min_chars).groupBy(*h).agg(F.min(F.struct("doc_id", "pos")).alias("at")).select("at.doc_id", "at.pos", "size"), "firsts")
    keep = firsts.join(stash(dropped_near(slim, firsts, min_edit_chars), "near"), AT, "left_anti") if edits else firsts
    free = lambda name: name if name not in docs.columns else free(name + "_")
    kept, own = free("__kept"), free("__id")
    bits = _bits(keep, kept).withColumnRenamed("__id", own)
    lines = F.split(F.col(text_col), "\n")
    stays = lambda line, i: (F.char_length(F.lower(F.trim(line))) < min_chars) | F.col(id_col).isNull() | _bit(kept, i)
    known, left = F.col(text_col).isNotNull(), F.filter(lines, stays)
    out = docs.join(bits, docs[id_col] == bits[own], "left").withColumn(kept + "_left", left)
    n = F.when(known, F.size(lines)).otherwise(0).cast("bigint")
    gone = F.when(known, F.size(lines) - F.size(kept + "_left")).otherwise(0).cast("bigint")
    return out.select(*(F.array_join(kept + "_left", "\n").alias(c) if c == text_col else F.col(c) for c in docs.columns), n.alias("n_lines"), gone.alias("n_dropped"))
