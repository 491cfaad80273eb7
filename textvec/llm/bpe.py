"""Byte-pair encoding in whole batches: pieces of text, exact merges in numpy, a bounded memo."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

import numpy as np

#: Letters, digits and white space below U+0250, where they are settled. Other texts go to the library.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t\\n\\x0b\\f\\r \\x85\\xa0"
_ODD = re.compile("[^\x00-ɏ]")
_TAILS = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_PIECES = re.compile(f"{_TAILS}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WORD_PIECES = re.compile(f"{_TAILS}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
#: Pieces of more bytes are merged by the library.
LONG = 96
_NONE = np.int32((1 << 31) - 1)
_LOADED: dict[int, "Bpe"] = {}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


def load(text: str) -> "Bpe":
    """The tokenizer of a JSON text, kept for the life of the Python process."""
    key = hash(text)
    if key not in _LOADED:
        _LOADED[key] = Bpe(text)
    return _LOADED[key]


class Bpe:
    """A byte-level BPE tokenizer, with or without a suffix that marks word ends."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        if len(model["vocab"]) > 1 << 16:
            raise ValueError("vocabularies of up to 65,536 tokens are supported")
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.first = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + self.suffix] for x in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << 16) | vocab[b] for a, b in pairs], np.uint32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        back = {x: i for i, x in enumerate(letters)}
        self.bytes_of = [b""] * (max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in (token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token))
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.split = re.compile("(" + ("|".join(map(re.escape, self.special)) or "(?!)") + ")")
        self._text, self._library = text, None
        self.memo: dict[str, bytes] = {}

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._text)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def byte_pieces(self, text: str) -> list[str]:
        """The pieces of a stretch without special tokens, for a byte-level tokenizer; they join to the text."""
        if not _ODD.search(text):
            return _BYTE_PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def word_pieces(self, text: str) -> list[str] | None:
        """The pieces of a whole text for a tokenizer of lower-cased words; None if the library must do it."""
        low = text.lower()
        return None if "<|" in text or _ODD.search(text) or _ODD.search(low) else _WORD_PIECES.findall(low)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], _NONE)

    def merge(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit integers: lowest rank first, leftmost among equals."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        by_size: dict[int, list[int]] = {}
        for i, x in enumerate(raw):
            if len(x) > LONG:
                letters = byte_letters()
                out[i] = np.array([t.id for t in self.library.model.tokenize("".join(letters[b] for b in x))], "<u4").tobytes()
            else:
                by_size.setdefault(len(x), []).append(i)
        for n, members in by_size.items():
            if not n:
                continue
            data = np.frombuffer(b"".join(raw[i] for i in members), np.uint8).reshape(-1, n)
            ids = self.first[data]
            ids[:, -1] = self.last[data[:, -1]]
            left = np.full(len(members), n)
            rows = np.arange(len(members))
            work = np.pad(ids, ((0, 0), (0, 1)), constant_values=-1)
            rank = self._rank(work[:, :-1], work[:, 1:])
            done = np.empty((len(members), n), np.int32)
            cols = np.arange(n)
            while len(rows):
                at = rank.argmin(1)
                k = np.arange(len(rows))
                best = rank[k, at]
                stop = best == _NONE
                if stop.any():
                    done[rows[stop]] = work[stop, :-1]
                    go = ~stop
                    rows, work, rank, at, best = rows[go], work[go], rank[go], at[go], best[go]
                    if not len(rows):
                        break
                    k = np.arange(len(rows))
                left[rows] -= 1
                take = cols + (cols > at[:, None])
                work[:, :-1] = np.take_along_axis(work, take, 1)
                work[k, at] = self.made[best]
                rank = np.take_along_axis(rank, np.minimum(take, n - 1), 1)
                rank[:, -1] = _NONE
                rank[k, at] = self._rank(work[k, at], work[k, at + 1])
                before = np.maximum(at - 1, 0)
                rank[k, before] = np.where(at > 0, self._rank(work[k, before], work[k, before + 1]), rank[k, before])
            done = done.astype("<u4")
            for j, i in enumerate(members):
                out[i] = done[j, : left[j]].tobytes()
        return out

    def encode(self, docs: list[list[str]], bound: int, known: Callable[[list[str]], list[bytes | None]] | None = None) -> list[bytes]:
        """The ids of lists of pieces. The memo is emptied when it has more than ``bound`` pieces; ``known`` may give
        the ids of pieces that it lacks, and the others are merged."""
        if len(self.memo) > bound:
            self.memo.clear()
        found = [list(map(self.memo.get, pieces)) for pieces in docs]
        new = list({p for pieces, ids in zip(docs, found) if None in ids for p, x in zip(pieces, ids) if x is None})
        if known and new:
            told = known(new)
            self.memo.update((p, x) for p, x in zip(new, told) if x is not None)
            new = [p for p, x in zip(new, told) if x is None]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.memo.update(zip(part, self.merge(part)))
        memo = self.memo
        return [b"".join(ids) if None not in ids else b"".join([memo[p] if x is None else x for p, x in zip(pieces, ids)]) for pieces, ids in zip(docs, found)]


def chunks(texts: Iterable[str | None], most: int = 1 << 20):
    """Lists of consecutive texts of about ``most`` characters together; null is empty."""
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held
