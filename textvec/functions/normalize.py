"""BERT text normalization and word splitting, as plain Python for kernels and as Columns."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ideograph ranges that are set apart by spaces.
CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
_SPACE, _DROP = " ", ""


class _Table(dict):
    """What each code point becomes, found when first asked for."""

    def __init__(self, lowercase: bool, strip_accents: bool, chinese: bool):
        self.lowercase, self.strip, self.chinese = lowercase, strip_accents, chinese

    def __missing__(self, cp: int) -> str:
        self[cp] = out = self._find(cp)
        return out

    def _find(self, cp: int) -> str:
        c = chr(cp)
        kind = unicodedata.category(c)
        if cp in (9, 10, 13) or kind in ("Zs", "Zl", "Zp"):
            return _SPACE
        if cp in (0, 0xFFFD) or kind in ("Cc", "Cf", "Co"):
            return _DROP
        parts = [d for d in unicodedata.normalize("NFD", c) if unicodedata.category(d) != "Mn"] if self.strip and cp <= 0x2FFFF else [c]
        out = "".join(d.lower() if self.lowercase else d for d in parts)
        if self.strip and len(out) > 1:
            out = "".join(d for d in out if unicodedata.category(d) != "Mn")
        return f" {out} " if self.chinese and any(a <= cp <= b for a, b in CJK) else out


_TABLES: dict[tuple, _Table] = {}


def normalize(text: str, lowercase: bool = True, strip_accents: bool = True, chinese: bool = True) -> str:
    """Controls dropped, white space made spaces, ideographs set apart, accents stripped, letters lowered singly."""
    key = (lowercase, strip_accents, chinese)
    return text.translate(_TABLES.setdefault(key, _Table(*key)))


def is_punctuation(c: str) -> bool:
    return "!" <= c <= "/" or ":" <= c <= "@" or "[" <= c <= "`" or "{" <= c <= "~" or unicodedata.category(c).startswith("P")


_ASCII_WORDS = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+|[!-/:-@\[-`{-~]")


def words(normalized: str) -> list[str]:
    """The words of a normalized text: split at spaces, every punctuation character alone."""
    if normalized.isascii():
        return _ASCII_WORDS.findall(normalized)
    out: list[str] = []
    for word in normalized.split(" "):
        at = 0
        if word.isalnum():
            out.append(word)
            continue
        for i, c in enumerate(word):
            if is_punctuation(c):
                if at < i:
                    out.append(word[at:i])
                out.append(c)
                at = i + 1
        if at < len(word):
            out.append(word[at:])
    return out


# ---- Columns --------------------------------------------------------------------------------------------------

_DROPPED = r"[\x00\x{FFFD}]|[\p{Cc}\p{Cf}\p{Co}&&[^\t\n\r]]"
_SPACES = r"[\p{Zs}\x{2028}\x{2029}\t\n\r]"
_IDEOGRAPHS = "([" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK) + "])"
_PUNCTUATION = r"([!-/:-@\[-`{-~\p{P}])"
#: Hangul syllables, and the letters into which they come apart, as first, middle and last ones.
HANGUL, _FIRST, _MIDDLE, _LAST = (0xAC00, 0xD7A3), (0x1100, 19), (0x1161, 21), (0x11A7, 28)


def clean_column(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _DROPPED, ""), _SPACES, " ")


@lru_cache(maxsize=1)
def letter_map() -> tuple[dict[str, str], dict[str, str]]:
    """Of all code points but ideographs and Hangul: what becomes one letter or nothing, and what becomes several."""
    table, one, many = _Table(True, True, False), {}, {}
    for cp in range(0x110000):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind in ("Cc", "Cf", "Cn", "Co", "Cs", "Zs", "Zl", "Zp") or HANGUL[0] <= cp <= HANGUL[1]:
            continue
        if kind != "Mn" and c.lower() == c and not unicodedata.decomposition(c):
            continue
        out = table[cp]
        if out != c:
            (one if len(out) < 2 else many)[c] = out
    return one, many


def _apart(c: Column, many: dict[str, str]) -> Column:
    """A letter that becomes several ones."""
    n = F.ascii(c) - HANGUL[0]
    letters = lambda first, size: F.array(*(F.lit(chr(first + i) if first + i != _LAST[0] else "") for i in range(size)))
    syllable = F.concat(F.get(letters(*_FIRST), F.floor(n / 588).cast("int")), F.get(letters(*_MIDDLE), F.floor(n % 588 / 28).cast("int")), F.get(letters(*_LAST), (n % 28).cast("int")))
    others = F.create_map(*(F.lit(x) for pair in many.items() for x in pair))
    return F.when(c.between(chr(HANGUL[0]), chr(HANGUL[1])), syllable).otherwise(F.coalesce(F.try_element_at(others, c), c))


def normalize_column(text: Column) -> Column:
    """As `normalize` with its defaults, but for code points that only one of the two Unicode versions knows."""
    one, many = letter_map()
    spaced = F.regexp_replace(clean_column(text), _IDEOGRAPHS, " $1 ")
    rare = "[" + chr(HANGUL[0]) + "-" + chr(HANGUL[1]) + "".join(many) + "]"
    whole = F.when(spaced.rlike(rare), F.array_join(F.transform(F.split(spaced, ""), lambda c: _apart(c, many)), "")).otherwise(spaced)
    kept = {a: b for a, b in one.items() if b}
    return F.translate(whole, "".join([*kept, *(a for a in one if a not in kept)]), "".join(kept.values()))


def words_column(normalized: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(normalized, _PUNCTUATION, " $1 "), " +"), lambda w: w != "")
