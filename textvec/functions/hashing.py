"""FNV-1a and the sizes of hash tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textvec.errors import InvalidOption

# Fixed values of the 32-bit hash.
SEED, PRIME, MASK = 2166136261, 16777619, 4294967295
#: A table is filled to this share at most.
LOAD = 0.70


def fnv1a(data: bytes) -> int:
    h = SEED
    for b in data:
        h = (h ^ b) * PRIME & MASK
    return h


def fnv1a_column(text: Column | str) -> Column:
    """The hash of a string's UTF-8 bytes as a long; null for null. An empty string has the seed."""
    digits = F.hex(F.encode(F.col(text) if isinstance(text, str) else text, "utf-8"))
    byte = lambda k: F.conv(F.substring(digits, k * 2 + 1, F.lit(2)), 16, 10).cast("long")
    step = lambda h, k: (h.bitwiseXOR(byte(k)) * PRIME).bitwiseAND(MASK)
    at = F.when(F.length(digits) > 0, F.sequence(F.lit(0), F.floor(F.length(digits) / 2).cast("int") - 1)).when(digits.isNotNull(), F.array().cast("array<int>"))
    return F.aggregate(at, F.lit(SEED).cast("long"), step)


def next_power_of_two(n: int) -> int:
    if n < 1:
        raise InvalidOption("n must be positive")
    return 1 << (n - 1).bit_length()


def table_size(entries: int) -> int:
    """Slots for ``entries`` under the load that is allowed, at least one of them free."""
    if entries < 0:
        raise InvalidOption("entries must not be negative")
    return next_power_of_two(-int(-entries // LOAD) + 1)
