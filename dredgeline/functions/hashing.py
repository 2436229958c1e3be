"""Seeded universal hashes and hashing of strings as big integers."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F


def coefficients(seed: int, n: int, low: int, high: int, low_b: int | None = None) -> list[tuple[int, int]]:
    """``n`` pairs ``(a, b)``: distinct draws from ``[low, high)``, then distinct draws for b from ``[low_b, high)``."""
    draw = random.Random(seed)
    a = draw.sample(range(low, high), n)
    b = draw.sample(range(low if low_b is None else low_b, high), n)
    return list(zip(a, b))


def universal(x: Column, a: int, b: int, p: int, m: int | None = None) -> Column:
    """``((a x + b) mod p) mod m``. ``x`` must be below ``p`` where ``a * p`` is near 2**63."""
    h = F.pmod(F.lit(a).cast("long") * x + F.lit(b).cast("long"), F.lit(p).cast("long"))
    return h if m is None else F.pmod(h, F.lit(m).cast("long"))


def bytes_mod(text: Column, p: int) -> Column:
    """The UTF-8 bytes of a non-empty string, as one big-endian integer, modulo ``p``."""
    digits = F.hex(F.encode(text, "UTF-8"))
    byte = lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.length(digits), F.lit(2)), F.lit(0).cast("long"), lambda acc, i: F.pmod(acc * 256 + byte(i), F.lit(p).cast("long")))


def trailing_zeros(h: Column) -> Column:
    """Zero bits below the lowest one; 0 for 0."""
    return F.when(h == 0, 0).otherwise(F.bit_count(h.bitwiseAND(-h) - 1))
