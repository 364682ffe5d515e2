"""Seeded randomness as a function of keys, stable under repartitioning and retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 1 << 32

# Modulus and multipliers of the pair hash; products of two residues fit a bigint.
PRIME = (1 << 31) - 1
MULTIPLIERS = (48271, 16807, 69621)


def hash32(seed, *cols) -> Column:
    """Unsigned 32-bit integer from md5 of ``seed|key|key...``."""
    parts = [F.lit(str(seed))] + [_col(c).cast("string") for c in cols]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(seed, *cols) -> Column:
    """Double in [0, 1)."""
    return hash32(seed, *cols) / F.lit(float(TWO32))


def pair_hash(low, high, salt):
    """Mix three non-negative integers into [0, PRIME).

    Plain integer arithmetic, so it works on Columns and on NumPy int64 arrays alike. Each step
    uses the last one once, which keeps the Column a small expression.
    """
    a, b, c = MULTIPLIERS
    t = (low * a + high * b + salt) % PRIME
    t = t * (low % PRIME + c) % PRIME
    return t * (high % PRIME + b) % PRIME


def luck_salt(salt):
    """A second salt, far from the first, for a draw independent of the visiting order."""
    return salt * MULTIPLIERS[2] % PRIME


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
