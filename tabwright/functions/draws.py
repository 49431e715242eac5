"""Repeatable random draws: functions of the row's own key, never of its partition."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of the digest that make a draw: 52 bits, all that a double keeps of a share.
DIGITS = 13


def uniform(key, salt) -> Column:
    """Uniform in [0, 1) from an integer key of any size and sign; ``salt`` is an int or a Column.

    A counter-based generator: the digest of "key:salt", which SQL repeats. Neighbouring keys, keys that differ by any power of
    two and draws of different salts have nothing to do with each other. A NULL key gives NULL.
    """
    key = F.col(key) if isinstance(key, str) else key
    salt = salt if isinstance(salt, Column) else F.lit(int(salt))
    digest = F.md5(F.concat(key.cast("bigint").cast("string"), F.lit(":"), salt.cast("bigint").cast("string")))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 4 * DIGITS))


#: Fixed prime of ``cubic``: products of two residues fit in 64 bits.
PRIME = 2147483647


def coefficients(*parts) -> list[int]:
    """Five residues from the sha256 of ``parts``, one set per program, seed and generation."""
    digest = hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) % PRIME for i in range(5)]


def cubic(low, high, c: list[int]):
    """A cubic in the key modulo ``PRIME`` from the residues of the key's low and high half.

    Rows, programs and seeds draw alike only by chance: keys of any spacing give no pattern and no
    range of salts repeats. Works on Columns and on integer arrays.
    """
    x = (low + high * c[4]) % PRIME
    return (((x * c[3] + c[2]) % PRIME * x + c[1]) % PRIME * x + c[0]) % PRIME


def drawn(key, *parts) -> Column:
    """Uniform in [0, 1) from an integer key of any size and any number of constants."""
    key = (F.col(key) if isinstance(key, str) else key).cast("bigint")
    low, high = F.pmod(key, F.lit(PRIME)), F.pmod(F.shiftright(key, 31), F.lit(PRIME))
    return cubic(low, high, [F.lit(c).cast("bigint") for c in coefficients(*parts)]).cast("double") / F.lit(float(PRIME))


def hashed(*parts) -> Column:
    """Uniform in [0, 1) from any mix of columns and constants."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def pick_index(draw: Column, size) -> Column:
    """0-based index below ``size`` from a uniform draw."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.least(F.floor(draw * size), size - 1).cast("int")
