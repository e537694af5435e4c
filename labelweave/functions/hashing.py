"""Deterministic pseudo-random columns.

Hashes of ``seed | key`` replace ``rand()``: the value depends on the row alone, so retries,
repartitioning and executor loss cannot change a split or a sample.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_hex(seed: int | str, *columns: Column | str) -> Column:
    """Hex digest of the seed and the key columns; sorts rows in a random but fixed order."""
    parts = [F.lit(str(seed))]
    for column in columns:
        parts.append((F.col(column) if isinstance(column, str) else column).cast("string"))
    return F.md5(F.concat_ws("|", *parts))


def hash_unit(seed: int | str, *columns: Column | str) -> Column:
    """A double in [0, 1) from the first 48 bits of the digest."""
    digits = F.substring(hash_hex(seed, *columns), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))
