"""Portable pseudo-random numbers: a function of (id, seed) only.

`rand(seed)` depends on how rows are partitioned. These expressions do not, so a split or a noise
value survives a retry on another executor, and any SQL engine with md5 can reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 4294967296  # 8 hex digits


def portable_hash(col: Column | str, seed: int | str) -> Column:
    """Uniform BIGINT in [0, 2^32) from the text of `col` and the seed."""
    text = F.concat_ws("|", F.col(col).cast("string") if isinstance(col, str) else col.cast("string"),
                       F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def portable_uniform(col: Column | str, seed: int | str) -> Column:
    """Uniform DOUBLE in [0, 1)."""
    return portable_hash(col, seed) / F.lit(float(HASH_RANGE))
