"""Repeatable sampling keys.

Python's Mersenne draw over an ordered list cannot be reproduced by a
distributed plan. Every random choice here ranks rows by
``md5(seed ':' salt ':' id)`` with the id as tie-break: uniform, without
replacement, exact in size, independent of partitioning, and expressible in
DuckDB with the same bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_key(seed: int, salt: str, *parts) -> Column:
    """md5 hex of ``'{seed}:{salt}:' || part1 [|| ':' || part2 ...]``."""
    cols = []
    for i, p in enumerate(parts):
        if i:
            cols.append(F.lit(":"))
        cols.append((F.col(p) if isinstance(p, str) else p).cast("string"))
    return F.md5(F.concat(F.lit(f"{seed}:{salt}:"), *cols))
