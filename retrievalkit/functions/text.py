"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_prefix(col, instruction: str | None) -> Column:
    """E5: prefix text with an instruction; None or '' leaves it unchanged."""
    c = F.col(col) if isinstance(col, str) else col
    if not instruction:
        return c
    return F.concat(F.lit(instruction), c)
