"""Dense vector expressions over ``array<float>`` / ``array<double>`` columns.

All sums accumulate in double, element by element from index 0, so the value
is bit-identical to a sequential loop in numpy or DuckDB's ``list_dot_product``
(checked on the embeddings table); the vector kernel relies on this.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _zero() -> Column:
    return F.lit(0.0).cast("double")


def to_double(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, _zero(), lambda acc, x: acc + x)


def sq_norm(a) -> Column:
    return F.aggregate(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double")),
                       _zero(), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def cosine(a, b) -> Column:
    """dot / (|a| |b|); NULL when either vector is zero."""
    den = F.sqrt(sq_norm(a)) * F.sqrt(sq_norm(b))
    return F.when(den > 0, dot(a, b) / den)


def sq_l2(a, b) -> Column:
    diffs = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(F.transform(diffs, lambda d: d * d), _zero(), lambda acc, x: acc + x)


def l2_normalize(a) -> Column:
    """Unit length; a zero vector stays zero."""
    # the norm is bound once: inside the inner function it would be computed anew for every element
    scaled = F.transform(F.array(norm(a)), lambda n: F.when(
        n > 0, F.transform(_c(a), lambda x: x.cast("double") / n)).otherwise(to_double(a)))
    return scaled[0]


def axpy(alpha, x, y) -> Column:
    """alpha * x + y element-wise (alpha is a double column or literal)."""
    al = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.zip_with(_c(x), _c(y), lambda u, v: al * u.cast("double") + v.cast("double"))
