"""Column expressions (JVM side, whole-stage codegen friendly)."""

from retrievalkit.functions.vectors import (
    to_double, dot, sq_norm, norm, cosine, sq_l2, l2_normalize, axpy,
)
from retrievalkit.functions.keys import sample_key
from retrievalkit.functions.text import with_prefix

__all__ = [
    "to_double", "dot", "sq_norm", "norm", "cosine", "sq_l2", "l2_normalize",
    "axpy", "sample_key", "with_prefix",
]
