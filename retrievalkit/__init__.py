"""retrievalkit: retrieval datasets, exact vector search and IR evaluation as
Spark DataFrame plans.

Every public operator is a plain function ``DataFrame(s) -> DataFrame`` so that
Catalyst plans the whole pipeline; Python runs inside tasks only in the vector
kernel (Arrow batches) and in a user-supplied encoder hook.
"""

from retrievalkit.session import get_spark, checkpoint_dir
from retrievalkit.tables import RagTables

__all__ = ["get_spark", "checkpoint_dir", "RagTables"]
