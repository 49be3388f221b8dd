"""Arriving corpus files -> embedding store, one micro-batch at a time.

Each micro-batch runs E4 (``embed_incremental``): texts already in the store
(same model, role, instruction, normalize) are skipped, the rest are encoded
and appended. A replayed batch after a failure only re-appends rows whose key
is already present; readers deduplicate by key, so the store stays exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from retrievalkit.operators.embed import embed_incremental


def start_embedding_stream(spark: SparkSession, source_path: str, schema: T.StructType,
                           store_path: str, model: str, *,
                           embed_fn: Callable[[DataFrame], DataFrame],
                           checkpoint_location: str, id_col: str = "id",
                           text_col: str = "text", role: str = "corpus",
                           instruction: str | None = None, normalize: bool = True,
                           vectors_path: str | None = None, available_now: bool = True,
                           max_files_per_trigger: int | None = None):
    """Start the stream; returns the ``StreamingQuery``.

    ``vectors_path`` (optional) also receives ``(id, vec)`` per batch.
    ``available_now`` processes what is there and stops (batch-like runs).
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_path)

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        vecs = embed_incremental(batch, store_path, model, embed_fn=embed_fn, id_col=id_col,
                                 text_col=text_col, role=role, instruction=instruction,
                                 normalize=normalize)
        if vectors_path:
            vecs.write.mode("append").parquet(vectors_path)
        else:
            vecs.write.format("noop").mode("overwrite").save()

    w = src.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
