"""Structured Streaming form of the incremental embedding store.

The reference has no stream; its embedding cache (reuse vectors across runs,
encode only what is new) maps onto a stream of arriving corpus files.
"""

from retrievalkit.streaming.embedding_stream import start_embedding_stream

__all__ = ["start_embedding_stream"]
