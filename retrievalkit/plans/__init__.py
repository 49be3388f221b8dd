"""Composed pipelines (benchmark, mining, tuning) and the query registry."""
