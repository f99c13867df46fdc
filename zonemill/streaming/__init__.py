"""Incremental refresh. The analytics are batch; only new partitions arrive over time."""
