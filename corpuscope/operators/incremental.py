"""Resuming: skip what an earlier run has done."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def resume_anti_join(df: DataFrame, done: DataFrame, keys: Sequence[str] = ("full_name",)) -> DataFrame:
    """Rows whose key is not among the finished ones."""
    return df.join(done.select(*keys), list(keys), "left_anti")
