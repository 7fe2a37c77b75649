"""Keeping a costly expression from being evaluated several times per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column computed once per row.

    The one-row ``explode`` keeps the optimizer from copying ``value`` into
    every later filter and column that uses it.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
