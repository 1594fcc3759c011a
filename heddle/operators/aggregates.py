"""Aggregation helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def money(value: Column | str) -> Column:
    """An exact sum of amounts with two decimals, whatever the order of the rows."""
    c = F.col(value) if isinstance(value, str) else value
    return F.sum(c.cast("decimal(18,4)")).cast("double")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rn") -> DataFrame:
    """The first ``k`` rows of each group; Spark prunes groups to k rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
