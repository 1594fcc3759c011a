"""Dictionary encoding of a column: its values once, and a code for each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.errors import DatasetError


def encoded(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(``df`` with codes in place of ``column``, dictionary of code and value). Null has no code: it stays null.

    Codes are 64-bit hashes of the values, so no row waits for a numbering; two
    values with one hash are an error, found when the dictionary is made.
    """
    if column not in df.columns:
        raise DatasetError(f"unknown column {column!r}")
    value = df[f"`{column}`"]
    words = df.select(value.alias("value")).where("value is not null").distinct().select(F.xxhash64("value").alias("code"), "value")
    clash = F.when(F.count("*") > 1, F.raise_error(F.lit("two values have one code"))).otherwise(F.first("value"))
    codes = df.select(*[F.when(value.isNotNull(), F.xxhash64(value)).alias(c) if c == column else df[f"`{c}`"] for c in df.columns])
    return codes, words.groupBy("code").agg(clash.alias("value"))


def decoded(codes: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    """What ``encoded`` was given. The dictionary is broadcast only where Spark's size estimate allows it."""
    d = dictionary.select(F.col("code").alias("__code"), F.col("value").alias("__value"))
    out = codes.join(d, F.col(f"`{column}`") == F.col("__code"), "left")
    return out.select(*[F.col("__value").alias(c) if c == column else F.col(f"`{c}`") for c in codes.columns])
