"""Tables by SQL: CREATE TABLE ... USING ... LOCATION, SHOW, DESCRIBE, DROP, as statements of the session's catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.errors import DatasetError

FORMATS = ("parquet", "orc", "csv", "json")


def _quoted(name: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def create_table(spark: SparkSession, name: str, path: str, *, using: str = "parquet", columns: str | None = None, replace: bool = False) -> DataFrame:
    """An external table over the files under ``path``; ``columns`` (as in DDL) are inferred where not given. Returns the table."""
    if using.lower() not in FORMATS:
        raise DatasetError(f"unknown format {using!r}")
    if replace:
        drop_table(spark, name)
    where = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {_quoted(name)} {f'({columns})' if columns else ''} USING {using} LOCATION '{where}'")
    return spark.table(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """Forgets a table; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(name)}")


def described(spark: SparkSession, name: str) -> DataFrame:
    """(pos, name, type, nullable) of a table's columns."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(spark.table(name).schema.fields)]
    return spark.createDataFrame(rows, "pos int, name string, type string, nullable boolean")


def shown(spark: SparkSession, like: str = "*") -> DataFrame:
    """(name, temporary) of the current database's tables whose name matches ``like``."""
    return spark.sql(f"SHOW TABLES LIKE '{like}'").select(F.col("tableName").alias("name"), F.col("isTemporary").alias("temporary"))
