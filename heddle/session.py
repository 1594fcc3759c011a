"""One place for Spark settings."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from heddle.errors import DatasetError

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
    # Readers take the columns of the first file; no merging of footers over thousands of files.
    "spark.sql.parquet.mergeSchema": "false",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with this library's settings; a cluster's own master and sizes stay."""
    builder = SparkSession.builder.appName("heddle")
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can reach, from ``spark.checkpoint.dir``.

    Where that is unset and all of Spark runs in one process, a temporary folder
    takes its place; on a cluster that would lose what executors write, so there
    it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.isLocal:
            raise DatasetError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='heddle-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")
