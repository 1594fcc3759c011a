"""Sinks: tables written through Spark's committer, so that a write is there as a whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from heddle.session import shared_dir


def stored_copy(*parts: DataFrame, format: str = "parquet", partition_by: list[str] | None = None) -> DataFrame:
    """The ``parts`` written one after the other to a new folder of the shared storage, read back as one table.

    The first write makes the table, later ones append. With ``partition_by``
    rows are dealt by those columns first, so each folder gets few files.
    """
    first = parts[0]
    path = f"{shared_dir(first.sparkSession)}/table-{uuid.uuid4().hex}"
    for part in parts:
        if partition_by:
            part = part.repartition(*partition_by)
        part.write.format(format).mode("append").partitionBy(*partition_by or []).save(path)
    return first.sparkSession.read.format(format).schema(first.schema).load(path)
