"""Event-time windows that read alike as batches and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.session import shared_dir


_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def instant(wall: str) -> Column:
    """A time without zone, read as UTC: watermarks need instants, and the session's zone shall not move windows."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, `{wall}`)"))


def wall(at: str) -> Column:
    """What ``instant`` was given."""
    return F.expr(f"timestampadd(MICROSECOND, unix_micros(`{at}`), {_EPOCH})")


def tumbling(events: DataFrame, at: str, size: str, *keys: str) -> DataFrame:
    return _counted(events.groupBy(F.window(at, size), *keys), keys)


def sliding(events: DataFrame, at: str, size: str, step: str, *keys: str) -> DataFrame:
    return _counted(events.groupBy(F.window(at, size, step), *keys), keys)


def sessions(events: DataFrame, at: str, gap: str, *keys: str) -> DataFrame:
    return _counted(events.groupBy(F.session_window(at, gap).alias("window"), *keys), keys)


def _counted(grouped, keys) -> DataFrame:
    out = grouped.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total"))
    return out.select(F.col("window.start").alias("w_start"), F.col("window.end").alias("w_end"), *keys, "n", "total")


def new_files(spark, path: str, schema, checkpoint: str, table: str) -> None:
    """Appends what came to ``path`` since the last call to a table: a stream over whatever is there, then a stop."""
    stream = spark.readStream.schema(schema).parquet(path)
    query = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def deduplicated(events: DataFrame, at: str, late: str, *keys: str) -> DataFrame:
    """Each key once within the watermark; on a batch simply once."""
    if events.isStreaming:
        return events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def finished(stream: DataFrame) -> DataFrame:
    """The result table of a stream of updates once it has read what is there now.

    Each trigger writes the whole result to a folder of its own in the shared
    folder, where the stream's checkpoint lies too: a restarted driver goes on
    from there, and no result passes through the driver.
    """
    base = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    last: list[str] = []

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/result-{n}")
        last[:] = [f"{base}/result-{n}"]

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(last[0]) if last else spark.createDataFrame([], stream.schema)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream has sent once it has read what is there now: rows that are final (append), or every update.

    Each trigger's rows go to a folder that is named by its number, so a trigger
    that is run again after a failure replaces its own rows.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/sent/trigger={n}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{base}/sent")
