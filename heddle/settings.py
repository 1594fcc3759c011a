"""Settings by key, from the session: ``spark.conf.set(key, value)``, ``--conf`` or ``SET key = value``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from heddle.errors import DatasetError

#: key -> (its default, its type)
KEYS = {
    "spark.heddle.batch.rows": ("2048", int),
    "spark.heddle.cache.store": ("MEMORY_AND_DISK", str),
    "spark.heddle.cache.bytes": (str(10 << 30), int),
    "spark.heddle.cache.ratio": ("0.8", float),
    "spark.heddle.cache.policy": ("LRU", str),
}


@dataclass(frozen=True)
class Settings:
    batch_rows: int
    cache_store: str
    cache_bytes: int
    cache_ratio: float
    cache_policy: str


def settings(spark: SparkSession) -> Settings:
    """All settings as they are now; a value that isn't of its type is an error."""
    found = {}
    for key, (default, kind) in KEYS.items():
        text = spark.conf.get(key, default)
        try:
            found[key.removeprefix("spark.heddle.").replace(".", "_")] = kind(text)
        except ValueError:
            raise DatasetError(f"{key} = {text!r} is no {kind.__name__}") from None
    return Settings(**found)
