"""File listings through Hadoop's file systems, so any scheme that Spark reads works."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from heddle.errors import DatasetError


@dataclass(frozen=True)
class DataFile:
    path: str
    size: int
    modified: int


@dataclass(frozen=True)
class Listing:
    files: tuple[DataFile, ...]
    modified: int  # latest of the root, its folders and files, in ms

    @property
    def total_bytes(self) -> int:
        return sum(f.size for f in self.files)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        return where.getFileSystem(spark._jsc.hadoopConfiguration()), where
    except Py4JJavaError as error:
        raise DatasetError(f"no storage for {path}: {error.java_exception.getMessage()}") from None


def listing(spark: SparkSession, path: str) -> Listing:
    """All data files under ``path``, recursively; names that end in _SUCCESS or begin with _ or . are no data, nor is what lies in such folders."""
    fs, root = _hadoop(spark, path)
    if not fs.exists(root):
        raise DatasetError(f"no such path: {path}")
    status = fs.getFileStatus(root)
    found, modified, todo = [], status.getModificationTime(), [status]
    while todo:
        now = todo.pop()
        modified = max(modified, now.getModificationTime())
        name = now.getPath().getName()
        if now.isDirectory():
            if now is not status and name.startswith(("_", ".")):
                continue
            todo.extend(fs.listStatus(now.getPath()))
        elif not (name.endswith("_SUCCESS") or name.startswith(("_", "."))):
            found.append(DataFile(now.getPath().toString(), now.getLen(), now.getModificationTime()))
    return Listing(tuple(sorted(found, key=lambda f: f.path)), modified)
