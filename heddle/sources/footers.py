"""Parquet footers as a table, and row groups as a data source."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from heddle.errors import DatasetError
from heddle.sources.storage import listing

FOOTER = "path string, row_group int, n_rows long, column string, physical_type string, compressed_bytes long, uncompressed_bytes long, n_values long, encodings string"


def _read_bytes(path: str):
    """A file opened by pyarrow from a Hadoop path; local paths lose their scheme."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = path.removeprefix("file:")
        return pa.memory_map("/" + path.lstrip("/"))
    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each column chunk of each row group of each file; the files' footers are read by executors."""
    files = listing(spark, path).files
    names = spark.createDataFrame([(f.path,) for f in files], "path string").repartition(max(1, min(len(files), 1000)))

    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            rows = []
            for name in b.column(0).to_pylist():
                meta = pq.ParquetFile(_read_bytes(name)).metadata
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        chunk = group.column(c)
                        rows.append((name, g, group.num_rows, chunk.path_in_schema, chunk.physical_type, chunk.total_compressed_size, chunk.total_uncompressed_size, chunk.num_values, ",".join(chunk.encodings)))
            cols = list(zip(*rows)) or [()] * 9
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=FOOTER.replace(", ", " ").split()[::2])

    return names.mapInArrow(read, FOOTER)


def counts(spark: SparkSession, path: str) -> dict[str, int]:
    """Rows of each Parquet file under ``path``, from the footers: one number a file reaches the driver, as in a listing."""
    first = footers(spark, path).groupBy("path", "row_group").agg(F.max("n_rows").alias("n"))
    return {r["path"]: r["n"] for r in first.groupBy("path").agg(F.sum("n").alias("n")).collect()}


class _Group(InputPartition):
    def __init__(self, path: str, group: int):
        self.path, self.group = path, group


class RowGroupReader(DataSourceReader):
    def __init__(self, columns: list[str] | None, files: list[str], group: int | None):
        self.columns, self.files, self.group = columns, files, group

    def partitions(self) -> list[_Group]:
        # Spark plans in one process: footers are opened by a pool of threads, one small read each.
        with ThreadPoolExecutor(16) as pool:
            held = list(pool.map(lambda f: pq.ParquetFile(_read_bytes(f)).num_row_groups, self.files))
        return [_Group(f, g) for f, n in zip(self.files, held) for g in range(n) if self.group in (None, g)]

    def read(self, partition: _Group) -> Iterator[pa.RecordBatch]:
        file = pq.ParquetFile(_read_bytes(partition.path))
        t = file.read_row_group(partition.group, columns=self.columns)
        if self.columns:
            t = t.select(self.columns)
        yield from t.to_batches()


def _files(path: str) -> list[str]:
    """Data files under a path, by pyarrow's file systems."""
    from pyarrow import fs

    store, root = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith(("file:", "/")) else fs.FileSystem.from_uri(path)
    prefix = "" if path.startswith(("file:", "/")) else path[: path.index("://") + 3] + path[path.index("://") + 3 :].split("/", 1)[0]
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise DatasetError(f"no such path: {path}")
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda name: any(part.startswith(("_", ".")) for part in name.split("/"))
    names = sorted(i.path for i in found if i.is_file and not hidden(i.path[len(root) :] or i.base_name) and not i.base_name.endswith("_SUCCESS"))
    return [n if not prefix else f"{prefix}/{n.lstrip('/')}" for n in names]


class RowGroups(DataSource):
    """``rowgroups``: one task for each row group of the Parquet files under the loaded path.

    Options: ``columns`` (comma-separated) and ``row_group`` (that one of each file only).
    """

    @classmethod
    def name(cls) -> str:
        return "rowgroups"

    def _names(self) -> tuple[list[str], list[str] | None]:
        if "path" not in self.options:
            raise DatasetError("rowgroups: load a path")
        files = _files(self.options["path"])
        if not files:
            raise DatasetError(f"no data files under {self.options['path']}")
        asked = self.options.get("columns")
        return files, [c.strip() for c in asked.split(",")] if asked else None

    def schema(self):
        files, columns = self._names()
        arrow = pq.ParquetFile(_read_bytes(files[0])).schema_arrow
        if columns:
            unknown = [c for c in columns if c not in arrow.names]
            if unknown:
                raise DatasetError(f"unknown column {unknown[0]!r}")
            arrow = pa.schema([arrow.field(c) for c in columns])
        return from_arrow_schema(arrow)

    def reader(self, schema) -> RowGroupReader:
        files, columns = self._names()
        group = self.options.get("row_group")
        return RowGroupReader(columns, files, None if group is None else int(group))


def row_groups(spark: SparkSession, path: str, columns: str | None = None, row_group: int | None = None) -> DataFrame:
    """A dataset read row group by row group; with ``row_group`` that one of each file only."""
    spark.dataSource.register(RowGroups)
    reader = spark.read.format("rowgroups")
    if columns:
        reader = reader.option("columns", columns)
    if row_group is not None:
        reader = reader.option("row_group", row_group)
    return reader.load(path)
