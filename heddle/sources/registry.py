"""Datasets by name: registered, listed, planned, refreshed on append, dropped."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from heddle.errors import DatasetError, NotSupported
from heddle.plans.placement import Node, Ring
from heddle.sources import scan as scans
from heddle.sources.footers import counts
from heddle.sources.storage import Listing, listing

CATALOGS = {"SPARK": True, "PRIVATE": False}
FORMATS = {"PARQUET": "parquet", "ORC": "orc"}


@dataclass(frozen=True)
class Dataset:
    name: str
    path: str
    format: str
    schema: T.StructType
    files: Listing
    flags: frozenset[str] = frozenset()
    locations: dict[str, str] = field(default_factory=dict)

    @property
    def total_bytes(self) -> int:
        return self.files.total_bytes


class Registry:
    """Keeps what planning needs on the driver: paths, schemas, file lists; never data.

    ``check_append`` compares modification times on access. An appended dataset
    is listed and placed anew; its schema stays as first read. A changed set of
    nodes re-places a dataset at its next access and reports partitions that
    moved; if files were appended at the same time, the append comes first and
    no moves are reported.
    """

    def __init__(self, spark: SparkSession, nodes: list[Node] | None = None, check_append: bool = True):
        self.spark, self.check_append = spark, check_append
        self.datasets: dict[str, Dataset] = {}
        self.nodes = list(nodes or [])
        self.drops: list[tuple[str, str, list[str]]] = []  # (location, dataset, partitions) to let go

    def register(self, name: str, path: str, *, format: str = "PARQUET", catalog: str = "SPARK") -> Dataset:
        if catalog not in CATALOGS:
            raise DatasetError(f"unknown catalog {catalog!r}")
        if not CATALOGS[catalog]:
            raise NotSupported(f"catalog {catalog!r}")
        if format not in FORMATS:
            raise DatasetError(f"unknown format {format!r}")
        found = listing(self.spark, path)
        if not found.files:
            raise DatasetError(f"no data files under {path}")
        # The first file's schema is the dataset's.
        schema = self.spark.read.format(FORMATS[format]).load(found.files[0].path).schema
        self.datasets[name] = self._placed(Dataset(name, path, format, schema, found))
        return self.datasets[name]

    def get(self, name: str) -> Dataset:
        if name not in self.datasets:
            raise DatasetError(f"unknown dataset {name!r}")
        now = self.datasets[name]
        if self.check_append and (found := listing(self.spark, now.path)).modified > now.files.modified:
            now = replace(now, files=found, flags=now.flags | {"FILES_APPEND"})
        if "FILES_APPEND" in now.flags:
            self.spark.catalog.refreshByPath(now.path)
            now = self._placed(replace(now, flags=frozenset()))
        elif "NODES_CHANGED" in now.flags:
            new = self._placed(replace(now, flags=frozenset()))
            moved: dict[str, list[str]] = {}
            for part, where in now.locations.items():
                if new.locations.get(part, where) != where:
                    moved.setdefault(where, []).append(part)
            self.drops += [(where, name, sorted(parts)) for where, parts in sorted(moved.items())]
            now = new
        self.datasets[name] = now
        return now

    def get_or_register(self, name: str, path: str, **options: str) -> Dataset:
        return self.get(name) if name in self.datasets else self.register(name, path, **options)

    def drop(self, name: str) -> None:
        """Forgets a dataset (not its files); unknown names are an error."""
        if self.datasets.pop(name, None) is None:
            raise DatasetError(f"unknown dataset {name!r}")
        self.spark.catalog.dropTempView(name)

    def set_nodes(self, nodes: list[Node]) -> None:
        self.nodes = list(nodes)
        self.datasets = {k: replace(d, flags=d.flags | {"NODES_CHANGED"}) for k, d in self.datasets.items()}

    def _placed(self, d: Dataset) -> Dataset:
        if not self.nodes:
            return d
        ring = Ring(self.nodes)
        return replace(d, locations={f.path: ring.locate(f.path) for f in d.files.files})

    def frame(self, name: str, columns: str | list[str] | None = None, where=None) -> DataFrame:
        d = self.get(name)
        return scans.scan(self.spark, d.path, columns, where=where, format=FORMATS[d.format], schema=d.schema)

    def view(self, name: str) -> None:
        self.frame(name).createOrReplaceTempView(name)

    def plan(self, name: str, columns: str | list[str] | None = None) -> DataFrame:
        """One row for each partition (file): partition_id, location, columns, schema, projected_schema, n_bytes, n_rows.

        Rows are counted from Parquet footers, and are -1 (unknown) for other formats.
        """
        d = self.get(name)
        names = scans.column_names(columns) or d.schema.names
        unknown = [n for n in names if n not in d.schema.names]
        if unknown:
            raise DatasetError(f"unknown column {unknown[0]!r}")
        projected = T.StructType([d.schema[n] for n in names])
        held = counts(self.spark, d.path) if d.format == "PARQUET" else {}
        rows = [(f.path, d.locations.get(f.path), names, d.schema.simpleString(), projected.simpleString(), f.size, held.get(f.path, -1)) for f in d.files.files]
        return self.spark.createDataFrame(rows, "partition_id string, location string, columns array<string>, schema string, projected_schema string, n_bytes long, n_rows long")

    def take_drops(self, location: str) -> list[tuple[str, list[str]]]:
        """(dataset, partitions) that a node has to let go; each is told once."""
        mine = [(name, parts) for where, name, parts in self.drops if where == location]
        self.drops = [d for d in self.drops if d[0] != location]
        return mine

    def listed(self) -> DataFrame:
        """name, path, format, n_files, n_bytes, modified, flags of every dataset; filter it like any table."""
        rows = [(d.name, d.path, d.format, len(d.files.files), d.total_bytes, d.files.modified, sorted(d.flags)) for d in self.datasets.values()]
        return self.spark.createDataFrame(rows, "name string, path string, format string, n_files int, n_bytes long, modified long, flags array<string>")

    def put(self, name: str, df: DataFrame, path: str | None = None, mode: str = "append") -> Dataset:
        """Writes ``df`` (all or nothing, by Spark's committer) and registers or refreshes the dataset.

        A known dataset is written where it lies and in its own format; ``path``
        may name its folder, not another, and ``df`` needs its columns.
        """
        d = self.datasets.get(name)
        if d is None:
            if path is None:
                raise DatasetError(f"unknown dataset {name!r}: a new one needs a path")
            df.write.mode(mode).parquet(path)
            return self.register(name, path)
        if path is not None and path.rstrip("/") != d.path.rstrip("/"):
            raise DatasetError(f"dataset {name!r} lies in {d.path}, not in {path}")
        if sorted(df.columns) != sorted(d.schema.names):
            raise DatasetError(f"dataset {name!r} has the columns {', '.join(d.schema.names)}")
        df.select(*[df[f"`{f.name}`"].cast(f.dataType).alias(f.name) for f in d.schema.fields]).write.mode(mode).format(FORMATS[d.format]).save(d.path)
        self.datasets[name] = replace(d, files=listing(self.spark, d.path), flags=d.flags | {"FILES_APPEND"})
        return self.get(name)
