"""A put stream as a data source: tasks write Arrow batches with a number and a note each, and every batch is acknowledged."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from heddle.errors import DatasetError
from heddle.sources.storage import listing

ACKS = "_acks"
ACK = "file string, batch int, n_rows long, note string"


def _store(path: str):
    from pyarrow import fs

    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class _Sent(WriterCommitMessage):
    file: str
    batches: list[tuple[int, int, str]] = field(default_factory=list)  # number, rows, note


class PutWriter(DataSourceArrowWriter):
    """A task's batches are the row groups of one file, under a name that readers skip until all tasks are done."""

    def __init__(self, path: str, note: str, overwrite: bool):
        self.path, self.note, self.overwrite, self.put = path, note, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Sent:
        store, root = _store(self.path)
        name = f"part-{self.put}-{uuid.uuid4().hex}.parquet"
        sent, writer = _Sent(name), None
        try:
            for b in iterator:
                if writer is None:
                    store.create_dir(root, recursive=True)
                    writer = pq.ParquetWriter(f"{root}/_{name}", b.schema, filesystem=store)
                if b.num_rows:
                    writer.write_batch(b)
                    sent.batches.append((len(sent.batches), b.num_rows, self.note))
        finally:
            if writer is not None:
                writer.close()
        return sent

    def commit(self, messages: list[_Sent | None]) -> None:
        store, root = _store(self.path)
        sent = [m for m in messages if m and m.batches]
        store.create_dir(root, recursive=True)
        old = [i.path for i in store.get_file_info(self._selector(root)) if i.is_file] if self.overwrite else []
        for m in sent:
            store.move(f"{root}/_{m.file}", f"{root}/{m.file}")
        for p in old:
            if f"-{self.put}-" not in p:
                store.delete_file(p)
        # The acknowledgements of one put: a line for each batch.
        lines = [json.dumps({"file": m.file, "batch": n, "n_rows": rows, "note": note}) for m in sent for n, rows, note in m.batches]
        store.create_dir(f"{root}/{ACKS}", recursive=True)
        with store.open_output_stream(f"{root}/{ACKS}/{self.put}.json") as out:
            out.write("".join(f"{line}\n" for line in lines).encode())

    def abort(self, messages: list[_Sent | None]) -> None:
        store, root = _store(self.path)
        for m in messages:
            if m and store.get_file_info(f"{root}/_{m.file}").is_file:
                store.delete_file(f"{root}/_{m.file}")

    @staticmethod
    def _selector(root: str):
        from pyarrow import fs

        return fs.FileSelector(root, allow_not_found=True)


class Puts(DataSource):
    """``puts``: option ``note`` goes with every batch; batches have ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows."""

    @classmethod
    def name(cls) -> str:
        return "puts"

    def writer(self, schema, overwrite: bool) -> PutWriter:
        if "path" not in self.options:
            raise DatasetError("puts: save to a path")
        return PutWriter(self.options["path"], self.options.get("note", ""), overwrite)


def put(df: DataFrame, path: str, *, note: str = "", mode: str = "append") -> DataFrame:
    """Writes ``df`` under ``path`` as a put stream and returns the acknowledgements of all puts there: file, batch, n_rows, note."""
    spark = df.sparkSession
    spark.dataSource.register(Puts)
    df.write.format("puts").option("note", note).mode(mode).save(path)
    return acks(spark, path)


def acks(spark: SparkSession, path: str) -> DataFrame:
    """The acknowledgements of the puts to ``path``, those of files that an overwrite replaced left out."""
    there = spark.createDataFrame([(f.path.rsplit("/", 1)[-1],) for f in listing(spark, path).files], "file string")
    return spark.read.schema(ACK).json(f"{path}/{ACKS}").join(there, "file", "left_semi")
