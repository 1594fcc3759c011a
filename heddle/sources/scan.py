"""Column-string scans: request order and duplicates kept, names case-sensitive, absent columns null-filled."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.errors import DatasetError
from heddle.operators.joins import small_enough
from heddle.settings import settings


def column_names(request: str | Sequence[str] | None) -> list[str] | None:
    """The requested names: a comma-separated string is split and trimmed. None asks for all; "" for the column named ""."""
    if request is None:
        return None
    names = [n.strip() for n in request.split(",")] if isinstance(request, str) else list(request)
    return names or None


def project(df: DataFrame, request: str | Sequence[str] | None = None, *, suffix_duplicates: bool = False) -> DataFrame:
    """``df`` with the requested columns in request order; a name asked for twice comes twice (as ``name_2`` with ``suffix_duplicates``)."""
    names = column_names(request)
    if names is None:
        return df
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise DatasetError(f"unknown column {unknown[0]!r}; there are {', '.join(df.columns)}")
    seen: dict[str, int] = {}
    out: list[Column] = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        c = df[f"`{n}`"]
        out.append(c.alias(f"{n}_{seen[n]}") if suffix_duplicates and seen[n] > 1 else c)
    return df.select(*out)


def scan(spark: SparkSession, path: str, columns: str | Sequence[str] | None = None, *, where: str | Column | None = None, schema: T.StructType | None = None, format: str = "parquet", constants: dict | None = None) -> DataFrame:
    """A pruned scan of a directory; filters and columns reach the reader.

    With ``schema`` optional columns that a file lacks are null, and a lacking
    required one is an error. ``constants`` are appended last, as partition
    values are; one that is named like a column is an error.
    """
    reader = spark.read.format(format).option("recursiveFileLookup", "true")
    if schema is not None:
        there = set(reader.load(path).columns)
        for f in schema.fields:
            if not f.nullable and f.name not in there:
                raise DatasetError(f"required column {f.name!r} is missing in {path}")
        reader = reader.schema(schema)
    df = reader.load(path)
    if where is not None:
        df = df.where(where)
    df = project(df, columns)
    clash = [n for n in constants or {} if n in df.columns]
    if clash:
        raise DatasetError(f"the constant {clash[0]!r} is a column already")
    return df.select("*", *[F.lit(value).alias(name) for name, value in (constants or {}).items()])


def first_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The first ``n`` values of a column."""
    return project(df, [column]).limit(n)


def batches(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as its partitions stream it, in batches of at most ``rows`` rows: adds ``partition`` and ``batch``, numbered from 0.

    Every batch but a partition's last is full; without ``rows`` the setting spark.heddle.batch.rows counts. A column of ``df`` that is named like one of the two is an error.
    """
    rows = rows or settings(df.sparkSession).batch_rows
    clash = {"partition", "batch"} & set(df.columns)
    if clash:
        raise DatasetError(f"there is a column {sorted(clash)[0]!r} already")

    def number(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId(), 0, None

        def sent(t: pa.Table, n: int) -> pa.RecordBatch:
            t = t.append_column("partition", pa.array([part] * t.num_rows, pa.int32())).append_column("batch", pa.array([n] * t.num_rows, pa.int32()))
            return t.combine_chunks().to_batches()[0]

        for b in stream:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= rows:
                yield sent(held.slice(0, rows), n)
                held, n = held.slice(rows), n + 1
        if held is not None and held.num_rows:
            yield sent(held, n)

    schema = T.StructType([*df.schema.fields, T.StructField("partition", T.IntegerType()), T.StructField("batch", T.IntegerType())])
    return df.mapInArrow(number, schema)


def pulled(df: DataFrame, rows: int = 2048, ahead: bool = False) -> Iterator[list]:
    """Rows in lists of at most ``rows``, as the consumer asks for them: one partition is held at a time, two with ``ahead``."""
    found = df.toLocalIterator(prefetchPartitions=ahead)
    while part := list(islice(found, rows)):
        yield part


def collected(df: DataFrame, most_bytes: int = 1 << 30) -> pa.Table:
    """All of ``df`` as one Arrow table on the driver; an error if the optimizer's estimate of its size is over ``most_bytes``."""
    if not small_enough(df, most_bytes):
        raise DatasetError(f"too large to collect: more than {most_bytes} bytes by the optimizer's estimate")
    return df.toArrow()


def transformed(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str, on_error: Callable[[pa.RecordBatch, Exception], pa.RecordBatch | None] | None = None) -> DataFrame:
    """``f`` over the batches of ``df``. Of a batch on which it fails ``on_error`` gives the replacement, or None for none; without it the job fails."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            try:
                out = f(b)
            except Exception as error:  # the caller's own function: whatever it raises
                if on_error is None:
                    raise
                out = on_error(b, error)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


@contextmanager
def cancellable(spark: SparkSession, group: str) -> Iterator[Callable[[], None]]:
    """Jobs started inside, in this thread, belong to ``group``; the function that is given cancels them, from any thread."""
    context = spark.sparkContext
    context.setJobGroup(group, group, interruptOnCancel=True)
    try:
        yield lambda: context.cancelJobGroup(group)
    finally:
        context._jsc.clearJobGroup()


def stream_totals(df: DataFrame, value_bytes: int) -> DataFrame:
    """Rows and assumed bytes of each partition stream."""
    return df.groupBy(F.spark_partition_id().alias("stream")).agg(F.count("*").alias("n_rows"), (F.count("*") * value_bytes).alias("n_bytes"))


def schema_rows(df: DataFrame) -> DataFrame:
    """(pos, name, type, nullable) of a dataset's schema."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "pos int, name string, type string, nullable boolean")
