"""Parquet files that tasks write themselves: batches that a Python step made needn't be turned into Spark's rows again.

Spark's own writer starts a process for each file on a local disk, too, to set its rights.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridloom.llm.common import shared_path
from gridloom.sources.ranges import Folder, placed

#: Bytes of a row group, about.
GROUP_BYTES = 8 << 20
#: Batches to pairs (kind, batch).
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[str, pa.RecordBatch]]]


class _Part:
    """A file of one task. It has its name once it is whole; Spark reads no files whose name begins with a line."""

    def __init__(self, folder: str, schema: pa.Schema):
        self.fs, self.folder = placed(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.temp = f"{self.folder}/_{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.temp)
        # what is written here hardly repeats
        self.file = pq.ParquetWriter(self.stream, schema, compression="zstd", use_dictionary=False)
        self.schema, self.held, self.bytes, self.rows = schema, [], 0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.bytes += batch.nbytes
        self.rows += batch.num_rows
        if self.bytes > GROUP_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.file.write_table(pa.Table.from_batches(self.held).cast(self.schema))
        self.held, self.bytes = [], 0

    def end(self, number: int) -> None:
        self.flush()
        self.file.close()
        self.stream.close()
        self.fs.move(self.temp, f"{self.folder}/part-{number:05}.parquet")  # another attempt at the task gives the same rows

    def drop(self) -> None:
        self.stream.close()
        self.fs.delete_file(self.temp)


def _written(batches: Iterator[pa.RecordBatch], step: Step, path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    parts: dict[str, _Part] = {}
    try:
        for kind, batch in step(batches):
            if batch.num_rows:
                if kind not in parts:
                    parts[kind] = _Part(f"{path}/kind={kind}", schema)
                parts[kind].add(batch)
    except BaseException:
        for part in parts.values():
            part.drop()
        raise
    for part in parts.values():
        part.end(TaskContext.get().partitionId())
    yield pa.RecordBatch.from_arrays([pa.array([sum(p.rows for p in parts.values())], pa.int64())], ["rows"])


def _rows(batches: Iterator[pa.RecordBatch], step: Step, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for kind, batch in step(batches):
        own = pa.Table.from_batches([batch]).cast(schema).append_column("kind", pa.repeat(kind, batch.num_rows))
        yield from own.to_batches()


def write_parts(df: DataFrame, step: Step, columns: str, path: str) -> int:
    """Write what ``step`` makes of the batches of each partition to the folder ``path``, which executors share, by kind; the number of rows.

    Where pyarrow doesn't know the file system, Spark writes the files.
    """
    spark, schema = df.sparkSession, to_arrow_schema(StructType.fromDDL(columns))
    try:
        placed(path)
    except (pa.ArrowException, OSError):
        df.mapInArrow(partial(_rows, step=step, schema=schema), columns + ", kind string").write.partitionBy("kind").option("compression", "zstd").parquet(path)
        return read_parts(spark, columns, path).count()
    Folder(spark, path).make()
    return df.mapInArrow(partial(_written, step=step, path=path, schema=schema), "rows long").agg(F.sum("rows")).head()[0] or 0


def read_parts(spark: SparkSession, columns: str, path: str) -> DataFrame:
    """The rows, with their kind."""
    return spark.read.schema(columns + ", kind string").parquet(path)


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    return (("row", batch) for batch in batches)


def _stepped(batches: Iterator[pa.RecordBatch], step) -> Iterator[tuple[str, pa.RecordBatch]]:
    return _same(step(batches))


def stored_parts(df: DataFrame, columns: str, name: str, step=None) -> tuple[DataFrame, int]:
    """``df``, or what ``step`` of mapInArrow makes of it, as read from the shared folder, and its number of rows."""
    path = shared_path(df.sparkSession, name)
    rows = write_parts(df, partial(_stepped, step=step) if step else _same, columns, path)
    return read_parts(df.sparkSession, columns, path).drop("kind"), rows
