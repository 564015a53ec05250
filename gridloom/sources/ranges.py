"""Files by byte ranges on executors, and files written and moved where driver and executors see them."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=64)
def _system(scheme: str, host: str):
    return pafs.FileSystem.from_uri(f"{scheme}://{host}/")[0]


def placed(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a path as Spark gives it (``file:/x``, ``hdfs://host/x``, ``/x``)."""
    found = re.fullmatch(r"([a-z][a-z0-9+.-]*):(?://([^/]*))?(/.*)", path)
    if not found or found[1] == "file":
        return pafs.LocalFileSystem(), found[3] if found else path
    scheme, host, rest = found.groups()
    # in object stores the bucket is part of the path
    return _system(scheme, host or ""), rest if scheme in ("hdfs", "viewfs") else f"{host}{rest}"


def opened(path: str):
    """A file that can be read at any offset (``read_at``)."""
    fs, own = placed(path)
    return fs.open_input_file(own)


def writer(path: str):
    fs, own = placed(path)
    fs.create_dir(own.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(own)


def files(spark: SparkSession, path: str) -> list[tuple[str, str, int]]:
    """(name, path, length) of a file, or of the files of a folder, empty ones too."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return sorted((x.getPath().getName(), x.getPath().toString(), x.getLen()) for x in found if x.isFile())


def local(spark: SparkSession, rows: list[tuple], **types: pa.DataType) -> DataFrame:
    """A table of rows that the driver has, which takes no Python worker to make."""
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(types), types.values(), strict=True)], list(types)))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, length) of a file, or of the files of a folder, empty ones too. Their content isn't read; the driver lists them."""
    return local(spark, files(spark, path), name=pa.string(), path=pa.string(), length=pa.int64())


class Folder:
    """A folder as the driver sees it, by the file systems that Spark itself uses."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _inside(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.at, name)

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.at)) if self.fs.exists(self.at) else []

    def has(self, name: str) -> bool:
        return bool(self.fs.exists(self._inside(name)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._inside(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._inside(name), True)
        stream.write(bytearray(text.encode()))
        stream.hsync()
        stream.close()

    def make(self) -> None:
        self.fs.mkdirs(self.at)

    def move(self, name: str, target: Folder, as_name: str | None = None) -> None:
        """A rename, which is one step of the file system; refuses if the place is taken."""
        if not self.fs.rename(self._inside(name), target._inside(as_name or name)):
            raise FileExistsError(f"{target.path}/{as_name or name}")

    def remove(self) -> None:
        self.fs.delete(self.at, True)
