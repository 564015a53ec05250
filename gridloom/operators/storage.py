"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset: a fresh folder of this machine on a local master, as in tests; elsewhere an error, since executors couldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isEmpty():
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get()
    return found.rstrip("/")


def clean_up(spark: SparkSession) -> None:
    """Removes all intermediate tables from the shared folder. Results are lazy: call it once those in use are written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/gridloom")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _staged.clear()


#: Tables that are staged once for a session: (application, what) -> path.
_staged: dict[tuple, str] = {}


def staged(spark: SparkSession, what: tuple, make) -> DataFrame:
    """The table that ``make()`` gives, written to the shared folder the first time that it is asked for in this application."""
    key = (spark.sparkContext.applicationId, shared_dir(spark), *what)
    if key not in _staged:
        path = f"{shared_dir(spark)}/gridloom/staged-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _staged[key] = path
    return spark.read.parquet(_staged[key])


def stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sorted_by_tile(nodes: DataFrame) -> DataFrame:
    """nodes in ranges of their tile, sorted by it, so that a box reads few row groups of what is written of it."""
    return nodes.repartitionByRange("tile").sortWithinPartitions("tile")


def by_tile(nodes: DataFrame) -> DataFrame:
    return stored(sorted_by_tile(nodes), "nodes")
