"""The folder that driver and executors share, and tables written to it between stages."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group of these tables: what a task that writes one holds in memory.
ROW_GROUP = 16 << 20


#: For each scope that is open around, in this thread or task, the tables made in it.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all is one machine, as in tests, a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir has to name a folder that driver and executors share: the master is {master}")
        at = tempfile.mkdtemp(prefix="nearmatch-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str, later: bool) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.deleteOnExit(where) if later else fs.delete(where, True)


def shared_path(spark: SparkSession, label: str, stays: bool = False) -> str:
    """A new path in the shared folder. What is written there goes with the scope around (see ``temporary``) unless it stays."""
    path = f"{shared_dir(spark)}/nearmatch-{label}-{uuid.uuid4().hex}"
    if (scopes := _SCOPES.get()) and not stays:
        scopes[-1].append(path)
    return path


def goes_at_exit(spark: SparkSession, path: str) -> None:
    """What is written at a path by now goes when the application ends."""
    _remove(spark, path, later=True)


def materialize(df: DataFrame, label: str, stays: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage and survives the loss of executors.

    The files go when the application ends, or with the scope around unless they stay.
    """
    spark = df.sparkSession
    path = shared_path(spark, label, stays)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    goes_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are made inside go at the end, but for those that stay. What is read from them has to be written by then."""
    made: list[str] = []
    around = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield
    finally:
        _SCOPES.reset(around)
        for path in made:
            _remove(spark, path, later=False)
