"""Progress and cancellation of running searches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that start inside carry the tag."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> list[str]:
    """Stop the running jobs with a tag, from any thread."""
    return spark.interruptTag(tag)


def counted(df: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """df, and what its next action counts on the way: all rows, and those of each condition."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()]), seen
