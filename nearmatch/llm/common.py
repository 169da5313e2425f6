"""Helpers that the training-data operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmatch.sources.shared import materialize, shared_dir

__all__ = ["WORD", "WS", "bucket_of", "groups_for", "lookup", "materialize", "numbered", "own", "shared_dir", "shuffle_partitions", "table", "text_batches"]

#: The white space of all word definitions here: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def own(name: str) -> str:
    """A column name of ours that no table is likely to have."""
    return f"__nearmatch_{name}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Keep batches of whole texts small, those of the Parquet reader and those that go to Python: very long documents then can't fill a JVM or a Python worker."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "64")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def groups_for(rows: int, per_group: int) -> int:
    return max(1, math.ceil(rows / per_group))


def bucket_of(cols: list[str], groups: Column | int, seed: int) -> Column:
    """A group number from 0, even over all rows, whatever their keys."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(groups) if isinstance(groups, int) else groups)


def numbered(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows with a column own("row") that no two of them share: their key, or where keys are missing or repeated a number, for which rows is written."""
    row = own("row")
    if rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).isEmpty():
        return rows.withColumn(row, F.col(key))
    return materialize(rows.withColumn(row, F.monotonically_increasing_id()), "numbered")


def lookup(rows: DataFrame, entries: DataFrame, key: str, weight: str, spread: str, hot_share: float = 0.001) -> DataFrame:
    """rows with a struct column found: the entry of their key, a long or a binary, or null.

    weight is the number of rows of each entry. Entries with hot_share of all
    rows or more, at most 1 / hot_share of them, are broadcast; the rows that
    they answer are dealt out by the column spread, so that no key's rows meet
    in one task.
    """
    total = entries.agg(F.sum(weight)).first()[0] or 0
    hot_from = max(1000, int(total * hot_share))
    fields = F.struct(*[c for c in entries.columns if c != key])
    hot = entries.where(F.col(weight) >= hot_from).select(key, fields.alias("_hot"))
    cold = entries.where(F.col(weight) < hot_from).select(F.col(key).alias("_key"), fields.alias("_found"))
    tagged = rows.join(F.broadcast(hot), key, "left")
    dealt = F.xxhash64(spread)
    if entries.schema[key].dataType.typeName() == "binary":
        dealt = F.encode(dealt.cast("string"), "utf-8")
    tagged = tagged.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(dealt))
    return tagged.join(cold, "_key", "left").withColumn("found", F.coalesce("_hot", "_found")).drop("_hot", "_found", "_key")
