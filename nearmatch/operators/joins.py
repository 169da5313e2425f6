"""What groups of any size need: their rows' places, and a value of the group beside each row, with no group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearmatch.sources.shared import materialize

#: Share of all rows, and number of rows, from which a group is dealt out; parts that it is dealt into.
HOT_SHARE = 0.001
HOT_ROWS = 10_000
DEALT = 1024


def lookup(rows: DataFrame, entries: DataFrame, key: str, weight: str, spread: str, hot_share: float = HOT_SHARE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows with a struct column found: the entry of their key, or null.

    weight is the number of rows of each entry. Entries with hot_share of all
    rows, at most 1 / hot_share of them, are broadcast, and the rows that they
    answer are dealt out by the column spread; other rows meet their entries by key.
    Entries should be a written table: they are read several times.
    """
    total = entries.agg(F.sum(weight)).first()[0] or 0
    hot_from = max(hot_rows, int(total * hot_share))
    fields = F.struct(*[c for c in entries.columns if c != key])
    if entries.where(F.col(weight) >= hot_from).isEmpty():
        return rows.join(entries.select(F.col(key).alias("_key"), fields.alias("found")), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    hot = entries.where(F.col(weight) >= hot_from).select(F.col(key).alias("_hot_key"), fields.alias("_hot"))
    cold = entries.where(F.col(weight) < hot_from).select(F.col(key).alias("_key"), fields.alias("_cold"), F.lit(0).cast("long").alias("_with"))
    tagged = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot_key")), "left")
    tagged = tagged.withColumn("_deal", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(DEALT))))
    joined = tagged.join(cold, (F.col("_deal") == F.col("_with")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn("found", F.coalesce("_hot", "_cold")).drop("_hot", "_hot_key", "_deal", "_cold", "_key", "_with")


def with_places(rows: DataFrame, group: str, *order: str | Column, name: str = "place") -> DataFrame:
    """rows with their place in their group, from 1, in an order; rows that are equal in it get places in any order.

    Rows are written in range partitions of group and order: a row's place is
    its place in its partition and the number of its group's rows in the
    partitions before, of which there is one count for each partition.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = [F.col(group), *order, F.col("_tie")]  # the last keeps equal rows from meeting in one partition
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # the upper bits of the number are the partition, the lower 33 the place in it
    placed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).drop("_tie"), "places")
    runs = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = runs.select(F.col(group).alias("_group"), F.col("_part").alias("_run"), (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_base"))
    joined = placed.join(base, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_run")))
    return joined.withColumn(name, F.col("_at") + F.col("_base")).drop("_at", "_part", "_group", "_run", "_base")
