"""Exact deduplication by an extendible-hash index on shared files.

DataFrame and SQL functions only.

1. A text's key is a 64-bit hash. Counting rows by key, each map task first
   combining its own, gives the index's entries: one for each different key.
2. The directory starts with one slot and doubles while a bucket is overfull;
   a bucket stops splitting at the depth where it fits (its local depth). A
   bucket is a contiguous range of keys. Counts by key prefix decide this, in
   one aggregation over all depths. Buckets that are overfull at ``MAX_DEPTH``
   hold the rest as overflow; nothing depends on their size but speed.
3. Rows go by their key's slot to the directory, which names the bucket, and
   on to the bucket's owner task, which finds the key's entry in the bucket. A
   key of one row is answered there.
4. Of the others, the row with the smallest doc_id stands at the head of the
   key's chain, and every row of the key compares its bytes with it. Equal rows
   are answered; different texts whose keys collide go on to the chain's next
   place, until none are left.

A key with over ``hot_share`` of all rows (at most 1 / hot_share of them) is
answered in step 3 by a broadcast of key and count; in step 4 the rows of a
key are dealt into parts of about ``PART``, and the head of the chain is sent
to each part. No key's rows meet in one task.

Defined results: null text counts as empty and equals other empty texts;
repeated rows (same doc_id and text) are one text, of which one row has kept;
of rows with the same doc_id and different texts each is a row of its own; a
null doc_id is kept only where its text has no row with an id, and then one of
them is; empty tables give no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmatch.llm.common import WS, materialize, shuffle_partitions, table, text_batches

#: Entries that a bucket holds before it splits; fewer where that makes less than BUCKETS buckets for each task.
CAPACITY = 4096
BUCKETS = 4
#: Share of all rows from which a key is broadcast: at most 1000 keys.
HOT_SHARE = 0.001
#: Slots of the largest directory that is broadcast; larger ones are joined.
BROADCAST_SLOTS = 1 << 20
MAX_DEPTH = 28
#: Rows that compare their bytes with one copy of a chain's head.
PART = 10_000

SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
     g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def key_of(norm: Column) -> Column:
    return F.xxhash64(norm)


def directory(entries: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """slot, bucket, local_depth for each slot of the directory, and its global depth."""
    n = entries.count()
    top = 1
    while top < MAX_DEPTH and (n >> top) * 8 > capacity:
        top += 1
    prefixes = entries.groupBy(F.shiftrightunsigned("key", 64 - top).alias("prefix")).count()
    counts = (
        prefixes.select(F.explode(F.sequence(F.lit(0), F.lit(top))).alias("depth"), "prefix", "count")
        .groupBy("depth", F.expr(f"shiftright(prefix, {top} - depth)").alias("slot"))
        .agg(F.sum("count").alias("n"))
    )
    counts = materialize(counts, "directory")
    fullest = {r["depth"]: r["n"] for r in counts.groupBy("depth").agg(F.max("n").alias("n")).collect()}
    depth = 0
    while depth < top and fullest.get(depth, 0) > capacity:  # the directory doubles
        depth += 1
    fits = counts.where((F.col("depth") <= depth) & ((F.col("n") <= capacity) | (F.col("depth") == depth)))
    parents = counts.where(F.col("n") > capacity).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("slot") * 2, F.col("slot") * 2 + 1)).alias("slot"))
    # a bucket is a prefix that fits and whose parent was overfull; the root has no parent
    buckets = fits.where("depth = 0").select("depth", "slot").unionByName(fits.join(parents, ["depth", "slot"], "left_semi").select("depth", "slot"))
    first = F.expr(f"shiftleft(slot, {depth} - depth)")
    slots = buckets.select(
        F.col("depth").alias("local_depth"),
        first.alias("bucket"),
        F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {depth} - depth)") - 1)).alias("slot"),
    )
    return materialize(slots, "slots"), depth


def routed(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """rows(key, ...) with the bucket and local_depth that the directory gives for their keys."""
    slot = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    names = F.broadcast(slots) if 1 << depth <= BROADCAST_SLOTS else slots
    return rows.withColumn("slot", slot).join(names, "slot", "left").drop("slot")


def _keyed(docs: DataFrame, keep: list[str], key: Callable[[Column], Column]) -> DataFrame:
    """doc (the columns in keep), text, norm and key of each row; text is null where doc has it."""
    text = F.lit(None).cast("string") if "text" in keep else F.col("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), text.alias("text"), normalised(F.col("text")).alias("norm"))
    return rows.withColumn("key", key(F.col("norm")))


def _index(keyed: DataFrame, capacity: int | None) -> tuple[DataFrame, DataFrame, int]:
    """The index's entries (key, n, bucket, local_depth), written by bucket, and the directory."""
    spark = keyed.sparkSession
    entries = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "entries")
    if capacity is None:
        capacity = max(1, min(CAPACITY, entries.count() // (BUCKETS * shuffle_partitions(spark))))
    slots, depth = directory(entries, capacity)
    owned = routed(entries, slots, depth).repartitionByRange(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket", "key")
    return materialize(owned, "index"), slots, depth


def build_index(docs: DataFrame, capacity: int | None = None) -> DataFrame:
    """One entry per different key: key, n (rows), bucket, local_depth."""
    return _index(_keyed(docs, ["doc_id"], key_of), capacity)[0]


def _settled(docs: DataFrame, keep: list[str], capacity: int | None, hot_share: float, key: Callable[[Column], Column]) -> DataFrame:
    """doc (the columns in keep), sha, keep_id, group_size, kept, bucket, local_depth, chain of each row of docs."""
    spark = docs.sparkSession
    keyed = _keyed(docs, keep, key)
    index, slots, depth = _index(keyed, capacity)
    total = index.agg(F.sum("n")).first()[0] or 0
    hot_from = max(1000, int(total * hot_share))
    tasks = shuffle_partitions(spark)
    row = F.monotonically_increasing_id()
    # texts travel as they are, once; those that compare bytes are normalised again
    probes = routed(keyed.withColumn("row", row).withColumn("sha", F.unhex(F.sha2("norm", 256))).drop("norm"), slots, depth)
    norm = normalised(F.col("doc.text") if "text" in keep else F.col("text"))
    hot = index.where(F.col("n") >= hot_from).select("bucket", "key", F.col("n").alias("hot"))
    probes = probes.join(F.broadcast(hot), ["bucket", "key"], "left")
    owner = F.when(F.col("hot").isNull(), F.col("bucket")).otherwise(-1 - F.pmod(F.xxhash64("row"), F.lit(16 * tasks)))
    probes = probes.withColumn("owner", owner).repartition(tasks, "owner")
    cold = index.where(F.col("n") < hot_from).select(F.col("bucket").alias("owner"), "key", "n").repartition(tasks, "owner")
    found = probes.join(cold, ["owner", "key"], "left").withColumn("n", F.coalesce("hot", "n"))
    found = found.select("doc", "key", "sha", "row", "n", "bucket", "local_depth", F.when(F.col("n") > 1, norm).alias("norm"))
    found = materialize(found, "probed")

    answer = ["doc", "sha", "keep_id", "group_size", "kept", "bucket", "local_depth", "chain"]
    done = [found.where("n = 1").select("doc", "sha", F.col("doc.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.lit(True).alias("kept"), "bucket", "local_depth", F.lit(0).alias("chain"))]
    left, place = found.where("n > 1"), 0
    while True:
        rank = F.struct(F.col("doc.doc_id").isNull().alias("no_id"), F.col("doc.doc_id").alias("doc_id"), "row")
        heads = left.groupBy("bucket", "key").agg(F.min_by(F.struct("norm", "row", F.col("doc.doc_id").alias("doc_id")), rank).alias("head"), F.max("n").alias("rows"))
        heads = materialize(heads, f"chain{place}")
        parts = F.ceil(F.col("n") / PART)
        sent = heads.select("bucket", "key", "head", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("rows") / PART) - 1)).alias("part"))
        compared = left.withColumn("part", F.pmod(F.xxhash64("row"), parts)).join(sent, ["bucket", "key", "part"])
        equal = F.col("norm") == F.col("head.norm")
        compared = compared.select(
            "doc", "key", "sha", "row", "n", "bucket", "local_depth", equal.alias("equal"), F.when(~equal, F.col("norm")).alias("norm"), F.col("head.doc_id").alias("keep_id"), (F.col("head.row") == F.col("row")).alias("kept"), F.lit(place).alias("chain")
        )
        compared = materialize(compared, f"compared{place}")
        others = compared.where("NOT equal").groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("others"))
        collide = materialize(others, f"collisions{place}")
        if collide.isEmpty():
            done.append(compared.withColumn("group_size", F.col("n")).select(*answer))
            break
        compared = compared.join(collide, ["bucket", "key"], "left")
        done.append(compared.where("equal").withColumn("group_size", F.col("n") - F.coalesce("others", F.lit(0))).select(*answer))
        left = materialize(compared.where("NOT equal").select("doc", "key", "sha", "row", F.col("others").alias("n"), "bucket", "local_depth", "norm"), f"left{place}")
        place += 1
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def exact_dedup(docs: DataFrame, capacity: int | None = None, hot_share: float = HOT_SHARE, key: Callable[[Column], Column] = key_of) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, bucket, local_depth, chain."""
    found = _settled(docs.select("doc_id", "text"), ["doc_id"], capacity, hot_share, key)
    return found.select(F.col("doc.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "local_depth", "chain")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts one row, that of the smallest doc_id."""
    kept = _settled(docs, docs.columns, None, HOT_SHARE, key_of).where("kept")
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
