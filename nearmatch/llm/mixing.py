"""Mixing sources to target weights by pivotal dependent rounding.

A source's rate is its target over its size, at most ``MAX_COPIES``. Every
document is taken as often as the rate's whole part; the fraction is a copy
probability. The pivotal method pairs documents of one source and moves mass
(words) between their probabilities at random, without drift, until one of
them becomes 0 or 1; the other meets the next document. Mass is only moved,
so a source's taken words keep to its target but for one last document. What
rounding that one errs by is handed to documents that change their rounding, one
or two for none or one, as long as that leaves less of it.

Sources are dealt into groups by a hash of the document, so that a hot source
is many tasks; each group leaves one document with a fraction, and these meet
in a reduction tree over groups of groups. Random numbers are hashes of the
documents and a seed: reruns agree, whatever the partitions.

Defined results: null text has size 0; documents of size 0 are taken 0 words;
a null source is a source of its own, the last; repeated rows are documents of
their own; a source of size 0 has target 0; empty tables give no rows; columns
besides doc_id, text and source are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmatch.llm.common import WORD, bucket_of, materialize, numbered, own, table, text_batches
from nearmatch.sources.store import with_ids

MAX_COPIES = 3.0
#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: Documents of a group in the first round, and residuals of a group after it.
GROUP = 2000
FAN_IN = 256
SEED = 11


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, n_docs, source_size, target of sizes(source, size).

    The excess over MAX_COPIES times a source's size is reshared by weight
    until none is left: sources are full up to a level of target per weight,
    and all others stand at that level. Each round fills the sources below the
    level and raises it; sources are never gathered, only sums over them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = with_ids(per, -1, F.col("source").asc_nulls_last(), name="nth")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("nth"), F.lit(len(WEIGHTS))).cast("int") + 1).cast("double")
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MAX_COPIES).withColumn("fills_at", F.col("cap") / F.col("weight"))
    per = materialize(per, "sources")
    level, before = float("-inf"), -1
    while True:
        full = F.col("fills_at") <= level
        row = per.agg(F.sum("source_size").alias("total"), F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count_if(full).alias("n")).first()
        if not row["weight"] or row["n"] == before:  # all are full, or no more than at the level before
            break
        level, before = ((row["total"] or 0) - (row["cap"] or 0.0)) / row["weight"], row["n"]
    target = F.col("cap") if not row["weight"] else F.least("cap", F.col("weight") * level)
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def _uniform(a: np.ndarray, seed: int) -> np.ndarray:
    """Numbers from 0 to 1, from 64-bit keys: splitmix64."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivotal(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Probabilities rounded to 0 or 1 in order, and the position of the one that stays between, or -1.

    Of a pair with masses a and b, a step moves as much as makes one of them
    integral: either way, with odds that leave each probability's mean as it is.
    """
    p, size, u = p.tolist(), size.tolist(), u.tolist()
    open_at = -1
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        if open_at < 0:
            open_at = i
            continue
        j = open_at
        to_i = min((1 - p[i]) * size[i], p[j] * size[j])  # words that can go from j to i, and back
        to_j = min(p[i] * size[i], (1 - p[j]) * size[j])
        move = to_i if u[i] * (to_i + to_j) < to_j else -to_j
        for k, change in ((i, move), (j, -move)):
            p[k] += change / size[k]
            if p[k] < 1e-9:
                p[k] = 0.0
            elif p[k] > 1 - 1e-9:
                p[k] = 1.0
        open_at = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return np.array(p), open_at


def settle(size: np.ndarray, p: np.ndarray, at: int, u: float) -> np.ndarray:
    """Rounds the last document at random and hands the words by which that errs to others: those flip or change places, up to two for one, that leave least of it."""
    p = p.copy()
    rounded = float(u < p[at])
    error = int(round((rounded - p[at]) * size[at]))
    p[at] = rounded
    others = np.flatnonzero((size > 0) & (np.arange(len(p)) != at))
    while error:
        taken, left = others[p[others] == 1.0], others[p[others] == 0.0]
        step = None
        for two_out, two_in in ((False, False), (False, True), (True, False)):
            drop, gone = _choices(taken, size, two_out)
            add, come = _choices(left, size, two_in)
            above = np.minimum(np.searchsorted(come, gone - error), len(come) - 1)
            for k in (above, np.maximum(above - 1, 0)):
                rest = np.abs(error - gone + come[k])
                i = int(np.argmin(rest))
                if rest[i] < (abs(error) if step is None else step[0]):
                    step = int(rest[i]), drop[i], add[k[i]]
            if step is not None:
                break
        if step is None:
            break
        for chosen, value in ((step[1], 0.0), (step[2], 1.0)):
            for i in chosen[chosen >= 0]:
                error += int(size[i]) if value else -int(size[i])
                p[i] = value
    return p


def _choices(of: np.ndarray, size: np.ndarray, two: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of none, one or two of the documents (-1: none), by their size together, and that size."""
    rows = np.stack([np.r_[-1, of], np.full(len(of) + 1, -1)], 1)
    if two:
        i, j = np.triu_indices(len(of), 1)
        rows = np.concatenate([rows, np.stack([of[i], of[j]], 1)])
    together = np.where(rows < 0, 0, size[rows]).sum(axis=1)
    order = np.argsort(together, kind="stable")
    return rows[order], together[order]


def _round(rows: DataFrame, turn: int, last: bool) -> DataFrame:
    """rows of (src, grp, uid, doc_id, size, p) after pairing within each group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "uid", "doc_id"], ascending=[False, True, True], kind="stable", na_position="first").reset_index(drop=True)
        u = _uniform(pdf["uid"].to_numpy(np.int64), SEED + turn)
        p, at = pivotal(pdf["size"].to_numpy(np.float64), pdf["p"].to_numpy(np.float64), u)
        if last and at >= 0:
            p = settle(pdf["size"].to_numpy(np.int64), p, at, float(_uniform(pdf["uid"].to_numpy(np.int64)[at : at + 1], SEED - 1)[0]))
        return pdf.assign(p=p)

    return rows.groupBy("src", "grp").applyInPandas(run, rows.schema)


def mix(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of each row of docs(doc_id, text, source), and its columns in keep."""
    uid = F.xxhash64("doc_id", F.lit(SEED))
    # rows without an id are told apart by their texts
    uid = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(SEED))).otherwise(uid)
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), uid.alias("uid"), *keep)
    rows = materialize(rows, "sizes")
    targets = materialize(source_targets(rows), "targets").withColumn("src", F.xxhash64("source", F.lit(SEED)))
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    known = targets.select(F.col("source").alias("s"), "src", "n_docs", "source_size", "target")
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + 1e-12))
    p = F.when(F.col("size") > 0, F.greatest(F.col("rate") - F.col("base"), F.lit(0.0))).otherwise(F.lit(0.0))
    rows = rows.withColumn("p", F.when(p < 1e-9, F.lit(0.0)).otherwise(p))
    groups = F.ceil(F.col("n_docs") / GROUP)
    rows = rows.withColumn("grp", bucket_of(["uid"], groups, SEED)).drop("n_docs", "rate", "source")
    groups_left, turn, done = math.ceil(most / GROUP), 0, []
    while True:
        last = groups_left <= 1
        rows = materialize(_round(rows, turn, last), f"pivotal{turn}")
        integral = (F.col("p") == 0) | (F.col("p") == 1)
        done.append(rows.where(integral))
        if last:
            break
        turn, groups_left = turn + 1, math.ceil(groups_left / FAN_IN)
        rows = rows.where(~integral).withColumn("grp", F.floor(F.col("grp") / FAN_IN))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    copies = (F.col("base") + F.col("p")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *keep)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, as often as the mix takes them; those without words go. Rows with the same doc_id, or with none, are rows of their own."""
    row, copies = own("row"), own("copies")
    marked = numbered(docs)
    taken = mix(marked.select("doc_id", "text", "source", row), (row,)).where("copies > 0 AND size > 0").select(row, F.col("copies").cast("int").alias(copies))
    rows = marked.join(taken, row)
    return rows.withColumn(own("copy"), F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return mix(table(spark, sf_dir, "documents"))
