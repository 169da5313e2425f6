"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmatch.sources.shared import materialize


def union_find(a: list[int], b: list[int]) -> dict[int, int]:
    """Smallest member of the component of each vertex of the edges (a, b)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for x, y in zip(a, b):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


def contract(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) with the same components, those of each Arrow batch contracted to stars."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = union_find(pdf["src"].tolist(), pdf["dst"].tolist())
            rows = [(v, r) for v, r in found.items() if v != r]
            yield pd.DataFrame(rows, columns=["src", "dst"]).astype("int64")

    return edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst").mapInPandas(run, "src long, dst long")


def _whole(edges: DataFrame) -> DataFrame:
    """Stars of all edges, in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        found = union_find([x for p in parts for x in p["src"].tolist()], [x for p in parts for x in p["dst"].tolist()])
        yield pd.DataFrame([(v, r) for v, r in found.items() if v != r], columns=["src", "dst"]).astype("int64")

    return edges.coalesce(1).mapInPandas(run, "src long, dst long")


def connected_components(edges: DataFrame, max_rounds: int = 60, small: int = 0) -> DataFrame:
    """id, component (the smallest id of its component) of each vertex of edges (src, dst); self-loops give no rows.

    Each round replaces edges by edges to smaller ids (large-star, then
    small-star) and ends where none changes, after a number of rounds that
    grows with the logarithm of the number of vertices. Edges are never
    collected; a round's edges are written to the shared folder. Up to small
    edges, by count, one task finds the components instead.
    """
    now = materialize(contract(edges), "edges")
    before = None
    if small and now.count() <= small:
        now, max_rounds = materialize(_whole(now), "stars"), 0
    for turn in range(max_rounds):
        both = now.select("src", "dst").unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        joined = large.join(low, "src").select(F.explode(F.array(F.struct("src", F.col("m").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))).alias("e"))
        now = materialize(joined.select("e.src", "e.dst").where("src <> dst").distinct(), f"star{turn}")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        if max_rounds:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = now.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(roots)
