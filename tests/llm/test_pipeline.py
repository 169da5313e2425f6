from __future__ import annotations

import re

import corpus_pipeline
from helpers import documents
from pyspark.sql import functions as F

import __spark_entry__
from nearmatch.llm import packing, queries

SF = "/root/testdata/sf0.001"


def test_registered():
    names = list(__spark_entry__.queries())
    assert [n for n in names if re.match(r"op\d+_", n)] == list(queries.QUERIES) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_sql_of_exact_dedup(spark):
    from oracle import comparable, connect

    ours, theirs = queries.QUERIES["op9_exact_dedup"](spark, SF), connect(SF).sql(queries.ORACLE_SQL["op9_exact_dedup"])
    assert comparable(ours.columns, ours.collect()) == comparable(theirs.columns, theirs.fetchall())


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    at, left = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == docs.columns
        at = spark.createDataFrame(at.collect(), docs.schema)
        left[name] = [r["doc_id"] for r in at.collect()]
        assert all(r["text"] == texts[r["doc_id"]] for r in at.collect())
    assert set(left["toxicity"]) < set(texts) and len(left["toxicity"]) > 0.8 * len(texts)
    norm = lambda i: re.sub(r"[\x20\x09-\x0D]+", " ", texts[i])
    assert len({norm(i) for i in left["exact_dedup"]}) == len(left["exact_dedup"]) and {norm(i) for i in left["exact_dedup"]} == {norm(i) for i in left["toxicity"]}
    assert set(left["near_dedup"]) < set(left["exact_dedup"]) or set(left["near_dedup"]) == set(left["exact_dedup"])
    assert set(left["mixing"]) <= set(left["near_dedup"]) and max(left["mixing"].count(i) for i in set(left["mixing"])) <= 3
    last = corpus_pipeline.STAGES[-1][1](spark, at, SF).toPandas()
    assert last.groupby("sequence_id")["length"].sum().max() <= packing.SEQUENCE
    firsts = last[last["piece"] == 0]["doc_id"].tolist()
    assert sorted(firsts) == sorted(left["mixing"])


def _brute_near(rows):
    """The row of each near-duplicate group that stays, from pairs of fingerprints."""
    from nearmatch.llm import simhash

    fps = [int(x) for x in simhash.fingerprints([r["text"] for r in rows])]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    root[i] = min(root[i], root[j])
    groups: dict = {}
    for k, r in enumerate(rows):
        groups.setdefault(root[k], []).append(r)
    return [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]


def test_stages_of_odd_rows(spark):
    """Nulls in every column, repeated rows, ties and clashing names, against brute force."""
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(None, None, None), (None, None, None), (1, None, "a"), (2, "", None), (3, " \t ", "b"), (4, near, "a"), (4, near, "a"), (5, near.replace(" ", "  "), None), (None, near, "b"), (6, near.upper(), "a")]
    rows += [(None, "nobody has this text", "a"), (None, "nobody has this text either", "b"), (7, "a b", "a"), (7, "other text of the same id", "b"), (8, "long " * 30000, "a"), (9, "x" * 200_000, None)]
    df = documents(spark, rows).withColumn("none", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string"))
    stages = dict(corpus_pipeline.STAGES)
    whole = df.collect()
    kept = stages["toxicity"](spark, df, SF)
    assert kept.columns == df.columns and kept.count() >= len(rows) - 2
    norm = lambda r: re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
    first: dict = {}
    for r in whole:
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        if norm(r) not in first or key < first[norm(r)]:
            first[norm(r)] = key
    exact = stages["exact_dedup"](spark, df, SF)
    assert exact.columns == df.columns
    assert sorted((norm(r), r["doc_id"] is None, r["doc_id"] or 0) for r in exact.collect()) == sorted((t, *k) for t, k in first.items())
    got = stages["near_dedup"](spark, df, SF)
    assert got.columns == df.columns
    pick = lambda x: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in x)
    assert pick(got.collect()) == pick(_brute_near(whole))
    mixed = stages["mixing"](spark, df, SF).collect()
    texts = [(r["doc_id"], r["text"], r["source"]) for r in whole]
    assert all(sum((m["doc_id"], m["text"], m["source"]) == t for m in mixed) <= 3 * texts.count(t) for t in set(texts)) and not any((m["text"] or "").strip() == "" for m in mixed)
    packed = stages["packing"](spark, df, SF).toPandas()
    assert len(packed[packed["piece"] == 0]) == len(rows) and packed.groupby("sequence_id")["length"].sum().max() <= packing.SEQUENCE


def test_empty(spark):
    at = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF)
    assert at.count() == 0
