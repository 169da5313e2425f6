"""Detection from what has changed is detection from all hashes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from nearmatch.operators import similarity
from nearmatch.plans.search import detect, find_duplicates, redetect
from nearmatch.settings import FastHash, HashMethod, SearchParams, SlowHash
from nearmatch.sources.store import Conflict, Store

PERCENT = SearchParams(method=HashMethod.SLOW, slowHash=SlowHash(hammingDistance=2, usePercentThreshold=True, matchingThresholdPct=60.0))


def _insert(spark, store, rng, n, bases, hashed=True):
    added = store.insert_videos(spark.createDataFrame([(f"/{rng.random()}", 1) for _ in range(n)], "path string, size long"))
    ids = [r["id"] for r in added.collect()]
    if hashed:
        store.insert_hashes(spark.createDataFrame([(i, [rng.choice(bases) ^ (1 << rng.randrange(1, 40)) for _ in range(rng.randrange(1, 4))]) for i in ids], "video_id int, hashes array<long>"))
    return ids


def _whole(store, params):
    hashes = store.read("hash").select("video_id", F.explode("hashes").alias("h"))
    return sorted(map(tuple, find_duplicates(store.read("video"), hashes, params).collect()))


@pytest.mark.parametrize("params,rounds", [(SearchParams(), 2), (PERCENT, 1)])
def test_any_sequence_of_arrivals_and_deletions(spark, tmp_path, monkeypatch, params, rounds):
    from nearmatch.plans import search

    rng, store = random.Random(7), Store(spark, str(tmp_path / "s"))
    bases, alive = [rng.getrandbits(60) << 2 for _ in range(9)], []
    alive += _insert(spark, store, rng, 18, bases)
    unhashed = _insert(spark, store, rng, 2, bases, hashed=False)
    detect(store, params)
    monkeypatch.setattr(search, "find_duplicates", None)  # from here on nothing is detected from all hashes
    for turn in range(rounds):
        alive += _insert(spark, store, rng, 3, bases)
        gone = rng.sample(alive, 5)
        store.delete_videos(spark.createDataFrame([(i,) for i in gone], "id int"))
        alive = [i for i in alive if i not in gone]
        # a video of which the hashes come later
        store.insert_hashes(spark.createDataFrame([(unhashed[turn], [bases[0], bases[1]])], "video_id int, hashes array<long>"))
        store.set_link_count(alive[0], 3)
        got = sorted((r["group_id"], r["video_id"]) for r in detect(store, params).collect())
        assert got == _whole(store, params)
        assert sorted({g for g, _ in got}) == sorted(r["group_id"] for r in store.read("dup_group").collect())
        store.compact(2)  # is no change
    assert redetect(store, store.change(), SearchParams(fastHash=FastHash(hammingDistance=9))) is None


@pytest.mark.parametrize("radius", [2, 12])
def test_pairs_across(spark, radius):
    rng = random.Random(radius)
    bases = [rng.getrandbits(60) << 2 for _ in range(4)]
    rows = [(v, rng.choice(bases) ^ sum(1 << rng.randrange(1, 63) for _ in range(rng.randrange(radius)))) for v in range(60)]
    some, others = rows[:25], rows[20:]  # some videos are in both
    new, old = (spark.createDataFrame(x, "video_id int, h long") for x in (some, others))
    got = sorted((r["a_video_id"], r["b_video_id"]) for r in similarity.hamming_pairs_across(new, old, radius).collect())
    assert got == sorted((v, w) for v, x in some for w, y in others if v != w and (x ^ y).bit_count() <= radius)


def test_only_new_hashes_are_compared(spark, tmp_path, monkeypatch):
    rng, store = random.Random(5), Store(spark, str(tmp_path / "s"))
    bases = [rng.getrandbits(60) << 2 for _ in range(400)]
    _insert(spark, store, rng, 300, bases)
    detect(store, SearchParams())
    before = store.state()
    (new,) = _insert(spark, store, rng, 1, bases[:1])
    seen = []
    for name in ("linked_classes", "hamming_pairs_across"):
        plain = getattr(similarity, name)
        monkeypatch.setattr(similarity, name, lambda hashes, *a, plain=plain: (seen.append({r["video_id"] for r in hashes.collect()}), plain(hashes, *a))[1])
    detect(store, SearchParams())
    assert seen == [{new}, {new}]
    added = [f for kind, f in store.state().tables["dup_group_map"] if kind == "add" and [kind, f] not in before.tables["dup_group_map"]]
    assert sum(spark.read.parquet(f"{store.path}/dup_group_map/{f}").count() for f in added) < 10


def test_hashes_that_come_while_detecting_are_not_passed_over(spark, tmp_path, monkeypatch):
    rng, store = random.Random(6), Store(spark, str(tmp_path / "s"))
    bases = [rng.getrandbits(60) << 2 for _ in range(3)]
    _insert(spark, store, rng, 4, bases)
    plain = similarity.linked_classes

    def slow(*a):
        monkeypatch.setattr(similarity, "linked_classes", plain)
        _insert(spark, Store(spark, store.path), rng, 2, bases)
        return plain(*a)

    monkeypatch.setattr(similarity, "linked_classes", slow)
    with pytest.raises(Conflict, match="hash"):
        detect(store, SearchParams())
    detect(store, SearchParams())
    assert sorted(map(tuple, store.read("dup_group_map").collect())) == _whole(store, SearchParams())
