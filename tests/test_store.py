"""The store: what changes write, and what becomes of changes at the same time."""

from __future__ import annotations

import json
import random
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from nearmatch.sources.store import Conflict, State, Store, with_ids


def _videos(spark, paths):
    return spark.createDataFrame([(p, 1) for p in paths], "path string, size long")


def _hashes(spark, rows):
    return spark.createDataFrame(rows, "video_id int, hashes array<long>")


def _files(store):
    return {p: p.stat().st_mtime_ns for p in Path(store.path).rglob("*.parquet")}


def test_of_two_writers_one_is_told(spark, tmp_path):
    store, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    a, b = store.change(), other.change()
    a.add("video", a.new_ids(_videos(spark, ["/a"]), "path").withColumn("modified_at", F.lit("")).select("id", *[F.lit(None).alias(c) if c not in ("id", "path", "size") else c for c in store.read("video").columns if c != "id"]))
    other.insert_videos(_videos(spark, ["/b"]))
    with pytest.raises(Conflict, match="video"):
        a.commit()
    assert [tuple(r) for r in store.read("video").select("id", "path").collect()] == [(1, "/b")]
    assert store.insert_videos(_videos(spark, ["/a"])).select("id", "path").collect() == [(2, "/a")]
    assert {r["path"] for r in other.read("video").collect()} == {"/a", "/b"} and b.read("video").count() == 0


def test_writers_of_different_tables_go_on_behind_each_other(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    a, b = store.change(), store.change()
    a.add("hash", _hashes(spark, [(1, [5])]))
    b.add("dup_group", spark.createDataFrame([(7,)], "group_id int").withColumn("created_at", F.current_timestamp()))
    b.commit()
    a.commit()
    assert store.read("hash").count() == store.read("dup_group").count() == 1 and store.state().number == 2
    c = store.change()
    c.read("hash")
    c.add("dup_group_map", spark.createDataFrame([(7, 1)], "group_id int, video_id int"))
    store.insert_hashes(_hashes(spark, [(2, [5])]))
    with pytest.raises(Conflict, match="hash"):
        c.commit()
    assert store.read("dup_group_map").count() == 0


def test_a_commit_number_is_given_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.publish(State(1, {}, 4)) and not store.publish(State(1, {}, 5)) and store.state().last_id == 4
    assert not store._create(store._hadoop(f"{store.path}/_commits/{1:012d}.json"), "x")
    assert sorted(p.name for p in Path(store.path, "_commits").iterdir() if p.suffix != ".crc") == [f"{1:012d}.json"]


def test_nothing_of_many_writers_is_lost(spark, tmp_path):
    path = str(tmp_path / "s")

    def insert(k):
        while True:
            try:
                return Store(spark, path).insert_hashes(_hashes(spark, [(k, [k])]))
            except Conflict:
                pass

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(insert, range(8)))
    store = Store(spark, path)
    assert sorted(r["video_id"] for r in store.read("hash").collect()) == list(range(8)) and store.state().number == 8


def test_changes_write_what_they_change(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.insert_videos(spark.range(50_000).select(F.format_string("/v%06d", "id").alias("path"), F.lit(1).alias("size")))
    store.insert_hashes(store.read("video").select(F.col("id").alias("video_id"), F.array(F.col("id").cast("long")).alias("hashes")))

    def written(act):
        before = _files(store)
        act()
        after = _files(store)
        assert {p: after.get(p) for p in before} == before  # no file is touched
        fresh = [p for p in after if p not in before]
        return sum(spark.read.parquet(str(p)).count() for p in fresh), sum(p.stat().st_size for p in fresh)

    rows, size = written(lambda: store.insert_videos(_videos(spark, [f"/new{k}" for k in range(10)])))
    assert rows == 10 and size < 100_000
    assert written(lambda: store.insert_hashes(_hashes(spark, [(50_001, [7]), (3, [9]), (50_002, [])])))[0] == 1
    assert written(lambda: store.delete_videos(spark.createDataFrame([(5,), (6,), (5,)], "id int")))[0] == 6  # two keys for each of three tables
    assert written(lambda: store.set_link_count(7, 4))[0] == 2  # a key and a row
    assert written(lambda: store.copy_metadata(7, 8))[0] == 2
    assert written(lambda: store.update_videos(spark.createDataFrame([(9, "/x"), (99_999, "/y")], "id int, path string")))[0] == 2
    assert store.read("video").count() == 50_008 and store.read("hash").count() == 49_999
    got = {r["id"]: (r["path"], r["num_hard_links"]) for r in store.read("video").where("id < 10").collect()}
    assert got == {k: (f"/v{k - 1:06d}", {7: 4, 8: 4}.get(k)) for k in (1, 2, 3, 4, 7, 8)} | {9: ("/x", None)}


def test_any_sequence_of_changes(spark, tmp_path):
    rng, store = random.Random(4), Store(spark, str(tmp_path / "s"))
    videos, hashes, last = {}, {}, 0
    for step in range(14):
        kind = (0, 2, 3, 4, 1, 5)[step % 6]
        some = sorted(rng.sample(range(1, last + 3), min(last + 2, 3)))
        if kind in (0, 1):
            paths = [f"/{step}-{k}" for k in range(rng.randrange(1, 4))]
            store.insert_videos(_videos(spark, paths))
            videos |= {last + k + 1: p for k, p in enumerate(paths)}
            last += len(paths)
        elif kind == 2:
            store.insert_hashes(_hashes(spark, [(i, [step]) for i in some]))
            hashes = {i: [step] for i in some} | hashes
        elif kind == 3:
            store.delete_videos(spark.createDataFrame([(i,) for i in some], "id int"))
            videos, hashes = ({k: v for k, v in d.items() if k not in some} for d in (videos, hashes))
        elif kind == 4:
            store.update_videos(spark.createDataFrame([(i, f"/u{step}") for i in some], "id int, path string"))
            videos = {k: f"/u{step}" if k in some else v for k, v in videos.items()}
        else:
            store.compact(rng.choice([2, 5]))
            store.vacuum(0 if rng.random() < 0.5 else 24)
        assert {r["id"]: r["path"] for r in store.read("video").collect()} == videos
        assert {r["video_id"]: r["hashes"] for r in store.read("hash").collect()} == hashes
    assert store.compact(1) and all(len(e) == 1 for e in store.state().tables.values())
    assert {r["id"]: r["path"] for r in store.read("video").collect()} == videos


def test_vacuum_leaves_readers_and_writers_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.insert_hashes(_hashes(spark, [(1, [5])]))
    reader, writer = store.read("hash"), store.change()
    writer.add("hash", _hashes(spark, [(2, [6])]))
    store.insert_hashes(_hashes(spark, [(3, [7])]))
    store.compact(2)
    store.vacuum()
    assert reader.count() == 1
    writer.commit()
    assert sorted(r["video_id"] for r in store.read("hash").collect()) == [1, 2, 3]
    store.compact(2)
    store.vacuum(0)
    assert len([p for p in Path(store.path, "hash").iterdir()]) == 1 and store.read("hash").count() == 3


def test_a_store_of_whole_tables_is_read_on(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.insert_videos(_videos(spark, ["/a", "/b"]))
    (entry,) = store.state().tables["video"]
    log = Path(store.path, "_commits")
    (log / f"{2:012d}.json").write_text(json.dumps({"video": entry[1]}))
    assert [r["id"] for r in store.insert_videos(_videos(spark, ["/c"])).collect()] == [3]
    assert store.read("video").count() == 3


def test_numbers_beyond_32_bits(spark):
    got = with_ids(spark.createDataFrame([("b",), ("a",)], "x string"), 1 << 33, "x").collect()
    assert {r["x"]: r["id"] for r in got} == {"a": (1 << 33) + 1, "b": (1 << 33) + 2}
