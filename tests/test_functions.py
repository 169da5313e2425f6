from __future__ import annotations

import struct
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearmatch.functions import hashing, media, phash
from nearmatch.settings import FastHash, HashMethod, SearchParams


def test_blob_decode_edges(spark):
    two = struct.pack("<qq", -5, 1 << 40)
    df = spark.createDataFrame([(1, bytearray(two + b"\x01\x02\x03\x04")), (2, bytearray(b"")), (3, bytearray(b"1234567")), (4, bytearray(struct.pack("<Q", 1 << 63)))], "video_id int, b binary")
    got = {r["video_id"]: r["h"] for r in df.select("video_id", hashing.decode_blob(F.col("b")).alias("h")).collect()}
    assert got == {1: [-5, 1 << 40], 2: [], 3: [], 4: [-(1 << 63)]}


def test_blob_round_trip(spark):
    values = [0, 1, -1, 2**62, -(2**63), 123456789]
    df = spark.createDataFrame([(values,)], "h array<bigint>")
    row = df.select(hashing.encode_blob(F.col("h")).alias("b"), hashing.decode_blob(hashing.encode_blob(F.col("h"))).alias("h")).first()
    assert row["h"] == values and bytes(row["b"]) == struct.pack("<6q", *values)



def test_a_long_blob_is_decoded_in_linear_time(spark):
    n = 20_000
    values = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.xxhash64(i + F.col("id")))
    df = spark.range(2).select(values.alias("h"), F.concat(hashing.encode_blob(values), F.unhex(F.lit("01"))).alias("b"))
    began = time.perf_counter()
    assert [r["same"] for r in df.select((hashing.decode_blob(F.col("b")) == F.col("h")).alias("same")).collect()] == [True, True]
    assert time.perf_counter() - began < 30


def test_pack_bits_equals_numpy(spark):
    rng = np.random.default_rng(3)
    blocks = [rng.normal(size=64).tolist() for _ in range(20)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, b array<double>")
    got = {r["i"]: r["h"] for r in df.select("i", hashing.pack_bits(F.col("b")).alias("h")).collect()}
    assert got == {i: phash.pack(np.array(b)) for i, b in enumerate(blocks)}
    assert all(h % 2 == 0 for h in got.values())


def test_flat_tiles_are_dropped_and_brightness_does_not_count():
    y, x = np.mgrid[0:32, 0:32]
    textured = np.random.default_rng(1).integers(0, 100, (32, 32)).astype(float)
    assert phash.hash_tile(np.full((32, 32), 7.0)) == 0
    assert phash.hash_tile(3.0 * x + 2.0 * y) == 0
    assert phash.hash_tile(textured) == phash.hash_tile(2 * textured + 10) != 0


def test_phash_of_planes(spark):
    plane = np.random.default_rng(2).integers(0, 256, (48, 64), dtype=np.uint8)
    df = spark.createDataFrame([(bytearray(plane.tobytes()), 64, 48), (None, 64, 48), (bytearray(b"x"), 0, 0)], "l binary, w int, h int")
    got = [r[0] for r in df.select(phash.phash(F.col("l"), F.col("w"), F.col("h"))).collect()]
    assert got == [phash.hash_plane(plane.tobytes(), 64, 48), None, None]
    assert not phash.is_flat(plane.tobytes(), 64, 48) and phash.is_flat(bytes(64 * 48), 64, 48)


def test_box_sum_is_the_plain_sum():
    p = np.arange(100.0).reshape(10, 10)
    padded = np.pad(p, 3, mode="edge")
    assert np.allclose(phash.box_sum(p), [[padded[i : i + 7, j : j + 7].sum() for j in range(10)] for i in range(10)])


@pytest.mark.parametrize(("path", "ext", "name", "parent"), [("/a/b.MKV", "mkv", "b.MKV", "/a"), ("/.mp4", "", ".mp4", "/"), ("x", "", "x", ""), ("/a.b/c", "", "c", "/a.b"), ("/a/b.tar.ts", "ts", "b.tar.ts", "/a")])
def test_paths(spark, path, ext, name, parent):
    p = F.lit(path)
    row = spark.range(1).select(media.extension(p), media.file_name(p), media.parent_path(p)).first()
    assert tuple(row) == (ext, name, parent)


def test_thumbnails_decode(spark):
    df = spark.createDataFrame([('["a","b"]',), ('"one"',), ("raw",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(media.decode_thumbnails(F.col("t"))).collect()] == [["a", "b"], ["one"], ["raw"], [], []]


def test_settings_codec():
    p = SearchParams(useGlob=True, extensions=("mp4",), directories=(("/a", False),), minBytes=5, method=HashMethod.SLOW)
    assert SearchParams.from_json(p.to_json()) == p
    assert SearchParams.from_json(None) == SearchParams.from_json("{") == SearchParams()
    import json

    old = json.loads(p.to_json())
    del old["fastHash"]["useKeyframesOnly"], old["slowHash"]["useKeyframesOnly"]
    old["fastHash"]["maxFrames"], old["slowHash"]["skipPercent"], old["thumbnailsPerVideo"] = 3, 99, 9
    q = SearchParams.from_json(json.dumps(old))
    assert q.fastHash == FastHash() and q.slowHash.useKeyframesOnly is False and q.slowHash.skipPercent == 40 and q.thumbnailsPerVideo == 4
    assert q.required == ("number", 5) and SearchParams().required == ("number", 2)


@given(st.lists(st.floats(-5, 50), max_size=30))
@settings(max_examples=50, deadline=None)
def test_median_threshold_sets_half_the_bits(values):
    block = np.arange(64.0)
    block[: len(values)] += np.array(values) if values else 0
    assert bin(phash.pack(block) & (1 << 64) - 1).count("1") <= 32


def test_tile_hash_by_definition():
    rng = np.random.default_rng(8)
    n = 32
    for _ in range(4):
        tile = rng.normal(size=(n, n))
        summed = np.array([[sum(tile[min(max(y + dy, 0), n - 1), min(max(x + dx, 0), n - 1)] for dy in range(-3, 4) for dx in range(-3, 4)) for x in range(n)] for y in range(n)])
        assert np.allclose(phash.box_sum(tile), summed)
        wave = lambda u, x: np.sqrt(2 / n) * np.cos(np.pi / (2 * n) * u * (2 * x + 1))
        block = [sum(wave(v, y) * wave(u, x) * summed[y, x] for y in range(n) for x in range(n)) for v in range(1, 9) for u in range(1, 9)]
        median = sorted(block)[31] / 2 + sorted(block)[32] / 2
        want = sum(1 << (64 - i) for i in range(1, 64) if block[i] > median)
        assert phash.hash_tile(tile) % (1 << 64) == want


@pytest.mark.parametrize("source", [1, 2, 5, 31, 32, 33, 100])
def test_scaling_weights_by_definition(source):
    out = phash._weights(source)
    for d in range(32):
        at = (d + 0.5) * source / 32 - 0.5
        share = at - np.floor(at)
        first = int(min(max(np.floor(at), 0), source - 1))
        want = np.zeros(source)
        want[first] += 1 - share
        want[min(first + 1, source - 1)] += share
        assert np.allclose(out[d], want)


def test_tiles_are_hashed_a_few_at_a_time():
    from nearmatch.plans.catalogue import _tile_hashes

    rows = pd.DataFrame({"vec_id": range(600), "embedding": list(np.random.default_rng(5).normal(size=(600, 64)).astype(np.float32))})
    parts = list(_tile_hashes(iter([rows, rows[:0]])))
    assert [len(p) for p in parts] == [256, 256, 88] and pd.concat(parts)["vec_id"].tolist() == list(range(600))


def test_settings_are_written_without_copies(monkeypatch):
    import copy

    monkeypatch.setattr(copy, "deepcopy", None)
    params = SearchParams(extensions=("mp4",), directories=(("a", True),), fastHash=FastHash(maxFrames=10))
    assert SearchParams.from_json(params.to_json()) == params
