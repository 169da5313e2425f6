"""Sampling and hashing where files are read, held against the same rules over tables of frames."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearmatch.functions.phash import hash_plane
from nearmatch.operators.sampling import AsOf, Greedy, forward_asof, sample_chunks, sample_fold
from nearmatch.settings import FastHash, HashMethod, SearchParams, SlowHash
from nearmatch.sources.probe import hash_video, hash_videos, read_frames


def Made():  # noqa: N802  a class that tasks get by value
    class Made:
        """Frames made from a path like "seed-count"; fails where the path says so."""

        def __init__(self, unit=(1, 4), gap=3):
            self.unit, self.gap = unit, gap

        def frames(self, path):
            seed, n, *fails = path.split("-")
            rng, pts = random.Random(int(seed)), 0
            for k in range(int(n)):
                if fails and k == int(fails[0]):
                    raise OSError("cut")
                plane = np.random.default_rng(int(seed) * 1000 + k).integers(0, 255, (16, 16), np.uint8)
                yield (None if rng.random() < 0.1 else pts), *self.unit, 16, 16, plane.tobytes(), rng.random() < 0.4
                pts += rng.randrange(0, self.gap)

    return Made()


def _frames(path):
    return list(Made().frames(path))


def test_sampler_is_the_fold(spark):
    rng = random.Random(1)
    for _ in range(20):
        times = [None if rng.random() < 0.1 else rng.randrange(-3, 40) / 4 for _ in range(rng.randrange(0, 60))]
        due = Greedy(1.0)
        assert [due.take(t) for t in times] == spark.createDataFrame([(times,)], "t array<double>").select(sample_fold(F.col("t"), 1.0)).first()[0]


def test_targets_are_those_of_the_join(spark):
    frames = [(v, f[0] / 4, k) for v in range(6) for k, f in enumerate(_frames(f"{v}-50")) if f[0] is not None]
    targets = [(v, t) for v in range(7) for t in (0.0, 1.25, 4.25, 7.0, 100.0)]
    got = forward_asof(spark.createDataFrame(frames, "v int, t double, n int"), spark.createDataFrame([*targets, *targets], "v int, target double"), "v", "t", "target", "n").collect()
    want = {(v, x): min((t, n) for w, t, n in frames if w == v and t >= x) for v, x in targets if any(w == v and t >= x for w, t, _ in frames)}
    assert {(r["v"], r["target"]): (r["t"], r["n"]) for r in got} == want and len(got) == len(want)
    for (v, x), (t, _) in want.items():
        pick = AsOf(x, keyframes=False)
        for f in _frames(f"{v}-50"):
            pick.take(f)
        assert pick.frame[0] / 4 == t


def test_forward_asof_makes_no_pairs(spark):
    plan = forward_asof(spark.range(9).select("id", "id", F.col("id").alias("n")).toDF("v", "t", "n"), spark.range(9).select("id", F.col("id").alias("x")).toDF("v", "x"), "v", "t", "x", "n")
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()


def _expected(path, duration, params):
    """By definition, over all frames of a file."""
    frames = _frames(path)
    h = lambda f: hash_plane(f[5], 16, 16)
    if params.method is HashMethod.SLOW:
        due = Greedy(1.0)
        keys = [f for f in frames if f[6] or not params.slowHash.useKeyframesOnly]
        kept = [f for f in keys if due.take(None if f[0] is None else f[0] / 4)]
        return [x for _, x in sorted((-1 if f[0] is None else f[0], h(f)) for f in kept if h(f))]
    out = []
    for share in (0.30, 0.70):
        at = round(share * duration * 4)
        timed = [f for f in frames if f[0] is not None]
        if params.fastHash.useKeyframesOnly:
            keys = [f for f in timed if f[6]]
            before = [f for f in keys if f[0] <= at]
            found = max(f[0] for f in before) if before else min((f[0] for f in keys), default=None)
            out += [h(next(f for f in keys if f[0] == found))] if keys else []
        else:
            after = [f for f in timed if f[0] >= at]
            out += [h(min(after, key=lambda f: f[0]))] if after else []
    return out if len(out) == 2 else []


@pytest.mark.parametrize("keys", [True, False])
@pytest.mark.parametrize("method", [HashMethod.FAST, HashMethod.SLOW])
def test_hashes_by_definition(method, keys):
    params = SearchParams(method=method, fastHash=FastHash(useKeyframesOnly=keys), slowHash=SlowHash(useKeyframesOnly=keys))
    for seed in range(12):
        path = f"{seed}-{seed * 7 % 50}"
        for duration in (1, 7, 40):
            assert hash_video(Made(), path, duration, params) == _expected(path, duration, params)
    assert hash_video(Made(), "1-30", None, SearchParams()) == []


def test_a_file_is_one_row_and_no_pixels_move(spark):
    rows = [(k, f"{k}-40") for k in range(1, 40)] + [(40, "1-40-39"), (41, "2-40-0"), (42, "3-0"), (43, "x")]
    videos = spark.createDataFrame([(i, p, 5) for i, p in rows], "id int, path string, duration int")
    params = SearchParams(method=HashMethod.SLOW, slowHash=SlowHash(useKeyframesOnly=False))
    found = hash_videos(videos, Made(), params)
    got = {r["video_id"]: (r["hashes"], r["fatal"]) for r in found.collect()}
    assert got == {i: (_expected(p, 5, params), False) for i, p in rows[:-4]} | {40: ([], True), 41: ([], True), 42: ([], False), 43: ([], True)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "luma" not in plan and "Join" not in plan and "Window" not in plan
    assert read_frames(videos, Made()).where("fatal").count() == 3


def test_seek_finds_the_same_hashes(tmp_path):
    from nearmatch.sources.y4m import Y4mAdapter

    class Linear(Y4mAdapter):
        seek = property()  # hasattr is false

    rng = np.random.default_rng(3)
    for name, word in (("a", b"FRAME\n"), ("b", b"FRAME Ip\n")):
        with open(tmp_path / name, "wb") as f:
            f.write(b"YUV4MPEG2 W20 H16 F5:1 Cmono\n")
            for _ in range(33):
                f.write(word + rng.integers(0, 256, 320, np.uint8).tobytes())
        for keys in (True, False):
            params = SearchParams(fastHash=FastHash(useKeyframesOnly=keys))
            for duration in (1, 6, 6.6, 9):
                at = str(tmp_path / name)
                assert hash_video(Y4mAdapter(), at, duration, params) == hash_video(Linear(), at, duration, params)
    first = next(Y4mAdapter().seek(str(tmp_path / "a"), 3.1))
    assert first[0] == 15


def test_spans_of_any_chunks_are_the_fold():
    from nearmatch.operators.sampling import Span

    rng = random.Random(9)
    for _ in range(300):
        steps = [None if rng.random() < 0.2 else rng.randrange(-2, 12) for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.5:
            steps.sort(key=lambda f: (f is None, f))
        cuts = sorted(rng.randrange(len(steps) + 1) for _ in range(rng.randrange(4)))
        whole = Span(0, np.zeros(0, np.int64))
        for a, b in zip([0, *cuts], [*cuts, len(steps)]):
            whole = whole.then(Span.of(steps[a:b]))
        for start in range(15):
            kept = start
            for f in steps:
                kept += f is None or kept <= f
            assert whole.after(start) == kept


@pytest.mark.parametrize("chunk,fan", [(5, 3)])
def test_one_video_in_many_chunks(spark, chunk, fan):
    rng = random.Random(chunk)
    rows, want = [], {}
    for v in (1, 2, None):
        due, t = Greedy(0.5), 0.0
        for k in range(80 if v == 1 else 5):
            t += rng.choice([0.0, 0.1, 0.25, 0.6, 3.0])
            seen = None if rng.random() < 0.15 else t
            rows.append((v, k, seen))
            want[v, k] = due.take(seen)
    df = spark.createDataFrame(rows, "v long, k int, t double").repartition(3)
    got = sample_chunks(df, "v", "t", 0.5, "k", chunk=chunk, fan=fan).collect()
    assert {(r["v"], r["k"]): r["due"] for r in got} == want and len(got) == len(rows)


def test_spans_of_many_runs_are_made_together(monkeypatch):
    from nearmatch.operators.sampling import UNTIMED, Span

    rng, put_together, then = np.random.default_rng(4), [], Span.then
    monkeypatch.setattr(Span, "then", lambda a, b: put_together.append(1) or then(a, b))
    runs = rng.integers(-1, 60, (20, 300))
    runs[rng.random(runs.shape) < 0.1] = UNTIMED
    runs[:10].sort(axis=1)
    for at, (span, run) in enumerate(zip(Span.of_runs(runs), runs)):
        for start in range(at * 4):
            kept = start
            for f in run:
                kept += f == UNTIMED or kept <= f
            assert span.after(start) == span.from_place(at * 4).after(start) == kept
    assert len(put_together) == 20 * 2  # frames were put together one by one
    # few can be kept before the first frames of a video, so that later drops are left out
    assert len(Span.of(list(range(1000))).from_place(7).drops) <= 7


@pytest.mark.parametrize("frames", [1, 1 << 18])
def test_chunks_of_frames_are_rows_and_times_may_be_endless(spark, monkeypatch, frames):
    from nearmatch.operators import sampling

    monkeypatch.setattr(sampling, "FRAMES", frames)
    inf, rng = float("inf"), random.Random(5)
    rows, want = [], {}
    for v in (1, None):
        due = Greedy(0.5)
        for k in range(60):
            seen = rng.choice([None, -inf, -3.0, k / 8, k / 4, inf])
            rows.append((v, k, seen))
            want[v, k] = due.take(seen)
    found = sample_chunks(spark.createDataFrame(rows, "v long, k int, t double"), "v", "t", 0.5, "k", chunk=7, fan=2)
    assert {(r["v"], r["k"]): r["due"] for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMap" not in plan and "MapInArrow" in plan  # no call for each chunk


def test_stream_in_any_order_is_sampled_as_the_whole(spark, tmp_path):
    from nearmatch.streaming.ingest import sample_stream

    rng = random.Random(6)
    rows = [(key, None if rng.random() < 0.1 else k / 4, k / 4) for key in (1, 2) for k in range(60)]
    mixed = sorted(rows, key=lambda r: r[2] + rng.random() * 3)  # up to 3 seconds out of order
    rows_in = [mixed[:40], mixed[40:41], mixed[41:90], mixed[90:], [(1, 100.0, 100.0)]]
    schema = "key long, t double, s double"
    for k, part in enumerate(rows_in):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    frames = stream.select("key", "t", F.timestamp_seconds(F.col("s") + 1e9).alias("at"))
    q = sample_stream(frames, 1.0, "4 seconds").writeStream.format("memory").queryName("ordered").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(200)
    got = [(r["key"], r["t"]) for r in spark.table("ordered").collect()]
    want = []
    for key in (1, 2):
        due = Greedy(1.0)
        want += [(key, t) for k, t, _ in rows if k == key and due.take(t)]
    assert sorted(map(str, got)) == sorted(map(str, want))
