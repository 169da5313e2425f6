from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from nearmatch.plans.search import find_duplicates, search
from nearmatch.settings import HashMethod, SearchParams, SlowHash
from nearmatch.sources.probe import PgmAdapter
from nearmatch.sources.store import Store, read_config, write_config
from nearmatch.streaming.ingest import sample_stream, watch


def _video(path, seed, frames=10, brighter=False):
    rng = np.random.default_rng(seed)
    with open(path, "wb") as f:
        for _ in range(frames):
            plane = rng.integers(0, 120, (40, 50), dtype=np.uint8)
            f.write(b"P5\n50 40\n255\n" + (plane * 2 + 10 if brighter else plane).astype(np.uint8).tobytes())


def test_search_end_to_end(spark, tmp_path):
    media = tmp_path / "media"
    (media / "sub").mkdir(parents=True)
    _video(media / "a.mp4", 1)
    _video(media / "sub" / "b.mkv", 1, brighter=True)
    _video(media / "c.avi", 2)
    (media / "broken.mp4").write_bytes(b"nothing")
    (media / "note.txt").write_text("x")
    store = Store(spark, str(tmp_path / "store"))
    params = SearchParams(directories=((str(media), True), (str(tmp_path / "missing"), True)))
    found, progress = search(spark, store, params, PgmAdapter())
    assert (progress.found, progress.new, progress.probed, progress.hashed) == (4, 4, 3, 3)
    assert len(progress.errors) == 2
    names = {r["id"]: r["path"].rsplit("/", 1)[1] for r in store.read("video").collect()}
    sets = {frozenset(names[v] for v in r["video_ids"]) for r in store.load_groups().collect()}
    assert sets == {frozenset({"a.mp4", "b.mkv"}), frozenset({"c.avi"})}
    _, again = search(spark, store, params, PgmAdapter())
    assert (again.found, again.new) == (4, 1)  # the broken file was never stored
    slow = SearchParams(directories=params.directories, method=HashMethod.SLOW, slowHash=SlowHash(usePercentThreshold=True))
    assert store.load_settings() == SearchParams()
    store.save_settings(slow)
    assert store.load_settings() == slow
    gone = spark.createDataFrame([(next(i for i, n in names.items() if n == "a.mp4"),)], "id int")
    store.delete_videos(gone)
    assert store.read("video").count() == 2 and store.read("hash").count() == 2 and store.read("dup_group").count() == 2
    store.vacuum()
    assert store.read("video").count() == 2


def test_search_keeps_all_failed_probes(spark, tmp_path):
    media = tmp_path / "media"
    media.mkdir()
    for k in range(105):
        (media / f"broken{k:03}.mp4").write_bytes(b"nothing")
    _, progress = search(spark, Store(spark, str(tmp_path / "store")), SearchParams(directories=((str(media), True),)), PgmAdapter())
    assert (progress.new, progress.failed, progress.probed) == (105, 105, 0)
    assert {r["path"].rsplit("/", 1)[1] for r in progress.failures.collect()} == {f"broken{k:03}.mp4" for k in range(105)}
    assert len(progress.errors) == 101 and progress.errors[-1] == "cannot read 5 more files, 105 in all"


def test_scan_lists_every_file(spark, tmp_path):
    import os

    from nearmatch.sources import files

    root = tmp_path / "root"
    for name in ("a.mp4", "_b.mp4", ".c.mp4", "sub/x.mp4", "_hid/z.mp4", "sub/.deep/y.mp4", "sub/empty/"):
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.mkdir() if name.endswith("/") else at.write_text(name)
    os.symlink(root / "a.mp4", root / "link.mp4")
    os.symlink(root / "sub", root / "linked")
    os.symlink(root / "nowhere", root / "broken.mp4")
    names = lambda df: sorted(r["path"].removeprefix(f"{root}/") for r in df.collect())
    top = [".c.mp4", "_b.mp4", "a.mp4", "link.mp4"]
    assert names(files.scan(spark, str(root), recursive=False)) == top
    every = sorted([*top, "_hid/z.mp4", "sub/.deep/y.mp4", "sub/x.mp4"])
    assert names(files.scan(spark, str(root))) == names(files.scan(spark, f"file://{root}")) == every
    assert names(files.scan(spark, str(root / "sub" / "empty"))) == []
    # a store is listed by the tasks too, through Arrow
    stored = {(r["path"].removeprefix(f"file://{root}/"), r["size"]) for r in files._walk(spark, f"file://{root}", True).collect()}
    assert {x for x in stored if not x[0].startswith("linked/")} == {(n, len("a.mp4") if n == "link.mp4" else len(n)) for n in every}
    assert files.opened_by_tasks("/x") and files.opened_by_tasks("s3://bucket/x?region=eu-west-1") and not files.opened_by_tasks("viewfs://store/x")
    assert sorted(p for p, _, _ in map(tuple, files._walk_hadoop(spark, str(root / "sub"), True).collect())) == [f"file:{root}/sub/{n}" for n in (".deep/y.mp4", "x.mp4")]
    sizes = {r["path"]: (r["size"], r["num_hard_links"]) for r in files.with_identity(files.scan(spark, str(root), False)).collect()}
    assert sizes[f"{root}/a.mp4"] == (5, 1)
    gone = spark.createDataFrame([(f"{root}/gone.mp4", 1, "")], "path string, size long, modified_at string")
    assert files.with_identity(gone).count() == 0


def test_tables_of_a_scope_go_with_it(spark):
    from pathlib import Path

    from nearmatch.sources.shared import materialize, shared_dir, temporary

    before = set(Path(shared_dir(spark)).iterdir())
    with temporary(spark):
        inner = materialize(spark.range(5), "inner")
        outer = materialize(inner.where("id > 2"), "outer", stays=True)
    assert outer.count() == 2 and [p.name.split("-")[1] for p in set(Path(shared_dir(spark)).iterdir()) - before] == ["outer"]


def test_scopes_of_threads_are_their_own(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from nearmatch.sources.shared import materialize, temporary

    meet = Barrier(2, timeout=60)

    def work(k):
        with temporary(spark):
            df = materialize(spark.range(k + 3), f"thread{k}")
            meet.wait()
            if k:  # the other scope ends first
                meet.wait()
                return df.count()
        meet.wait()
        return 0

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(work, range(2))) == [0, 4]


def test_store_changes_all_tables_or_none(spark, tmp_path):
    import pytest

    store = Store(spark, str(tmp_path / "store"))
    store.store_groups(spark.createDataFrame([(1, 1), (1, 2)], "group_id int, video_id int"))
    before = store.state()
    whole = store.fs

    class Cut:
        """A file system that stops before a commit file stands."""

        def __getattr__(self, name):
            if name == "create":
                raise KeyboardInterrupt
            return getattr(whole, name)

    store.fs = Cut()
    with pytest.raises(KeyboardInterrupt):
        store.store_groups(spark.createDataFrame([(9, 9)], "group_id int, video_id int"))
    again = Store(spark, str(tmp_path / "store"))
    assert again.state() == before and again.read("dup_group_map").count() == 2 and again.read("dup_group").count() == 1
    again.vacuum()
    assert again.read("dup_group_map").count() == 2 and Store(spark, str(tmp_path / "store")).read("dup_group").count() == 1


def _failing():
    class Failing(PgmAdapter):
        """Fails as its files' names say; every fourth frame is a keyframe."""

        def probe(self, path):
            if "badprobe" in path:
                raise ValueError("probe")
            return PgmAdapter().probe(path)

        def frames(self, path):
            for k, f in enumerate(super().frames(path)):
                if "late" in path and k == 8:
                    raise ValueError("frame")
                yield (*f, k % 4 == 0)

    return Failing()


def test_failures_of_adapters_are_those_of_their_files(spark, tmp_path):
    media = tmp_path / "media"
    media.mkdir()
    for name, seed in (("good.mp4", 1), ("late.mp4", 1), ("badprobe.mp4", 1), ("copy.mp4", 1)):
        _video(media / name, seed)
    for method in (HashMethod.FAST, HashMethod.SLOW):
        store = Store(spark, str(tmp_path / f"store{method}"))
        found, progress = search(spark, store, SearchParams(directories=((str(media), True),), method=method, slowHash=SlowHash(useKeyframesOnly=False)), _failing())
        assert (progress.found, progress.probed, progress.failed, progress.hashed) == (4, 3, 1, 2)
        names = {r["id"]: r["path"].rsplit("/", 1)[1] for r in store.read("video").collect()}
        assert {names[r["video_id"]] for r in store.read("hash").collect()} == {"good.mp4", "copy.mp4"}
        assert {frozenset(names[v] for v in r["video_ids"]) for r in store.load_groups().collect()} == {frozenset({"good.mp4", "copy.mp4"}), frozenset({"late.mp4"})}


def test_keyframe_modes(spark, tmp_path):
    from nearmatch.functions.phash import hash_plane
    from nearmatch.settings import FastHash
    from nearmatch.sources.probe import hash_videos

    _video(tmp_path / "a.mp4", 5, frames=10)
    planes = [f[5] for f in PgmAdapter().frames(str(tmp_path / "a.mp4"))]
    videos = spark.createDataFrame([(1, str(tmp_path / "a.mp4"), 10)], "id int, path string, duration int")
    got = lambda p: hash_videos(videos, _failing(), p).first()["hashes"]
    want = lambda *at: [hash_plane(planes[k], 50, 40) for k in at]
    assert got(SearchParams(fastHash=FastHash(useKeyframesOnly=False))) == want(3, 7)
    assert got(SearchParams(fastHash=FastHash(useKeyframesOnly=True))) == want(0, 4)
    assert got(SearchParams(method=HashMethod.SLOW, slowHash=SlowHash(useKeyframesOnly=False))) == want(*range(10))
    assert got(SearchParams(method=HashMethod.SLOW, slowHash=SlowHash(useKeyframesOnly=True))) == want(0, 4, 8)


def test_slow_hashing_percent(spark):
    videos = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    rows = [(1, 16 << k) for k in range(4)] + [(2, 16), (2, 32), (3, 1 << 50)]
    params = SearchParams(method=HashMethod.SLOW, slowHash=SlowHash(hammingDistance=0, usePercentThreshold=True))
    got = {(r[0], r[1]) for r in find_duplicates(videos, spark.createDataFrame(rows, "video_id int, h long"), params).collect()}
    assert got == {(1, 1), (1, 2), (3, 3)}


def test_config(tmp_path):
    p = str(tmp_path / "config.json")
    assert read_config(p) is None
    write_config(p, "/x")
    assert read_config(p) == "/x"
    write_config(p, "")
    assert read_config(p) is None


def test_watch_skips_known(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in "abc":
        (folder / n).write_text(n)
    seen: list[str] = []
    known = spark.createDataFrame([(f"{folder}/b",)], "path string")
    for _ in range(2):
        q = watch(spark, str(folder), lambda df, _: seen.extend(r["path"].rsplit("/", 1)[1] for r in df.collect()), str(tmp_path / "cp"), lambda: known)
        q.awaitTermination(60)
    assert sorted(seen) == ["a", "c"]


def test_stream_sampler(spark, tmp_path):
    times = [0.0, 0.4, 1.2, 1.3, 2.5, 2.6]
    spark.createDataFrame([(1, t) for t in times], "key long, t double").coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("key long, t double").parquet(str(tmp_path / "s"))
    q = sample_stream(stream, 1.0).writeStream.format("memory").queryName("kept").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["t"] for r in spark.table("kept").collect()) == [0.0, 1.2, 2.5]
    assert spark.table("kept").where(F.col("key") != 1).count() == 0


def test_thumbnails(spark, tmp_path):
    from nearmatch.sources.thumbnails import pgm, write_thumbnails

    _video(tmp_path / "a.mp4", 1)
    videos = spark.createDataFrame([(1, str(tmp_path / "a.mp4"), 10), (2, str(tmp_path / "gone.mp4"), 10)], "id int, path string, duration int")
    got = {r["id"]: r["thumbnail_path"] for r in write_thumbnails(videos, str(tmp_path / "out"), PgmAdapter(), 3, pgm).collect()}
    assert got[2] == ["./sneed.png"] and len(got[1]) == 3
    assert got[1][0].endswith("_thumb-000.jpg") and open(got[1][0], "rb").read(14) == b"P5\n128 128\n255"


def test_counts_and_tags(spark):
    from nearmatch.plans.control import cancel, cancellable, counted

    with cancellable(spark, "search-1"):
        df, seen = counted(spark.range(10), even=F.col("id") % 2 == 0)
        assert df.count() == 10
    assert seen.get == {"rows": 10, "even": 5} and cancel(spark, "search-1") == []


def _decoded(spark, data):
    """The pixels of a picture file, by Java's reader."""
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    w, h, raster = image.getWidth(), image.getHeight(), image.getRaster()
    if raster.getNumBands() == 1:  # getRGB would change grey values
        return np.array([[[raster.getSample(x, y, 0)] for x in range(w)] for y in range(h)])
    return np.array([[[image.getRGB(x, y) >> s & 255 for s in (16, 8, 0)] for x in range(w)] for y in range(h)])


def test_jpeg_is_read_by_others(spark):
    from nearmatch.functions.jpeg import jpeg

    y, x = np.mgrid[0:21, 0:19]
    rgb = np.stack([x * 12, y * 11, (x + y) * 6], -1).astype(np.uint8)
    assert np.abs(_decoded(spark, jpeg(rgb, 95)).astype(int) - rgb).mean() < 3
    noise = np.random.default_rng(1).integers(0, 256, (24, 24), dtype=np.uint8)
    assert np.abs(_decoded(spark, jpeg(noise, 100))[:, :, 0].astype(int) - noise).max() < 6
    for flat in (0, 255):
        assert np.abs(_decoded(spark, jpeg(np.full((8, 8, 3), flat, np.uint8))).astype(int) - flat).max() < 3


def _y4m(path, frames, space="420jpeg", w=34, h=30, seed=0):
    rng = np.random.default_rng(seed)
    shape = {"420jpeg": (15, 17), "444": (30, 34), "mono": (0, 0)}[space]
    made = []
    with open(path, "wb") as f:
        f.write(b"YUV4MPEG2 W%d H%d F5:1 Ip A1:1 C%s\n" % (w, h, space.encode()))
        for _ in range(frames):
            planes = [rng.integers(0, 256, s, dtype=np.uint8) for s in ((h, w), shape, shape)]
            f.write(b"FRAME\n" + b"".join(p.tobytes() for p in planes))
            made.append(planes)
    return made


def test_y4m_search_and_thumbnails(spark, tmp_path):
    from nearmatch.sources.thumbnails import write_thumbnails
    from nearmatch.sources.y4m import Y4mAdapter

    media = tmp_path / "media"
    media.mkdir()
    made = _y4m(media / "a.mp4", 23)
    _y4m(media / "b.mkv", 23, "444")
    _y4m(media / "c.avi", 12, "mono", seed=9)
    (media / "d.mp4").write_bytes(b"YUV4MPEG2 W4 H4 C420p10\nFRAME\n")
    (media / "e.mp4").write_bytes((media / "a.mp4").read_bytes()[:-5])
    adapter = Y4mAdapter()
    assert [f[0] for f in adapter.frames(str(media / "a.mp4"))] == list(range(23)) and len(list(adapter.frames(str(media / "e.mp4")))) == 22
    assert all(f[5] == p[0].tobytes() for f, p in zip(adapter.frames(str(media / "a.mp4")), made))
    probe = adapter.probe(str(media / "a.mp4"))
    assert (probe["duration"], probe["width"], probe["height"], probe["avg_frame_rate"], probe["pix_fmt"]) == (4, 34, 30, 5.0, "yuv420p") and adapter.probe(str(media / "d.mp4")) is None
    (_, _, _, rgb), (_, u, v) = next(adapter.pictures(str(media / "a.mp4"))), made[0]
    y, cb, cr = float(made[0][0][7, 9]), float(u[3, 4]) - 128, float(v[3, 4]) - 128
    assert np.abs(rgb[7, 9] - np.clip([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 0, 255)).max() <= 0.5
    store = Store(spark, str(tmp_path / "store"))
    found, progress = search(spark, store, SearchParams(directories=((str(media), True),), method=HashMethod.SLOW, slowHash=SlowHash(matchingThresholdNum=3)), adapter)
    assert (progress.found, progress.failed, progress.hashed) == (5, 1, 4)
    names = {r["id"]: r["path"].rsplit("/", 1)[1] for r in store.read("video").collect()}
    assert frozenset({"a.mp4", "e.mp4"}) in {frozenset(names[v] for v in r["video_ids"]) for r in store.load_groups().collect()}
    got = write_thumbnails(store.read("video"), str(tmp_path / "out"), adapter, 2).collect()
    assert all(len(r["thumbnail_path"]) == 2 for r in got) and _decoded(spark, open(got[0]["thumbnail_path"][0], "rb").read()).shape == (128, 128, 3)
