from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from nearmatch.operators import actions, filters, groups, sampling, similarity
from nearmatch.operators.components import connected_components, union_find
from nearmatch.plans import catalogue
from nearmatch.settings import FastHash, HashMethod, SearchParams, SlowHash
from nearmatch.sources import store as stores


def _hashes(spark, rows):
    return spark.createDataFrame(rows, "video_id long, h long")


def _counts(df):
    return {(r["src"], r["dst"]): r["matches"] for r in similarity.match_counts(df).collect()}


@pytest.mark.parametrize("radius", [0, 1, 4, 10, 20, 63])
def test_banded_equals_brute(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(63) << 1 for _ in range(6)]
    rows = []
    for v in range(30):
        h = rng.choice(base)
        for _ in range(rng.randrange(radius + 2)):
            h ^= 1 << rng.randrange(1, 64)
        rows += [(v, h - (1 << 64) if h >> 63 else h)] * rng.choice([1, 1, 2])
    df = _hashes(spark, rows)
    brute = _counts(similarity.hamming_pairs_brute(df, radius))
    assert brute == _counts(similarity.hamming_pairs_banded(df, radius)) == _counts(similarity.hamming_pairs(df, radius))
    rows_of = lambda pairs: sorted(map(tuple, pairs.collect()))
    for tile in (4, 8192):
        assert rows_of(similarity.hamming_pairs_tiled(df, radius, tile)) == rows_of(similarity.hamming_pairs_brute(df, radius))


@pytest.mark.parametrize("params", [SearchParams(), SearchParams(fastHash=FastHash(hammingDistance=2, matchingThreshold=6)), SearchParams(method=HashMethod.SLOW, slowHash=SlowHash(usePercentThreshold=True, matchingThresholdPct=60.0))])
def test_classes_have_the_components_of_all_pairs(spark, params):
    rng = random.Random(21)
    collections = [[rng.choice((1 << 20, 3 << 20, 7 << 40, rng.getrandbits(60) << 2)) for _ in range(rng.randrange(1, 6))] for _ in range(12)] + [[0], [8, 0]]
    rows, ids = [], []
    for v in range(60):
        ids.append((v,))
        rows += [(v, h) for h in rng.choice(collections)]
    df, videos = _hashes(spark, rows), spark.createDataFrame(ids, "id int")
    every = groups.membership(videos, similarity.edges_for(df, params))
    found = groups.membership(videos, similarity.linked_classes(df, params))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, every.collect()))


def test_equal_videos_are_compared_once(spark):
    n = 3000
    rows = [(v, h) for v in range(n) for h in (16, 1 << 40)] + [(n, 16), (n, 1 << 40 | 2), (n + 1, (1 << 60) - 2)]
    links = similarity.linked_classes(_hashes(spark, rows), SearchParams()).collect()
    assert len(links) == n and {max(r) for r in links} == {*range(1, n), n}


@pytest.mark.parametrize(
    "params,heavy_from",
    [
        (SearchParams(), 1),
        (SearchParams(fastHash=FastHash(hammingDistance=2, matchingThreshold=1)), 3),
        (SearchParams(method=HashMethod.SLOW, slowHash=SlowHash(usePercentThreshold=True, matchingThresholdPct=60.0)), 3),
    ],
)
def test_heavy_hashes_change_no_component(spark, params, heavy_from):
    rng = random.Random(heavy_from)
    common = [1 << 20, 1 << 20 | 8, 7 << 40, 7 << 40 | 6]  # two that many have, and near ones of each
    rows, ids = [], []
    for v in range(70):
        ids.append((v,))
        own = [rng.getrandbits(60) << 2 for _ in range(rng.randrange(0, 3))]
        rows += [(v, h) for h in own + rng.choices(common, k=rng.randrange(0, 4))]
        rows += [(v, rng.choice(rows)[1])] if v % 5 == 0 and rows else []
    df, videos = _hashes(spark, rows), spark.createDataFrame(ids, "id int")
    every = groups.membership(videos, similarity.edges_for(df, params))
    found = groups.membership(videos, similarity.linked_classes(df, params, heavy_from=heavy_from))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, every.collect()))


def test_a_hash_that_all_share_makes_no_pairs(spark):
    n, rng = 10_000, random.Random(8)
    rows = [(v, h) for v in range(n) for h in (16, rng.getrandbits(60) << 2)]
    rows += [(n, 16), (n, rows[1][1] ^ 64), (n + 1, 16), (n + 1, 24), (n + 2, 16), (n + 2, 48)]
    made = []
    plain = similarity.match_counts

    def counted(pairs):
        made.append(pairs.count())
        return plain(pairs)

    similarity.match_counts = counted
    try:
        links = {tuple(sorted(r)) for r in similarity.linked_classes(_hashes(spark, rows), SearchParams()).collect()}
    finally:
        similarity.match_counts = plain
    assert sum(made) < 100
    # one shares its other hash nearly; those with two near the common one match each other and everyone
    assert (0, n) in links and (n + 1, n + 2) in links
    found = connected_components(spark.createDataFrame(list(links), "src long, dst long"))
    assert found.where("component = 0").count() == n + 3


def test_bands_bring_near_hashes_together():
    rng = random.Random(3)
    for radius in (0, 1, 4, 7, 10):
        for n in range(1, radius + 2):
            plan = similarity.bands(radius, n)
            assert sum(b.width for b in plan) == 63 and sum(b.differ + 1 for b in plan) == radius + 1
            for _ in range(200):
                x = 0
                for _ in range(radius):
                    x |= 1 << rng.randrange(63)
                assert any((x >> b.shift & (1 << b.width) - 1).bit_count() <= b.differ for b in plan)
    for hashes in (10**3, 10**5, 10**7, 10**9, 10**11):
        plan = similarity.plan_bands(4, hashes)
        by_chance = sum(b.probes * hashes / 2**b.width for b in plan)
        assert by_chance <= 400 * max(1, hashes / 10**9) and sum(b.probes for b in plan) <= similarity.MOST_ROWS
    assert len(similarity.plan_bands(4, 1000)) == 5 and len(similarity.plan_bands(4, 10**9)) == 2


@pytest.mark.parametrize("n", [2, 3])
def test_every_number_of_bands_gives_the_same_pairs(spark, n):
    rng = random.Random(n)
    rows = []
    for v in range(300):
        h = rng.choice(rows)[1] if rows and v % 3 else rng.getrandbits(62) << 1
        for _ in range(rng.randrange(7)):
            h ^= 1 << rng.randrange(1, 63)
        rows.append((v % 80, h))
    df = _hashes(spark, rows)
    assert _counts(similarity.hamming_pairs_banded(df, 4, similarity.bands(4, n))) == _counts(similarity.hamming_pairs_brute(df, 4))


def _near_rows(seed, n, videos):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        h = rng.choice(rows)[1] if rows and rng.random() < 0.7 else rng.getrandbits(62) << 1
        for _ in range(rng.randrange(14)):
            h ^= 1 << rng.randrange(1, 63)
        rows += [(rng.randrange(videos), h)] * rng.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("radius", [5, 18])
def test_tiles_on_bands_give_the_same_pairs(spark, monkeypatch, radius):
    df = _hashes(spark, _near_rows(radius, 400, 90))
    rows_of = lambda pairs: sorted(map(tuple, pairs.collect()))
    brute = rows_of(similarity.hamming_pairs_brute(df, radius))
    monkeypatch.setattr(similarity, "LEAST_TILE", 128)
    for prefix in (None, 3):
        rows = similarity.weighted(df)
        assert rows_of(similarity._pairs_of(similarity._banded(rows, radius, prefix=prefix), rows)) == brute
    monkeypatch.setattr(similarity, "MOST_CANDIDATES", 0)
    assert rows_of(similarity.hamming_pairs_banded(df, radius)) == brute


@pytest.mark.parametrize("videos", [5, 90])
def test_tasks_count_what_pairs_of_tiles_hold(spark, monkeypatch, videos):
    df = _hashes(spark, _near_rows(videos, 400, videos))
    matches = lambda counts: sorted(map(tuple, counts.select("src", "dst", "matches").collect()))
    plain = {radius: matches(similarity.match_counts(similarity.hamming_pairs_brute(df, radius))) for radius in (5, 18)}
    monkeypatch.setattr(similarity, "LEAST_TILE", 128)
    monkeypatch.setattr(similarity, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(similarity, "MOST_CANDIDATES", 0)
    # a pair of tiles is a task, and no pair of hashes is a row
    found = similarity._tiled(similarity.weighted(df), 18)
    assert found.work.count() == found.work.rdd.getNumPartitions() > 5
    monkeypatch.setattr(similarity, "match_counts", None)
    for radius, strategy in ((18, "auto"), (18, "banded"), (5, "auto"), (5, "tiled")):
        assert matches(similarity.hamming_matches(df, radius, strategy)) == plain[radius]


def test_match_rules(spark):
    df = _hashes(spark, [(1, 8), (2, 8), (2, 8), (2, 8), (3, 0), (4, 8 ^ 0b111100000), (5, 8 ^ 0b1111100000)])
    counts = similarity.match_counts(similarity.hamming_pairs(df, 4))
    got = {(r["src"], r["dst"]): r["matches"] for r in counts.collect()}
    assert got[(1, 2)] == 3 and got[(1, 4)] == 1 and (1, 5) not in got and not any(3 in k for k in got)
    n = spark.createDataFrame([(5, 4)], "a int, b int").select(similarity.required_matches(F.col("a"), F.col("b"), 50.0)).first()[0]
    assert n == 3


def test_components_match_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(120)]
    df = spark.createDataFrame(pairs, "src long, dst long").repartition(7)
    expected = union_find(*zip(*[p for p in pairs if p[0] != p[1]]))
    for small in (0, 10_000):
        got = {r["id"]: r["component"] for r in connected_components(df, small=small).collect()}
        assert got == expected
    assert connected_components(df.where("false")).count() == 0


def test_chains_over_all_orders(spark, tmp_path):
    keys = [*range(1, 900), 3999, 4000, 4001, 4004, *range(50_000, 50_400), 9_000_001]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").repartition(5).write.parquet(f"{tmp_path}/orders.parquet")
    pairs = {(k // 4, k // 4 + 1) for k in keys if k // 4 % 40 != 39}
    got = catalogue.QUERIES["components_chain_whole"](spark, str(tmp_path)).collect()
    expected = union_find(*zip(*pairs))
    assert len(got) == len(expected) and {r["id"]: r["component"] for r in got} == expected


def test_membership_keeps_isolated_and_ignores_unknown(spark):
    videos = spark.createDataFrame([(i,) for i in (1, 2, 3, 7)], "id int")
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 99)], "src long, dst long")
    m = groups.membership(videos, e)
    assert {(r["group_id"], r["video_id"]) for r in m.collect()} == {(1, 1), (1, 2), (1, 3), (7, 7)}
    assert {r["video_id"] for r in groups.with_duplicates(m).collect()} == {1, 2, 3}


def test_selection_keeps_first_of_ties(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 9), ("h", 4, 1)], "g string, id int, size int")
    both = groups.except_extreme(groups.except_extreme(df, "g", "size", "id", True, "l"), "g", "size", "id", False, "s")
    got = {r["id"]: (r["l"], r["s"]) for r in both.collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (True, True), 4: (False, False)}


def test_report(spark):
    rows = [("g", i, f"/v/{i}.mp4", 2**30 * i, 5_000_000, 10, 20, 25.0, 60, "h264", "", None, ["a"] * 6) for i in (1, 2)] + [("h", 3, "/x", 1, 1, 1, 1, 1.0, 1, None, "", "", [])]
    df = spark.createDataFrame(rows, "group_id string, id int, path string, size long, bit_rate int, width int, height int, avg_frame_rate double, duration int, video_codec string, pix_fmt string, profile string, thumbnail_path array<string>")
    got = groups.report(df).orderBy("group_id", "position").collect()
    assert [r["row_type"] for r in got] == ["group", "video", "video"]
    assert got[0]["label"] == "Group 1 (2 Duplicates - Size: 3.00 GB)"
    assert (got[1]["id"], got[1]["size_text"], got[1]["codec"], len(got[1]["thumbnails"])) == (2, "2.00 GB", "h264 / unknown / unknown", 4)


def test_filters():
    assert filters.glob_to_regex("*.mp4") == "^.*\\.mp4$" and filters.glob_to_regex("a?b") == "^a.b$" and filters.glob_to_regex("x[1]") == "^x\\[1\\]$"
    good, errors = filters.compile_patterns(["a(", "b"], ignore_case=True)
    assert good == ["(?i)b"] and len(errors) == 1 and errors[0].startswith("a( ➜ ") and filters.error_text(errors).startswith("• a(")


def test_patterns_are_checked_in_the_dialect_that_runs_them(spark):
    good, errors = filters.compile_patterns(["(?P<y>a)b", "a{,2}", "[a&&b]", "(?<y>a)b", "x[", "*"])
    assert good == ["[a&&b]", "(?<y>a)b"] and len(errors) == 4 and all("\n" not in e for e in errors)
    df = spark.createDataFrame([("ab",)], "s string")
    assert [filters.pattern_test(df, "s", p).first()["matches"] for p in ("(?P<y>a)b", "a{,2}", "(?<y>a)b")] == [False, False, True]


def test_file_rules(spark):
    df = spark.createDataFrame([("/d/.mp4", 5), ("/d/A.MKV", 5), ("/d/x.mng", 5), ("/d/x.mxf", 10), ("/d/y.mp4", 11), ("/d/z.mp4", None), ("/d/t.txt", 7)], "path string, size long")
    ok = df.where(filters.by_extension(F.col("path"))).where(filters.by_size(F.col("size"), 5, 10))
    assert {r["path"] for r in ok.collect()} == {"/d/A.MKV", "/d/x.mng", "/d/x.mxf"}
    strict = df.where(filters.by_extension(F.col("path"), strict_compat=True))
    assert {r["path"] for r in strict.collect()} == {"/d/A.MKV", "/d/y.mp4", "/d/z.mp4"}
    inc = df.where(filters.include_exclude(F.col("path"), F.lit("/d"), ["mp4"], [], ["y"], ["d"]))
    assert {r["path"] for r in inc.collect()} == {"/d/.mp4", "/d/y.mp4", "/d/z.mp4"}


def _fold(times, step):
    due, out = 0.0, []
    for t in times:
        keep = t is None or t >= due
        due += step if keep else 0
        out.append(keep)
    return out


def test_sampler_equals_fold(spark):
    rng = random.Random(9)
    rows, expected = [], {}
    for k in range(60):
        times = sorted(rng.uniform(-3, 20) for _ in range(rng.randrange(1, 25)))
        rows += [(k, i, t) for i, t in enumerate(times)]
        expected[k] = _fold(times, 1.0)
    got: dict = {}
    for r in sampling.sample_frames(spark.createDataFrame(rows, "k int, i int, t double"), "k", "t", 1.0, "i").orderBy("k", "i").collect():
        got.setdefault(r["k"], []).append(r["due"])
    assert got == expected
    with_null = [None, 0.2, None, 1.1, 1.2, 3.0]
    df = spark.createDataFrame([(with_null,)], "t array<double>")
    assert df.select(sampling.sample_fold(F.col("t"), 1.0)).first()[0] == _fold(with_null, 1.0)


def test_hardlink_plan_and_update(spark):
    rows = [(1, 10, 0, True, 100, 1), (1, 11, 1, True, 100, 1), (1, 12, 2, True, 102, 1), (1, 13, 3, False, 103, 1), (2, 20, 0, True, 5, 1), (2, 21, 1, False, 5, 1)]
    plan = actions.hardlink_plan(spark.createDataFrame(rows, "group_id int, video_id int, position int, selected boolean, inode long, device long"))
    got = {r["video_id"]: (r["source_id"], r["action"], r["new_links"]) for r in plan.collect()}
    assert got == {10: (10, "source", 3), 11: (10, "already", 3), 12: (10, "link", 3), 13: (10, "none", None), 20: (None, "none", None), 21: (None, "none", None)}


def test_replace_by_link(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("a")
    b.write_text("b")
    actions.replace_by_link(str(a), str(b))
    assert b.read_text() == "a" and a.stat().st_ino == b.stat().st_ino and len(list(tmp_path.iterdir())) == 2


def test_delete_files(spark, tmp_path):
    (tmp_path / "a").write_text("a")
    (tmp_path / "d").mkdir()
    rows = [(1, str(tmp_path / "a")), (2, str(tmp_path / "gone")), (3, str(tmp_path / "d")), (4, None)]
    _, gone = actions.delete_plan(spark.createDataFrame(rows, "id int, path string"), spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "id int"), "disk")
    got = {r["id"]: r["error"] for r in actions.delete_files(gone).collect()}
    assert got[1] is got[2] is got[4] is None and got[3] and not (tmp_path / "a").exists() and (tmp_path / "d").exists()


def test_upsert_of_whole_rows_writes_null(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, s string, x double")
    new = spark.createDataFrame([(2, None, 5.0), (3, "c", 1.0)], "id int, s string, x double")
    assert {tuple(r) for r in stores.upsert(old, new, "id", whole=True).collect()} == {(1, "a", 1.0), (2, None, 5.0)}


def test_upsert_and_ids(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, s string, x double")
    new = spark.createDataFrame([(2, None, 5.0), (3, "c", 1.0)], "id int, s string, x double")
    assert {tuple(r) for r in stores.upsert(old, new, "id").collect()} == {(1, "a", 1.0), (2, "b", 5.0)}
    rows = spark.createDataFrame([(f"p{i:03d}",) for i in range(100)], "path string").repartition(5)
    got = stores.with_ids(rows, 10, "path").orderBy("id").collect()
    assert [(r["path"], r["id"]) for r in got] == [(f"p{i:03d}", 11 + i) for i in range(100)]


@pytest.mark.parametrize("hot_rows", [5, 10_000])
def test_lookup_and_places_of_groups_of_any_size(spark, hot_rows):
    from nearmatch.operators.joins import lookup, with_places

    rng = random.Random(hot_rows)
    rows = [(i, rng.choice(["hot", "hot", None, f"g{rng.randrange(40)}"]), rng.randrange(6)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, size int").repartition(5)
    entries = df.where("g IS NULL OR g <> 'g3'").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    got = {r["id"]: r["found"] for r in lookup(df, entries, "g", "n", "id", hot_share=0.0, hot_rows=hot_rows).collect()}
    total = {g: (sum(h == g for _, h, _ in rows), sum(s for _, h, s in rows if h == g)) for _, g, _ in rows}
    assert len(got) == 600 and all((tuple(got[i]) if got[i] else None) == (None if g == "g3" else total[g]) for i, g, _ in rows)
    places = {r["id"]: r["place"] for r in with_places(df, "g", F.desc("size"), F.asc("id")).collect()}
    for _, g, _ in rows:
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        assert [places[i] for i, _, _ in mine] == list(range(1, len(mine) + 1))


def test_one_group_of_all_rows_is_many_tasks(spark):
    rows = spark.range(40_000).select("id", F.lit("all").alias("g"), (F.col("id") % 97).alias("size"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (groups.except_extreme(rows, "g", "size", "id", True), groups.place_in_group(rows, "g", "size", "id"), groups.with_duplicates(rows, "g", "id"), groups.first_in_group(rows, "g", "id")):
            per = df.groupBy(F.spark_partition_id()).count().collect()
            assert len(per) == 4 and max(r["count"] for r in per) < 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    placed = groups.place_in_group(rows, "g", "size", "id")
    assert placed.select(F.max("place"), F.countDistinct("place")).first() == (40_000, 40_000)
