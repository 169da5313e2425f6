from __future__ import annotations

import random
import re
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from helpers import brute_bytes, brute_words, corpus, documents

from nearmatch.llm import exact_dedup, repeats, simhash, substring_dedup, suffix_dedup


def _exact(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    keep, size = {}, {}
    for i, t in norm:
        keep[t] = min(i, keep.get(t, i))
        size[t] = size.get(t, 0) + 1
    return [(i, keep[t], size[t], i == keep[t], sha256(t.encode()).hexdigest()) for i, t in norm]


@pytest.mark.parametrize("capacity", [4, 4096])
def test_exact_dedup(spark, capacity):
    rows = corpus(1)
    got = exact_dedup.exact_dedup(documents(spark, rows), capacity).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(_exact(rows))


def test_exact_dedup_hot_text_and_repeated_rows(spark):
    rows = [(i, "the same") for i in range(1500)] + [(0, "the same"), (5000, "other"), (5001, None), (5002, "")]
    got = exact_dedup.exact_dedup(documents(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == 3
    assert {r["group_size"] for r in got if r["keep_id"] == 0} == {1501}
    assert {r["keep_id"] for r in got if r["doc_id"] > 5000} == {5001}


def test_exact_dedup_directory_splits(spark):
    rows = [(i, f"text {i}") for i in range(300)]
    index = exact_dedup.build_index(documents(spark, rows, extra=False), capacity=16).collect()
    per: dict = {}
    for r in index:
        per.setdefault(r["bucket"], []).append(r)
    assert len(index) == 300 and max(map(len, per.values())) <= 16 and len({r["local_depth"] for r in index}) > 1


def test_exact_dedup_empty_and_stage(spark):
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0
    df = documents(spark, [(2, "a  b"), (1, "a b"), (1, "a b"), (3, "c")])
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize("kinds", [1, 8])
def test_exact_dedup_walks_the_chains_of_colliding_keys(spark, kinds):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in enumerate(["a", "b  b", None, "c", "a", "b b", "", "d", "a", "\ta"] * 3)]
    few = lambda norm: F.shiftleft(F.pmod(F.xxhash64(norm), F.lit(kinds)), 61)
    got = exact_dedup.exact_dedup(documents(spark, rows), 1, key=few).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(_exact(rows))
    assert max(r["chain"] for r in got) > 0


def test_exact_dedup_needs_a_right_directory(spark, monkeypatch):
    whole = exact_dedup.directory

    def half(entries, capacity):
        slots, depth = whole(entries, capacity)
        return slots.where("slot % 2 = 0"), depth

    rows = corpus(1)
    monkeypatch.setattr(exact_dedup, "directory", half)
    assert exact_dedup.exact_dedup(documents(spark, rows), 4).count() < len(rows)


def test_exact_dedup_directory_doubles_to_a_bucket_a_key(spark):
    from pyspark.sql import functions as F

    entries = spark.range(64).select(F.shiftleft("id", 58).alias("key"))  # all of a directory of 64 slots
    slots, depth = exact_dedup.directory(entries, 1)
    assert depth == 6 and sorted(map(tuple, slots.select("slot", "bucket", "local_depth").collect())) == [(i, i, 6) for i in range(64)]


def test_exact_dedup_keeps_one_row_of_null_and_repeated_ids(spark):
    df = documents(spark, [(None, "only here"), (None, "copy"), (1, "copy"), (2, "x"), (2, "copy"), (None, "twice"), (None, "twice"), (2, "x")])
    got = [(r["doc_id"], r["text"]) for r in exact_dedup.keep_one(df).collect()]
    assert sorted(got, key=str) == sorted([(None, "only here"), (1, "copy"), (2, "x"), (None, "twice")], key=str)
    assert exact_dedup.exact_dedup(df).where("kept").count() == 4


def _fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _components(fps, radius):
    ids = sorted(fps)
    root = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            for j in ids:
                if (fps[i] ^ fps[j]).bit_count() <= radius:
                    root[i] = min(root[i], root[j])
    return root


def test_simhash(spark):
    rows = corpus(2)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    fps = {i: _fingerprint(t) for i, t in rows}
    roots = _components(fps, 4)
    assert got == {i: (fps[i], roots[i]) for i, _ in rows}


@pytest.mark.parametrize("tile", [8, 64])
def test_simhash_tiles_lose_no_link(spark, tile):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        for _ in range(8):
            for _ in range(rng.randrange(1, 6)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps |= {0, 1, 3}
    signed = sorted(int(np.uint64(f).astype(np.int64)) for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    from nearmatch.operators.components import union_find

    edges = [(r["src"], r["dst"]) for r in simhash.linked(df, 4, tile).collect()]
    mask = (1 << 64) - 1
    brute = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 4]
    assert all(((a ^ b) & mask).bit_count() for a, b in edges)
    assert union_find(*zip(*edges)) == union_find(*zip(*brute))


def test_simhash_stage_and_edges(spark):
    df = documents(spark, [(5, "one two three four five six"), (4, "one two three four five six"), (9, "quite another text about nothing at all")])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 9]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize(("length", "gram", "hot"), [(60, 16, 4000), (60, 16, 2), (200, 32, 4000)])
def test_suffix_dedup(spark, length, gram, hot):
    rows = corpus(3)
    got = suffix_dedup.suffix_dedup(documents(spark, rows), length, gram, hot).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute_bytes(rows, length) and len(got) == len(rows)


def test_suffix_dedup_periodic_and_repeated_rows(spark):
    rows = [(1, "ab" * 500), (2, "q" * 199), (3, "q" * 200), (4, "z" * 201), (5, None), (6, "ab" * 120)]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(documents(spark, rows)).collect()}
    assert got == brute_bytes(rows, 200)
    twice = suffix_dedup.suffix_dedup(documents(spark, [(1, "m" * 150 + "n" * 150)] * 2)).collect()
    assert [(r["n_removed"], r["n_spans"]) for r in twice] == [(300, 1)] * 2
    assert suffix_dedup.suffix_dedup(documents(spark, [])).count() == 0


def test_run_length_index_statistics():
    rng = random.Random(4)
    text = bytes(rng.choice(b"ab") for _ in range(150)) + b"abba" * 20
    n = len(text)
    got = suffix_dedup.RunLengthIndex(np.frombuffer(text, np.uint8).astype(np.int16) + 1).statistics()

    def match(i, j):
        k = 0
        while max(i, j) + k < n and text[i + k] == text[j + k]:
            k += 1
        return k

    assert got.tolist() == [max(match(i, j) for j in range(n) if j != i) for i in range(n)]


@pytest.mark.parametrize(("length", "gram", "hot"), [(10, 3, 4000), (10, 3, 2), (50, 12, 4000)])
def test_substring_dedup(spark, length, gram, hot):
    rows = corpus(5)
    got = substring_dedup.substring_dedup(documents(spark, rows), length, gram, hot).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute_words(rows, length) and len(got) == len(rows)


def test_substring_dedup_edges(spark):
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(7, same), (3, same.replace(" ", "\n")), (9, "start " + same), (1, None), (2, "w " * 400)]
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.substring_dedup(documents(spark, rows)).collect()}
    assert got == brute_words(rows, 50)
    assert substring_dedup.substring_dedup(documents(spark, [])).count() == 0
    assert substring_dedup.levels(50) == [1, 2, 4, 7, 13, 25, 50]


def test_anchors_of_equal_windows_are_equal():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 60, 50, dtype=np.uint64)
    texts = [np.r_[rng.integers(0, 1 << 60, k, dtype=np.uint64), shared, rng.integers(0, 1 << 60, 9, dtype=np.uint64)] for k in (0, 13, 77)]
    sizes = np.array([len(t) for t in texts])
    text, h, lo = repeats.anchors(np.concatenate(texts), sizes, 50, 12)
    of = []
    for k, at in enumerate((0, 13, 77)):
        mine = text == k
        of.append(h[mine][np.searchsorted(lo[mine], at, side="right") - 1])
    assert len(set(of)) == 1


@pytest.mark.parametrize(("length", "gram"), [(200, 32), (50, 12), (10, 3)])
def test_halves_keep_every_window_and_end(length, gram):
    rng = random.Random(3)
    for _ in range(200):
        windows = rng.randrange(1, length - gram + 2)
        p = rng.randrange(windows - 1, length - gram + 1)  # in every window
        todo, singles = [(0, length + windows - 1, p, p + gram)], []
        for _ in range(12):
            new = []
            for first, end, a, b in todo:
                if b - a == length:
                    singles.append(a)
                    continue
                for x, y, c, d in repeats.halves(end - first, a - first, b - first, length):
                    assert d - c > b - a and first + y - length <= first + c and d <= x + length
                    new.append((first + x, first + y, first + c, first + d))
            todo = new
        assert not todo and sorted(singles) == list(range(windows))


def test_run_length_index_is_the_transform_of_its_text():
    rng = random.Random(5)
    parts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40))) for _ in range(12)]
    parts += parts[:3]
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8).astype(np.int16) + 1
    text[text == 256] = 0
    index = suffix_dedup.RunLengthIndex(text)
    ends, n = np.flatnonzero(text == 0), len(text)
    order = sorted(range(n), key=lambda i: (*(int(x) for x in text[i : ends[np.searchsorted(ends, i)]]), 0, int(np.searchsorted(ends, i))))
    before = [int(text[i - 1]) if i and text[i - 1] else -1 for i in order]
    assert np.repeat(index.symbols, index.rows).tolist() == before and len(index.symbols) < n

    def match(i, j):
        k = 0
        while text[i + k] and text[i + k] == text[j + k]:
            k += 1
        return k

    assert index.statistics().tolist() == [max(match(i, j) for j in range(n) if j != i) for i in range(n)]
    high = suffix_dedup.RunLengthIndex(text, 9).statistics()
    assert (high >= 9).tolist() == (index.statistics() >= 9).tolist()


@pytest.mark.parametrize("hot", [2, 2000])
def test_repeats_of_null_ids_repeated_rows_and_hot_passages(spark, hot):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(40))
    rows = [(i, " ".join([*(word() for _ in range(rng.randrange(30))), passage, *(word() for _ in range(rng.randrange(30)))])) for i in range(1, 60)]
    line = " ".join(word() for _ in range(6))
    rows += [(i, " ".join([*(word() for _ in range(20)), line, *(word() for _ in range(20))])) for i in range(60, 120)]
    rows += [rows[3], (200, rows[3][1]), (0, rows[4][1]), (300, (rows[70][1] + " ") * 40)]
    nulls = [(None, rows[5][1]), (None, rows[5][1]), (None, "own " + " ".join(word() for _ in range(80)))]
    df = documents(spark, rows + nulls)
    # by bytes: a null id is a document like any other
    numbered = [(i if i is not None else 1000 + k, t) for k, (i, t) in enumerate(rows + nulls)]
    got = suffix_dedup.suffix_dedup(df, 120, 24, hot).collect()
    want = brute_bytes(numbered, 120)
    assert sorted(tuple(r)[1:] for r in got) == sorted(want[i] for i, _ in numbered)
    # by words: a null id is after all others
    got = substring_dedup.substring_dedup(df, 20, 5, hot).collect()
    want = brute_words([(i if i is not None else 5000, t) for i, t in rows + nulls[:1]], 20)
    for r in got:
        if r["doc_id"] is not None:
            assert tuple(r)[1:] == want[r["doc_id"]]
    assert sorted(r["n_removed"] for r in got if r["doc_id"] is None) == sorted([want[5000][1]] * 2 + [0])
