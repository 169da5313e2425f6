"""Divergence audit, Merkle manifest and WARC archives, against brute force, SQL and round trips."""

from __future__ import annotations

import gzip
import random
import re
import zlib
from base64 import b32encode
from collections import Counter, defaultdict
from hashlib import sha1, sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from helpers import CLASHING
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SF, comparable, connect
from pyspark.sql import functions as F

from nearmatch.llm import divergence, manifest, queries, warc


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_merkle_manifest", "op13_warc"])
def test_against_sql(spark, name):
    ours, theirs = queries.QUERIES[name](spark, SF), connect().sql(queries.ORACLE_SQL[name])
    assert comparable(ours.columns, ours.collect()) == comparable(theirs.columns, theirs.fetchall())


# divergence


def _docs(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING if c not in ("text", "lang", "source")]).repartition(3)


def _audit(rows):
    """pair and term values by definition."""
    words = defaultdict(Counter)
    docs_of = defaultdict(lambda: defaultdict(int))
    groups = set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [m.lower().decode() for m in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())]
        words[lang, source].update(found)
        for w in set(found):
            docs_of[lang][w] += 1
    pairs, terms = {}, {}
    for lang in {g[0] for g in groups}:
        kept = [w for w, d in docs_of[lang].items() if d >= 3]
        sources = sorted(s for g, s in groups if g == lang)
        every = sum((words[lang, s] for s in sources), Counter())

        def share(c, kept=kept):
            total = sum(c[w] for w in kept) + len(kept)
            return {w: 1 + 10**9 * (c[w] + 1) // total for w in kept}

        p, q = {s: share(words[lang, s]) for s in sources}, share(every)
        for a in sources:
            for b in sources:
                if a != b:
                    pairs[lang, a, b] = sum((p[a][w] - p[b][w]) ** 2 // p[b][w] for w in kept)
            terms |= {(lang, a, w): (p[a][w] - q[w]) ** 2 // q[w] for w in kept if words[lang, a][w] and p[a][w] > q[w]}
    return pairs, terms


def _found(frames):
    return tuple({(r["lang"], r["source"], r["item"]): r["value"] for r in df.collect()} for df in frames)


ODD = [(None, None, None), ("", "", ""), (None, "en", "a"), ("x x x", "xx", None), ("One one, ONE-one", "en", "a"), ("1 2 3 \x00\x7f", "en", "b"), ("Äpfel ÄPFEL äpfel k K", "en", None)]


def test_audit_by_definition(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = ["alpha", "Beta", "GAMMA", "Straße", "éa", "漢字", "x", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = ODD + [(rng.choice([" ", ", ", "\n", "1"]).join(rng.choices(vocabulary, k=rng.randrange(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "ü", None])) for _ in range(120)]
    rows += [(" ".join(["hot"] * 20_000), "en", "a")] * 3 + rows[10:14]
    want = _audit(rows)
    assert _found(divergence.audit(_docs(spark, rows))) == want and len(want[1]) > 30
    monkeypatch.setattr(divergence, "COUNTS", 4)  # many blocks
    assert _found(divergence.audit(_docs(spark, rows))) == want


def test_audit_without_terms_or_rows(spark):
    rows = [("a b", "en", "s"), ("b c", "en", "t"), (None, "fr", "s")]
    assert _found(divergence.audit(_docs(spark, rows))) == ({("en", "s", "t"): 0, ("en", "t", "s"): 0}, {})
    assert [df.count() for df in divergence.audit(_docs(spark, []))] == [0, 0]


@given(st.lists(st.text(alphabet="aZ é漢1-", max_size=12), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_slices_are_the_matches(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    starts, ends, doc = divergence.slices(data, offsets)
    want = [(k, m) for k, t in enumerate(texts) for m in re.findall(rb"[A-Za-z\x80-\xff]+", t.encode())]
    assert [(int(d), data[a:b].tobytes()) for a, b, d in zip(starts, ends, doc)] == want


@pytest.mark.parametrize("digest", [None, len, lambda b: 7, lambda b: b[0]])
def test_terms_whose_hashes_collide_are_told_apart(digest, monkeypatch):
    monkeypatch.setattr(divergence, "COMPARED", 9)
    words = [bytes(random.Random(k % 17).choices(b"abcd", k=k % 5 + 1)) for k in range(200)]
    low = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    term, terms = divergence.grouped(low, starts, ends, digest)
    assert [terms[t] for t in term] == words and len(set(terms)) == len(terms)


def test_pair_sums_by_definition():
    rng = np.random.default_rng(5)
    for sources, terms in ((1, 3), (2, 1), (5, 40), (9, 7)):
        dense = rng.integers(0, 1 << 30, (sources, terms)) * (rng.random((sources, terms)) < 0.4)
        dense[0, :] = np.maximum(dense[0, :], 1)
        p0 = rng.integers(1, 1 << 20, sources)
        full = np.where(dense > 0, dense, p0[:, None])
        s, t = np.nonzero(dense)
        order = rng.permutation(len(s))
        got = divergence.pair_sums(s[order], t[order], dense[s, t][order], p0)
        assert got.tolist() == [[sum((int(a) - int(b)) ** 2 // int(b) for a, b in zip(x, y)) for y in full] for x in full]


def test_shares_beyond_64_bits(spark):
    n = 9 * 10**15
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(2 * n), F.lit(10**9)).alias("p")).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (2 * n + 10**9)


# manifest


def _tree(nodes, arity):
    """The root, and each node's siblings level by level, by definition."""
    paths = [[] for _ in nodes]
    level = [(h, [i]) for i, h in enumerate(nodes)]
    while len(level) > 1:
        above = []
        for k in range(0, len(level), arity):
            run = level[k : k + arity]
            for j, (_, below) in enumerate(run):
                for i in below:
                    paths[i].append((j, [h for m, (h, _) in enumerate(run) if m != j]))
            above.append((sha256("".join(h for h, _ in run).encode()).hexdigest(), [i for _, below in run for i in below]))
        level = above
    return level[0][0], paths


def _manifest(rows, arity):
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha256("".join(map(f, r)).encode()).hexdigest()
    key = lambda r: "" if r[1] is None else "s" + r[1]
    rows = sorted(rows, key=lambda r: (key(r).encode(), r[0] is not None, r[0] or 0, leaf(r)))
    sources = [list(g) for _, g in groupby(rows, key)]
    trees = [_tree([leaf(r) for r in g], arity) for g in sources]
    root, tops = _tree([t[0] for t in trees], arity)
    out = []
    for group, (subroot, paths), top in zip(sources, trees, tops):
        for r, path in zip(group, paths):
            path, x = [*path, *top], leaf(r)
            proof = sha256("".join(h for _, others in path for h in others).encode()).hexdigest()
            changed = (*r[:4], r[4] and re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))
            now = leaf(changed) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else x
            for j, others in path:
                now = sha256("".join([*others[:j], now, *others[j:]]).encode()).hexdigest()
            out.append((r[0], x, subroot, root, proof, now, now == root))
    return out


def _table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return df.select("*", *[F.lit("clash").alias(c) for c in (*CLASHING, "leaf", "pos", "items", "grp")]).repartition(4)


def _proved(docs, arity, levels, **more):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest.manifest(manifest.leaves(docs, {"text": lowered}, tampered), arity, levels, **more)


@pytest.mark.parametrize("arity,levels", [(2, 1), (3, 2), (16, 3)])
def test_manifest_by_definition(spark, arity, levels):
    rng = random.Random(arity)
    sizes = {None: 1, "": 2, "b": 27, "a": 28, "é": 9, "Z": 55, "z1": 3, "z2": 1}
    rows, i = [], -3
    for source, n in sizes.items():
        for _ in range(n):
            i += rng.randrange(1, 4)
            rows.append((i, source, rng.choice(["en", None]), rng.choice([5, None]), rng.choice([None, "", "Text É", "low", "ABC" * 20])))
    rng.shuffle(rows)
    got = _proved(_table(spark, rows), arity, levels, with_paths=True).collect()
    assert sorted(map(tuple, (r[:7] for r in got))) == sorted(_manifest(rows, arity))
    for r in got:  # a proof is enough to find the root
        path = [(x["place"], manifest.split(bytes(x["others"]))) for x in r["path"]]
        assert manifest.fold(bytes.fromhex(r["leaf"]), path).hex() == r["root"]
        assert sha256("".join(h.hex() for _, others in path for h in others).encode()).hexdigest() == r["proof_sha256"]
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("height,arity", [(1, 4), (2, 3), (3, 2), (3, 16)])
def test_traversal_by_definition(height, arity):
    for n in {1, 2, arity, arity + 1, arity**height - 1, arity**height, arity ** (height - 1) * 2 + 1} & set(range(1, arity**height + 1)):
        leaves = [sha256(bytes([k & 255, k >> 8])).digest() for k in range(n)]
        tall = manifest.height_of(n, arity)
        root, paths = _tree([x.hex() for x in leaves], arity)
        walk = manifest.Traversal(leaves, tall, arity)
        assert walk.root.hex() == root
        got = []
        for path in walk.paths():
            got.append([(j, [x.hex() for x in others]) for j, others in path])
            assert all(len(run) <= arity for run in walk.existing) and all(len(t) <= arity for d in walk.desired for t in d.tails)
        assert got == paths


def test_manifest_of_odd_rows(spark):
    long = "W" * 3_000_000
    rows = [(1, "a", "en", 3, "Abc")] * 40 + [(1, "a", "en", 3, "other"), (None, "a", None, None, None), (None, None, None, None, None), (2, "a", "en", 1, long)]
    got = [tuple(r) for r in _proved(_table(spark, rows), 16, 3).collect()]
    want = _manifest(rows, 16)
    key = lambda rows: Counter((r[0], r[1], r[2], r[3], r[6]) for r in rows)
    assert key(got) == key(want) and Counter(r[4] for r in got) == Counter(r[4] for r in want)
    assert _proved(_table(spark, []), 16, 3).count() == 0
    (one,) = _proved(_table(spark, [(4, None, None, None, None)]), 16, 3).collect()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == sha256(b"").hexdigest() and one["verified"]


# archives


def _pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.select("*", *[F.lit("clash").alias(c) for c in (*CLASHING, "payload", "record_id", "row")]).repartition(3)


def _keys(records):
    return records.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"))


def test_archive_round_trip_at_any_split(spark, tmp_path):
    rng = random.Random(3)
    body = lambda n: "".join(rng.choices("abc<>é漢\r\n ", k=n))
    copies = [body(400), body(99), body(101), "x" * 100]
    rows = [(k, rng.choice([f"http://h/{k}", "http://h/a b\r\nX: 1", None]), rng.choice([None, "", body(rng.randrange(300)), *copies])) for k in rng.sample(range(1000), 90)]
    rows += [(5000, "u", body(2_000_000)), (-7, "u", copies[0])]
    path = str(tmp_path / "w")
    warc.write_warc(warc.page_records(_pages(spark, rows)), path, level="1", fileBytes="3000")
    assert len(list((tmp_path / "w").glob("part-*.warc.gz"))) > 3
    first, want = {}, []
    for i, _, t in sorted(rows):
        data = (t or "").encode()
        of = first.setdefault(data, i) if len(data) >= 100 else i
        want.append((i, len(data), sha256(data).hexdigest(), "response" if of == i else "revisit", None if of == i else of))
    for split in ("700", "4096", "100000000"):
        records = warc.read_warc(spark, path, splitBytes=split)
        assert sorted(map(tuple, _keys(records).collect())) == want
    html = {i: (t or "").encode() for i, _, t in rows}
    for r in records.collect():
        i = int(re.search(r"-?\d+", r["record_id"])[0])
        assert bytes(r["payload"]) == (html[i] if r["record_type"] == "response" else b"") and r["target_uri"] in (None, "u", f"http://h/{i}", "http://h/a%20b%0D%0AX:%201")
    # any gzip reader reads the files
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows)


def test_archive_of_odd_rows(spark, tmp_path):
    same = "s" * 200
    rows = [(1, "u", same), (1, "u", same), (None, "v", same), (None, None, None), (2, None, ""), (2, None, "short"), (3, "u", "short")]
    path = str(tmp_path / "w")
    warc.write_warc(warc.page_records(_pages(spark, rows)), path)
    got = warc.read_warc(spark, path)
    want = [(1, 200, "response", None), (1, 200, "revisit", 1), (None, 200, "revisit", 1), (None, 0, "response", None), (2, 0, "response", None), (2, 5, "response", None), (3, 5, "response", None)]
    assert Counter((r[0], r[1], r[3], r[4]) for r in _keys(got).collect()) == Counter(want)
    assert got.select("record_id").distinct().count() == len(rows)
    warc.write_warc(warc.page_records(_pages(spark, [])), str(tmp_path / "empty"))
    assert warc.read_warc(spark, str(tmp_path / "empty")).count() == 0


def test_files_of_attempts_that_failed_are_not_read(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(warc.page_records(_pages(spark, [(1, "u", "a")])), path)
    (tmp_path / "w" / "part-half.warc.gz").write_bytes(b"\x1f\x8b\x08half")
    assert warc.read_warc(spark, path).count() == 1
    writer = warc.WarcWriter(path, 6, 1 << 30, warc.DATE, False)
    row = {"record_id": "urn:page:2", "record_type": "response", "target_uri": None, "refers_to": None, "payload_bytes": 1, "payload_digest": sha256(b"b").hexdigest(), "payload": b"b"}
    made = [writer.write(iter([pa.RecordBatch.from_pylist([row])])) for _ in range(2)]  # the same task, twice
    writer.commit([made[1]])
    assert warc.read_warc(spark, path).count() == 2
    writer.abort([made[0]])
    assert warc.read_warc(spark, path).count() == 2


def _member(kind, payload, level=6, **fields):
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + payload
    named = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{zlib.crc32(payload)}>\r\n{named}Content-Type: application/http;\r\n msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\na\r\n\r\n\r\n"
    good = _member("response", b"one", WARC_Payload_Digest="sha1:" + b32encode(sha1(b"one").digest()).decode())
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(good + _member("request", b"two")) + b"\0" * 5 + gzip.compress(_member("response", b"three")))
    for split in ("10", "1000000"):
        got = warc.read_warc(spark, str(tmp_path / "a.warc.gz"), splitBytes=split).collect()
        assert sorted((r["record_type"], bytes(r["payload"])) for r in got) == [("request", b"two"), ("response", b"one"), ("response", b"three"), ("warcinfo", b"a\r\n")]
        assert {r["payload_digest"] for r in got if r["record_type"] != "response" or bytes(r["payload"]) != b"one"} == {sha256(x).hexdigest() for x in (b"two", b"three", b"a\r\n")}


def test_an_archive_within_a_record_is_not_read(spark, tmp_path):
    inner = b"".join(warc.member(_member("response", b"inner %d" % k * 20), 6) for k in range(40))
    outer = [_member("response", b"before"), _member("response", inner), _member("response", b"after")]
    with open(tmp_path / "a.warc.gz", "wb") as f:
        for data in outer:
            f.write(warc.member(data, 0))  # not compressed: the inner members' bytes stand in the file
    for split in ("300", "100000000"):
        found = warc.read_warc(spark, str(tmp_path / "a.warc.gz"), splitBytes=split)
        found = warc.materialize(found.drop("headers"), "found")
        assert sorted(bytes(r["payload"])[:6] for r in warc.outer(found).collect()) == sorted([b"before", inner[:6], b"after"])
        assert (found.count() > 3) == (split == "300")


@pytest.mark.parametrize("harm", ["flip", "cut", "digest"])
def test_damaged_records(spark, tmp_path, harm):
    members = [gzip.compress(_member("response", b"payload %d " % k * 30, WARC_Payload_Digest="sha256:" + sha256(b"payload %d " % (k if harm != "digest" or k != 3 else 9) * 30).hexdigest())) for k in range(8)]
    if harm == "flip":
        members[3] = members[3][:-6] + bytes([members[3][-6] ^ 1]) + members[3][-5:]
    elif harm == "cut":
        members[3] = members[3][:-20]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    with pytest.raises(Exception, match="at byte"):
        warc.read_warc(spark, str(tmp_path)).count()
    for split in ("150", "1000000"):
        got = warc.read_warc(spark, str(tmp_path), splitBytes=split, onError="skip").collect()
        assert sorted(bytes(r["payload"])[:9] for r in got) == [b"payload %d" % k for k in range(8) if k != 3]


def test_magic_in_payloads_is_no_member(spark, tmp_path):
    rng = random.Random(4)
    payloads = [b"\x1f\x8b\x08" * 50 + rng.randbytes(500) + gzip.compress(b"WARC/1.1 not") + b"\x1f\x8b" for _ in range(10)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.member(_member("response", p), 0) for p in payloads))
    for split in ("64", "5000"):
        got = warc.read_warc(spark, str(tmp_path), splitBytes=split).collect()
        assert sorted(bytes(r["payload"]) for r in got) == sorted(payloads)
