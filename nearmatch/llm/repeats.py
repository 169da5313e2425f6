"""What suffix-array dedup and substring dedup share: finding where to look for repeated windows.

A window is ``length`` units (bytes or words) of one document. The anchor of a
window is the run of ``gram`` units in it with the smallest hash, the last of
equals: equal windows have equal anchors at equal places, so only windows whose
anchor's hash occurs twice can be repeated. The windows of one anchor are
consecutive; their span is the text that they cover, and it contains no other
whole window. Spans stream by anchor hash into pieces of bounded size, where
the operator decides by comparing units; a window can only equal windows of its
own anchor.

Equal documents are one class, and only one text of it gives spans, with the
number of its documents as their weight: a class of any size costs what one
document costs. Likewise the spans of an anchor with over ``HOT`` of them:
equal ones are combined, first within each batch, then by aggregation, to
weighted kinds, which go to the pieces in place of the spans; their marks come
back to the places. Where over ``HOT`` kinds remain, their key is made longer:
of a window's units besides the anchor at least half stand on one side of it,
so the windows part into those that have that many after it and those that
have them before it, and these units join the key. That repeats until no key
has too many kinds; a key as long as a window has one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmatch.llm.common import lookup, materialize

#: Spans, or kinds of spans, of one anchor that go to one piece.
HOT = 2000
#: Bytes of spans in a piece.
PIECE = 1 << 19
#: Units that the anchors are computed for at once, and bytes of an Arrow batch of spans.
BLOCK = 1 << 17
#: Bytes that a batch's kinds hold before they are passed on, and about those of a place.
KINDS = 16 << 20
PLACE = 256
#: Marks that are gathered by class before they are passed on.
PLACED = 50_000
#: Stands for a null doc_id: after all others.
LAST = (1 << 63) - 1
#: For the smallest id, of operators that don't ask for it.
ANYWHERE = -(1 << 63)

_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Units:
    """How texts become units: split gives the bytes that identify a text (joined units), and each unit's 64-bit value."""

    length: int
    gram: int
    split: Callable[[str | None], tuple[bytes, np.ndarray]]
    #: The bytes of units a to b (exclusive) of a text.
    cut: Callable[[bytes, list, int, int], bytes]
    #: What cut needs besides the bytes, once per text.
    places: Callable[[bytes], list]
    #: Number of units of some bytes.
    count: Callable[[bytes], int]


def rolling(values: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of gram values, by doubling."""
    have, out, done, factor = values, None, 0, _ODD
    width = 1
    with np.errstate(over="ignore"):
        while True:
            if gram & width:
                if out is None:
                    out, done = have, width
                else:  # the runs of width values, then those found so far
                    n = len(values) - done - width + 1
                    out = have[:n] * np.uint64(pow(int(_ODD), done, 1 << 64)) + out[width : width + n]
                    done += width
            width *= 2
            if width > gram:
                break
            have = have[: len(have) - width // 2] * factor + have[width // 2 :]
            factor = factor * factor
        out = out ^ (out >> np.uint64(32))
        out = out * np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(values: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated texts of the given sizes: text number, anchor hash and first window of each anchor, in order."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(values) < length:
        return none
    h = rolling(values, gram)
    low = np.uint64(0xFFFFFFFF)
    keyed = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    least = sliding_min(keyed, length - gram + 1)
    begins = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), windows)
    if not len(text):
        return none
    first = np.cumsum(windows) - windows
    start = np.arange(len(text)) - first[text] + begins[text]
    at = (low - (least[start] & low)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    text = text[new]
    return text, h[at[new]], start[new] - begins[text]


def profile(docs: DataFrame, units: Units) -> DataFrame:
    """doc_id, sha, n (units), joined (SHA-256 of the joined units), hs and los (hash and first window of each anchor) of docs(doc_id, sha, text)."""

    def emit(ids: list, shas: list, joined: list, arrays: list) -> pa.RecordBatch:
        sizes = np.array([len(a) for a in arrays], np.int64)
        text, h, lo = anchors(np.concatenate(arrays), sizes, units.length, units.gram)
        offsets = pa.array(np.searchsorted(text, np.arange(len(ids) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h.view(np.int64), lo.astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas, pa.binary()), pa.array(sizes), pa.array(joined, pa.binary()), *lists], names=["doc_id", "sha", "n", "joined", "hs", "los"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, shas, joined, arrays, held = [], [], [], [], 0
            for row in range(b.num_rows):
                whole, values = units.split(b.column(2)[row].as_py())
                ids.append(b.column(0)[row].as_py())
                shas.append(b.column(1)[row].as_py())
                joined.append(sha256(whole).digest())
                arrays.append(values)
                held += len(values)
                if held >= BLOCK:
                    yield emit(ids, shas, joined, arrays)
                    ids, shas, joined, arrays, held = [], [], [], [], 0
            if ids:
                yield emit(ids, shas, joined, arrays)

    return docs.select("doc_id", "sha", "text").mapInArrow(run, "doc_id long, sha binary, n long, joined binary, hs array<long>, los array<int>")


@dataclass
class Spans:
    """Parts of texts, or several equal parts of one key. All of a key stand together."""

    key: np.ndarray  # a number for each different key, from 0
    weight: np.ndarray  # documents that a span stands for
    did: np.ndarray  # the smallest of their ids
    content: list[bytes]

    def kinds(self) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Equal spans of a key as one kind: kind of each span, and key, content and weight of each kind."""
        numbers: dict[tuple[int, bytes], int] = {}
        kind = np.array([numbers.setdefault(x, len(numbers)) for x in zip(self.key.tolist(), self.content)], np.int64)
        return kind, np.array([x[0] for x in numbers], np.int64), [x[1] for x in numbers], np.bincount(kind, self.weight).astype(np.int64)


def of_kinds(kind: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the marked kinds, and for each the place in marked that it is there for."""
    order = np.argsort(kind, kind="stable")
    n = np.bincount(kind)
    first = np.cumsum(n) - n
    times = n[marked]
    which = np.repeat(np.arange(len(marked)), times)
    within = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    return order[first[marked[which]] + within], which


#: Gets whole keys' spans. Gives arrays: span number, first and last repeated window, and the smallest id of the documents that have them.
Decide = Callable[[Spans], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
NONE = (np.zeros(0, np.int64),) * 4


@dataclass
class Found:
    rows: DataFrame  # doc_id, sha
    classes: DataFrame  # cid, sha, rep (smallest id), n_docs, n, joined
    texts: DataFrame  # cid, did, text of a document of each class with repeated anchors
    marks: DataFrame  # cid, marks (lo, hi, own): first and last of consecutive repeated windows; own: no document before rep has them


def settle(spans: DataFrame, ref: list[str], kinds: str, decide: Decide) -> DataFrame:
    """ref, a, b, least: repeated windows of spans(key, weight, did, content, ref...). kinds: the types of ref."""

    def batch(whole: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
        key = np.zeros(whole.num_rows, np.int64)
        key[new] = 1
        at, a, b, least = decide(Spans(np.cumsum(key), whole.column(1).to_numpy(), whole.column(2).to_numpy(), whole.column(3).to_pylist()))
        refs = whole.select(ref).take(pa.array(at))
        return pa.RecordBatch.from_arrays([*refs.columns, *map(pa.array, (a, b, least))], names=[*ref, "a", "b", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += pc.sum(pc.binary_length(b.column(3))).as_py()
            if size > PIECE:  # all but the last key, which may go on
                whole = pa.concat_batches(held)
                new = _changes(whole.column(0))
                if len(new):
                    cut = int(new[-1])
                    yield batch(whole.slice(0, cut), new[:-1])
                    whole = whole.slice(cut)
                    size = pc.sum(pc.binary_length(whole.column(3))).as_py()
                held = [whole]
        if held:
            whole = pa.concat_batches(held)
            yield batch(whole, _changes(whole.column(0)))

    dealt = spans.select("key", "weight", "did", "content", *ref).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, f"{kinds}, a long, b long, least long")


def _changes(keys: pa.Array) -> np.ndarray:
    """Places whose key is not that of the place before."""
    return np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)) + 1


def find(docs: DataFrame, units: Units, decide: Decide, hot: int = HOT) -> Found:
    """Marks of repeated windows of docs(doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), "text")
    rows = materialize(profile(docs, units), "anchors")
    did = F.coalesce("doc_id", F.lit(LAST))
    first = [F.first(c).alias(c) for c in ("n", "joined", "hs", "los")]  # equal texts have equal ones
    classes = rows.groupBy("sha").agg(F.min(did).alias("rep"), F.count(F.lit(1)).alias("n_docs"), *first)
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    some = classes.where(F.size("hs") > 0)
    counts = some.select("n_docs", F.explode("hs").alias("h")).groupBy("h").agg(F.sum("n_docs").alias("times"), F.count(F.lit(1)).alias("spans"))
    counts = materialize(counts.where("times > 1"), "counts")
    ends = F.expr(f"transform(los, (x, i) -> named_struct('h', hs[i], 'lo', x, 'hi', coalesce(try_element_at(los, i + 2) - 1, cast(n - {units.length} as int))))")
    placed = some.select("cid", F.explode(ends).alias("a")).select("cid", "a.h", "a.lo", "a.hi")
    repeated = lookup(placed, counts.drop("times"), "h", "spans", "cid").where("found IS NOT NULL")
    anchor = F.struct("h", "lo", "hi", (F.col("found.spans") > hot).alias("hot"))
    wanted = repeated.groupBy("cid").agg(F.collect_list(anchor).alias("spans"))
    wanted = wanted.join(classes.select("cid", "sha", F.col("rep").alias("did"), F.col("n_docs").alias("weight")), "cid")
    own = docs.select("sha", did.alias("did"), "text").join(wanted, ["sha", "did"]).dropDuplicates(["sha", "did"])
    texts = materialize(own.select("cid", "did", "weight", "text", "spans", F.exists("spans", lambda x: x["hot"]).alias("any_hot")), "candidates")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            n = [len(x[3]) for x in out]
            columns = [np.concatenate([x[4] for x in out]), *(np.repeat([x[k] for x in out], n) for k in (1, 2)), [c for x in out for c in x[3]], np.repeat([x[0] for x in out], n), np.concatenate([x[5] for x in out])]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "weight", "did", "content", "cid", "lo"])

        for b in batches:
            for cid, did, weight, text, h, lo, hi, hot in _with_lists(b):
                cold = ~hot
                if not cold.any():
                    continue
                whole, _ = units.split(text)
                places = units.places(whole)
                contents = [units.cut(whole, places, x, y) for x, y in zip(lo[cold].tolist(), (hi[cold] + units.length).tolist())]
                out.append((cid, weight, did, contents, h[cold], lo[cold].astype(np.int64)))
                held += sum(map(len, contents))
                if held > BLOCK:
                    yield batch()
                    out, held = [], 0
        if out:
            yield batch()

    spans = texts.select("cid", "did", "weight", "text", "spans").mapInArrow(emit, "key long, weight long, did long, content binary, cid long, lo long")
    spans = spans.withColumn("own_did", F.col("did"))
    marks = settle(spans, ["cid", "lo", "own_did"], "cid long, lo long, own_did long", decide)
    mark = F.struct((F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b")).alias("hi"), (F.col("least") == F.col("own_did")).alias("own"))
    marks = marks.select("cid", F.array(mark).alias("marks"))
    if not texts.where("any_hot").isEmpty():
        marks = marks.unionByName(_hot_marks(texts.where("any_hot"), units, decide, hot))
    return Found(rows.select("doc_id", "sha"), classes.drop("hs", "los"), texts.select("cid", "did", "text"), materialize(marks, "marks"))


def _rows(b: pa.RecordBatch) -> Iterator[tuple]:
    """One row at a time as Python values: long texts don't all become strings at once."""
    for k in range(b.num_rows):
        yield tuple(c[k].as_py() for c in b.columns)


def _with_lists(b: pa.RecordBatch) -> Iterator[tuple]:
    """As _rows, with the fields of the last column, a list of structs, as numpy arrays."""
    lists = b.column(b.num_columns - 1)
    offsets = lists.offsets.to_numpy()
    fields = [x.to_numpy(zero_copy_only=False) for x in lists.values.flatten()]
    for k in range(b.num_rows):
        yield *(b.column(c)[k].as_py() for c in range(b.num_columns - 1)), *(x[offsets[k] : offsets[k + 1]] for x in fields)


class _Kinds:
    """Equal parts of one key within a batch, with their places."""

    TYPES = "batch long, key binary, c binary, p int, q int, content binary, weight long, did long, places array<struct<cid:long,did:long,weight:long,lo:long>>"

    def __init__(self) -> None:
        self.places: dict[tuple[bytes, int, int, bytes], list[dict]] = {}
        self.held = 0

    def add(self, key: bytes, p: int, q: int, content: bytes, places: list[dict]) -> None:
        at = self.places.setdefault((key, p, q, content), [])
        if not at:
            self.held += len(content)
        at += places
        self.held += PLACE * len(places)

    def batch(self) -> pa.RecordBatch:
        from xxhash import xxh3_128_digest

        place = pa.struct([(c, pa.int64()) for c in ("cid", "did", "weight", "lo")])
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(place))
        number = next(iter(self.places.values()))[0]["cid"]
        rows = [(number, key, xxh3_128_digest(b"%b %d %d %b" % (key, p, q, content)), p, q, content, sum(x["weight"] for x in at), min(x["did"] for x in at), at) for (key, p, q, content), at in self.places.items()]
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["batch", "key", "c", "p", "q", "content", "weight", "did", "places"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cid, marks from places of kinds and the kinds' marks (a, b, least): one row for each class that some rows in a row have."""
    mark = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("own", pa.bool_())]))
    found: dict[int, list[dict]] = {}
    held = 0
    for batch in batches:
        for places, marks in _rows(batch):
            for s in places:
                found.setdefault(s["cid"], []).extend({"lo": s["lo"] + m["a"], "hi": s["lo"] + m["b"], "own": m["least"] == s["did"]} for m in marks)
            held += len(places) * len(marks)
            if held > PLACED:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), mark)], names=["cid", "marks"])
                found, held = {}, 0
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), mark)], names=["cid", "marks"])


def halves(n: int, p: int, q: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Parts (first unit, end, first and end of the units that all its windows share) of n units whose windows share units p to q."""
    extra = length - (q - p)
    half = (extra + 1) // 2
    turn = q + half - length  # the first window that has half of the others after q
    if turn <= n - length:
        yield max(0, turn), n, p, q + half
    if turn > 0:
        yield 0, min(n, turn - 1 + length), p - (extra - half + 1), q


def _hot_marks(texts: DataFrame, units: Units, decide: Decide, hot: int) -> DataFrame:
    """Marks of the spans of hot anchors."""
    from xxhash import xxh3_128_digest

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _Kinds()
        for b in batches:
            for cid, did, weight, text, h, lo, hi, is_hot in _with_lists(b):
                whole, values = units.split(text)
                places = units.places(whole)
                hashes = rolling(values, units.gram).view(np.int64)
                for k in np.flatnonzero(is_hot).tolist():
                    first = int(lo[k])
                    p = int(np.flatnonzero(hashes[first : first + units.length - units.gram + 1] == h[k])[-1])
                    content = units.cut(whole, places, first, int(hi[k]) + units.length)
                    kinds.add(h[k].tobytes(), p, p + units.gram, content, [{"cid": cid, "did": did, "weight": weight, "lo": first}])
                if kinds.held > KINDS:
                    yield kinds.batch()
        if kinds.held:
            yield kinds.batch()

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _Kinds()
        for b in batches:
            for key, p, q, content, places in _rows(b):
                at = units.places(content)
                for first, end, x, y in halves(units.count(content), p, q, units.length):
                    new = xxh3_128_digest(b"%b %d %b" % (key, x < p, units.cut(content, at, x, y)))
                    kinds.add(new, x - first, y - first, units.cut(content, at, first, end), [{**s, "lo": s["lo"] + first} for s in places])
                if kinds.held > KINDS:
                    yield kinds.batch()
        if kinds.held:
            yield kinds.batch()

    done = []
    parts = materialize(texts.select("cid", "did", "weight", "text", "spans").mapInArrow(spans, _Kinds.TYPES), "hot-spans")
    while True:
        kinds = parts.groupBy("key", "c", "p", "q", "content").agg(F.sum("weight").alias("weight"), F.min("did").alias("did"), F.sum(F.size("places")).alias("places"))
        kinds = materialize(kinds, "kinds")
        keys = materialize(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("weight").alias("times")).where("times > 1"), "keys")
        ready = lookup(kinds, keys, "key", "kinds", "c").where(F.col("found.kinds") <= hot)
        found = settle(ready, ["c", "places"], "c binary, places long", decide)
        entries = found.groupBy("c").agg(F.first("places").alias("n"), F.collect_list(F.struct("a", "b", "least")).alias("marks"))
        entries = materialize(entries, "kind-marks")
        placed = lookup(parts.select("batch", "c", "places"), entries, "c", "n", "batch").where("found IS NOT NULL")
        done.append(placed.select("places", "found.marks").mapInArrow(_placed, "cid long, marks array<struct<lo:long,hi:long,own:boolean>>"))
        full = keys.where(F.col("kinds") > hot)
        if full.isEmpty():
            break
        more = lookup(parts.select("key", "c", "p", "q", "content", "places"), full, "key", "kinds", "c").where("found IS NOT NULL")
        parts = materialize(more.select("key", "p", "q", "content", "places").mapInArrow(longer, _Kinds.TYPES), "longer")
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def removed_units(n: int, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """Which of n units the windows lo to hi of each mark cover."""
    change = np.bincount(lo, minlength=n + 1) - np.bincount(np.minimum(n, hi + length), minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


def removal(found: Found, units: Units, keep: Callable[[bytes, list, np.ndarray], bytes]) -> DataFrame:
    """Of the classes with marks: cid, and of its first documents and of its copies n_removed, n_spans, kept_sha. keep gives the kept bytes of a text."""
    marked = found.marks.groupBy("cid").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    joined = found.texts.select("cid", "text").join(marked, "cid").select("cid", "text", "marks")
    result = pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha", pa.binary())])

    def outcome(whole: bytes, places: list, n: int, lo: np.ndarray, hi: np.ndarray) -> dict:
        gone = removed_units(n, lo, hi, units.length)
        n_spans = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(np.int8)]) == 1))
        return {"n_removed": int(gone.sum()), "n_spans": n_spans, "kept_sha": sha256(keep(whole, places, gone)).digest()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cids, firsts, copies = [], [], []
            for cid, text, lo, hi, own in _with_lists(b):
                whole, values = units.split(text)
                places = units.places(whole)
                cids.append(cid)
                firsts.append(outcome(whole, places, len(values), lo[~own], hi[~own]))
                copies.append(outcome(whole, places, len(values), lo, hi) if own.any() else firsts[-1])
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(firsts, result), pa.array(copies, result)], names=["cid", "first", "copy"])

    kind = "struct<n_removed:long,n_spans:long,kept_sha:binary>"
    return joined.mapInArrow(run, f"cid long, first {kind}, copy {kind}")


def results(found: Found, gone: DataFrame, earlier: bool) -> DataFrame:
    """doc_id, n, n_removed, n_spans, kept_sha256 of each row. earlier: only what a document of a smaller id has too is removed."""
    entries = found.classes.join(gone, "cid", "left").drop("cid")
    rows = lookup(found.rows.withColumn("did", F.coalesce("doc_id", F.lit(LAST))), entries, "sha", "n_docs", "did")
    out = F.when(F.col("did") == F.col("found.rep"), F.col("found.first")).otherwise(F.col("found.copy")) if earlier else F.col("found.copy")
    rows = rows.select("doc_id", F.col("found.n").alias("n"), F.col("found.joined").alias("joined"), out.alias("out"))
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", "n", F.coalesce("out.n_removed", zero).alias("n_removed"), F.coalesce("out.n_spans", zero).alias("n_spans"), F.lower(F.hex(F.coalesce("out.kept_sha", "joined"))).alias("kept_sha256"))
