"""The Hamming-range self-join over (video_id, hash), match counts and edges.

Equal hashes of a video are one row with a multiplicity; counts multiply, so
they are those of hash pairs. ``banded`` is the scalable way: the 63 bits are
cut into bands, each with a number of bits that may differ in it, such that two
hashes within the radius come together in a band; one of them is entered under
all values that near. The more hashes there are, the fewer and wider bands are
taken (``plan_bands``), so that few hashes share a value by chance. A pair counts
only in the first band that brings it together, so nothing has to be
de-duplicated afterwards. Where many hashes share each value, tiles of the hashes whose values begin alike
are joined in place of single ones. For radii whose bands select nothing, ``brute``
compares all pairs by a broadcast, over few hashes, and ``tiled`` by numpy over
tiles of them, over many. Pairs of tiles are dealt out one by one, whatever
their size, and where only counts are wanted (``hamming_matches``), a task counts what it finds.

A search wants groups, not all pairs. ``linked_classes`` gives links with the
same components, and its work on a hash that many videos share grows with their
number, not with its square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearmatch.functions.hashing import BITS, h63, hamming, usable
from nearmatch.settings import SearchParams
from nearmatch.sources.shared import materialize
from nearmatch.sources.store import with_ids

#: Narrower bands select too little.
NARROWEST = 6
#: Hashes up to which one side is broadcast, 16 bytes each, and one task may make all comparisons.
BROADCAST_ROWS = 8192
#: Hashes of a tile, 24 bytes each: fewer while that makes under TILES of them, but not under LEAST_TILE. Pairs that numpy compares at once.
TILE = 1 << 17
LEAST_TILE = 1 << 13
TILES = 64
PAIRS = 1 << 18
#: Tasks that pairs of tiles are dealt out to at most. Rows that a task gives at once, and pairs of videos that it has a counter for.
MOST_TASKS = 20_000
ROWS = 1 << 16
COUNTERS = 1 << 20


#: What a candidate costs that a join makes and checks, against a row that is entered in a band, sent and sorted.
CANDIDATE = 0.05
#: Rows that a hash is entered as at most.
MOST_ROWS = 2000
#: Candidates by chance for each hash beyond which tiles are joined on bands. Tiles that a band is cut into: 2 to this power, or fewer.
MOST_CANDIDATES = 1000
PREFIX = 5
#: Nanoseconds of a comparison in a tile, of a hash that is looked up, and of a value that is.
COMPARED, LOOKED_UP, A_VALUE = 1.0, 5.0, 30_000.0


@dataclass(frozen=True)
class Band:
    """Bits of the 63 from shift on, of which so many may differ."""

    shift: int
    width: int
    differ: int

    @property
    def probes(self) -> int:
        return sum(comb(self.width, k) for k in range(self.differ + 1))

    def masks(self) -> list[int]:
        return [sum(1 << bit for bit in bits) for k in range(self.differ + 1) for bits in combinations(range(self.width), k)]


def bands(radius: int, n: int | None = None) -> list[Band]:
    """n bands, radius + 1 if no number is given. What may differ in them, and 1 for each, add up to radius + 1: if more differs in every band, hashes are further apart than the radius."""
    n = min(n or radius + 1, radius + 1, BITS)
    cuts = [BITS * k // n for k in range(n + 1)]
    spare, more = divmod(radius + 1, n)
    return [Band(a, b - a, max(0, spare + (k < more) - 1)) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def plan_bands(radius: int, hashes: int) -> list[Band]:
    """The bands that cost least for a number of hashes: rows that they are entered as, and candidates that share a value by chance."""

    def cost(plan: list[Band]) -> float:
        return sum(b.probes + 1 + CANDIDATE * hashes * b.probes / 2.0**b.width for b in plan)

    plans = [bands(radius, n) for n in range(1, min(radius + 1, BITS) + 1)]
    return min((p for p in plans if sum(b.probes for b in p) <= MOST_ROWS), key=cost)


def weighted(hashes: DataFrame) -> DataFrame:
    """video_id, h, m: each usable hash of a video once, and how often it has it; rows may have an m of their own."""
    times = F.sum("m") if "m" in hashes.columns else F.count(F.lit(1))
    return hashes.where(usable(F.col("h"))).groupBy("video_id", "h").agg(times.alias("m"))


def _sides(hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(hashes.select(*[F.col(c).alias(f"{s}_{c}") for c in hashes.columns]) for s in ("a", "b"))  # type: ignore[return-value]


def hamming_pairs_brute(hashes: DataFrame, radius: int) -> DataFrame:
    """a_video_id, a_h, a_m, b_...: pairs of hashes within the radius, of different videos, once each. One side is broadcast if it is small; else they are compared in tiles."""
    w = materialize(weighted(hashes), "weighted")
    if w.count() > BROADCAST_ROWS:
        return hamming_pairs_tiled(w, radius)
    a, b = _sides(w)
    b = F.broadcast(b)
    return a.join(b, (F.col("a_video_id") < F.col("b_video_id")) & (hamming(F.col("a_h"), F.col("b_h")) <= radius))


def hamming_pairs_banded(hashes: DataFrame, radius: int, plan: list[Band] | None = None, others: DataFrame | None = None) -> DataFrame:
    """The same pairs by an equi-join on bands. Bit 0, which packed hashes don't use, is checked with all others. With others, pairs of a hash here and one there.

    Where bands bring each hash together with over MOST_CANDIDATES by chance, they are joined as tiles.
    """
    if plan is None and others is None:
        hashes = materialize(weighted(hashes), "weighted")
        if _crowded(radius, hashes.count()):
            return _pairs_of(_banded(hashes, radius), hashes)
    plan = plan or plan_bands(radius, (hashes if others is None else others).count())

    def value(x: Column, band: Band) -> Column:
        return F.shiftrightunsigned(h63(x), band.shift).bitwiseAND(F.lit((1 << band.width) - 1))

    def values(k: int, band: Band, probes: bool) -> Column:
        near = F.array(*map(F.lit, band.masks() if probes else [0])).cast("array<bigint>")
        return F.transform(near, lambda m: F.struct(F.lit(k).alias("k"), value(F.col("h"), band).bitwiseXOR(m).alias("v")))

    def entered(side: str, probes: bool) -> DataFrame:
        rows = rows_of[side].withColumn("band", F.explode(F.concat(*[values(k, band, probes) for k, band in enumerate(plan)])))
        return rows.select(*[F.col(c).alias(f"{side}_{c}") for c in ("video_id", "h", "m")], F.col("band.k").alias(f"{side}_k"), F.col("band.v").alias(f"{side}_v"))

    rows_of = {"a": weighted(hashes), "b": weighted(hashes if others is None else others)}
    a, b = entered("a", True), entered("b", False)
    apart = F.col("a_video_id") < F.col("b_video_id") if others is None else F.col("a_video_id") != F.col("b_video_id")
    x = F.col("a_h").bitwiseXOR(F.col("b_h"))
    first = F.coalesce(*[F.when(F.bit_count(value(x, p)) <= p.differ, F.lit(k)) for k, p in enumerate(plan)])
    joined = a.join(b, (F.col("a_k") == F.col("b_k")) & (F.col("a_v") == F.col("b_v")) & apart & (F.bit_count(x) <= radius) & (first == F.col("a_k")))
    return joined.select("a_video_id", "a_h", "a_m", "b_video_id", "b_h", "b_m")


def _crowded(radius: int, hashes: int) -> bool:
    """Whether bands bring too many hashes together by chance for a join of single rows."""
    return sum(hashes * b.probes / 2.0**b.width for b in plan_bands(radius, hashes)) > MOST_CANDIDATES


@dataclass(frozen=True)
class Found:
    """Pairs of tiles that may hold pairs of hashes, dealt out over tasks, and what compares two of them: places in both of pairs within the radius, a block at a time."""

    work: DataFrame
    compare: Callable[[dict[str, Any], np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


PAYLOAD = ("video_id", "h", "m")


def _packed(keys: list[str], most: int | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """One row for each run of equal keys in a partition, or several of about that many hashes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        of, n = None, 0

        def tile() -> pd.DataFrame:
            pdf = pd.concat(held)
            ones = np.bitwise_count(pdf["h"].to_numpy(np.int64).view(np.uint64))
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "low": [int(ones.min())], "high": [int(ones.max())], **{c: [pdf[c].to_numpy(np.int64).tobytes()] for c in PAYLOAD}})

        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=True):
                if held and (of != key or most and n >= most):
                    yield tile()
                    held, n = [], 0
                held.append(part)
                of, n = key, n + len(part)
        if held:
            yield tile()

    return pack


class Outer:
    """Places of all pairs within the radius, of up to PAIRS. They are few, so that eight comparisons are looked at in one word; memory is taken once."""

    def __init__(self, radius: int) -> None:
        self.radius = radius
        self.apart, self.ones, self.hit = (np.empty(PAIRS, kind) for kind in (np.uint64, np.uint8, bool))

    def __call__(self, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(one) * len(other)
        apart, ones, hit = self.apart[:n], self.ones[:n], self.hit[:n]
        np.bitwise_xor(one[:, None], other[None, :], out=apart.reshape(len(one), len(other)))
        np.less_equal(np.bitwise_count(apart, out=ones), self.radius, out=hit)
        whole = n & ~7
        words = np.flatnonzero(hit[:whole].view(np.uint64))
        some = np.flatnonzero(hit[:whole].reshape(-1, 8)[words].ravel())
        at = np.concatenate([words[some >> 3] * 8 + (some & 7), np.flatnonzero(hit[whole:]) + whole])
        i = at // len(other)
        return i, at - i * len(other)


def _tiled(rows: DataFrame, radius: int, tile: int | None = None) -> Found:
    """All pairs, of weighted rows. Hashes stand in the order of their numbers of ones, so that tiles, and within them blocks, whose numbers lie further apart than the radius are skipped."""
    tile = tile or min(TILE, max(LEAST_TILE, rows.count() // TILES))
    placed = with_ids(rows, -1, F.bit_count("h"), "h", "video_id", name="place").withColumn("tile", F.floor(F.col("place") / tile))
    dealt = placed.select("tile", F.col("video_id").cast("long").alias("video_id"), "h", "m").repartition("tile").sortWithinPartitions("tile", F.bit_count("h"))
    tiles = materialize(dealt.mapInPandas(_packed(["tile"]), "tile long, low int, high int, video_id binary, h binary, m binary"), "tiles")
    a, b = (tiles.select(*[F.col(c).alias(f"{s}_{c}") for c in ("tile", "low", "high")]) for s in "ab")
    # later tiles have no fewer ones; those that are near enough are looked up by ranges of ones
    spread = radius + 1
    a = a.withColumn("a_near", F.explode(F.sequence(F.floor(F.col("a_low") / spread), F.floor((F.col("a_high") + radius) / spread))))
    b = b.withColumn("b_near", F.floor(F.col("b_low") / spread))
    near = a.join(b, (F.col("a_near") == F.col("b_near")) & (F.col("a_tile") <= F.col("b_tile")) & (F.col("b_low") - F.col("a_high") <= radius)).select("a_tile", "b_tile")

    def compare(row: dict[str, Any], one: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        of_one, of_other = np.bitwise_count(one).astype(int), np.bitwise_count(other).astype(int)
        step, outer = 64, Outer(radius)
        for at in range(0, len(one), step):
            low, high = (int(k) for k in (np.searchsorted(of_other, of_one[at] - radius), np.searchsorted(of_other, of_one[min(at + step, len(one)) - 1] + radius, side="right")))
            for begin in range(low, high, PAIRS // step):
                i, j = outer(one[at : at + step], other[begin : min(high, begin + PAIRS // step)])
                yield i + at, j + begin

    return Found(_work(near, tiles), compare)


def _work(near: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pairs of tiles with what both hold. A pair is a task's work: they are dealt out by their number, not by their bytes."""
    near = materialize(near, "tile-pairs")
    tasks = max(1, min(near.count(), MOST_TASKS))
    for s in "ab":
        near = near.join(tiles.select(*[F.col(c).alias(f"{s}_{c}") for c in ("tile", *PAYLOAD)]), f"{s}_tile")
    return near.repartition(tasks)


def plan_tiles(radius: int, hashes: int) -> list[Band]:
    """The bands that cost least where tiles are joined on them: comparisons, and values and hashes that are looked up."""
    n = max(1, hashes)

    def cost(plan: list[Band]) -> float:
        values = sum(2.0**b.width * sum(comb(min(PREFIX, b.width), k) for k in range(b.differ + 1)) for b in plan)
        return sum(COMPARED * n * b.probes / 2.0**b.width + LOOKED_UP * b.probes for b in plan) + A_VALUE * values / n

    return min((p for p in (bands(radius, k) for k in range(1, min(radius + 1, BITS) + 1)) if max(b.probes for b in p) <= 1 << 16), key=cost)


def _banded(rows: DataFrame, radius: int, plan: list[Band] | None = None, prefix: int | None = None) -> Found:
    """Pairs by an equi-join of tiles on bands, of weighted rows.

    A tile holds hashes whose values in a band begin with the same bits. Tiles
    meet those whose beginnings are near enough; in two of them each value meets the hashes of all near
    values, and a pair counts in the first band that brings it together.
    """
    n = rows.count()
    plan = plan or plan_tiles(radius, n)
    tile = min(TILE, max(LEAST_TILE, n >> PREFIX))
    cut = max(0, (n // tile).bit_length() - 1) if prefix is None else prefix
    tops = [min(cut, b.width) for b in plan]

    def value(x: Column, band: Band) -> Column:
        return F.shiftrightunsigned(h63(x), band.shift).bitwiseAND(F.lit((1 << band.width) - 1))

    entered = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), value(F.col("h"), b).alias("v"), F.shiftrightunsigned(value(F.col("h"), b), b.width - t).alias("prefix")) for k, (b, t) in enumerate(zip(plan, tops))]))
    each = rows.select(F.col("video_id").cast("long").alias("video_id"), "h", F.col("m").cast("long").alias("m"), entered.alias("e")).select("e.*", "video_id", "h", "m")
    order = ("k", "v", "h", "video_id")
    ranged = each.repartitionByRange(max(4, n >> 20) * len(plan), *order).sortWithinPartitions(*order)
    packed = ranged.mapInPandas(_packed(["k", "prefix"], 2 * tile), "k int, prefix long, low int, high int, video_id binary, h binary, m binary")
    tiles = materialize(packed.withColumn("tile", F.monotonically_increasing_id()), "band-tiles")
    masks = [[x for x in range(1 << t) if x.bit_count() <= b.differ] for b, t in zip(plan, tops)]
    near = F.coalesce(*[F.when(F.col("k") == k, F.array(*map(F.lit, some)).cast("array<bigint>")) for k, some in enumerate(masks)])
    a = tiles.select("k", F.col("prefix").alias("a_prefix"), F.explode(F.transform(near, lambda x: F.col("prefix").bitwiseXOR(x))).alias("b_prefix"), F.col("tile").alias("a_tile"))
    b = tiles.select("k", F.col("prefix").alias("b_prefix"), F.col("tile").alias("b_tile"))

    def values(h: np.ndarray, k: int) -> np.ndarray:
        return (h >> np.uint64(1 + plan[k].shift)) & np.uint64((1 << plan[k].width) - 1)

    def compare(row: dict[str, Any], one: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        k, outer = row["k"], Outer(radius)
        bits, spare = plan[k].width - tops[k], plan[k].differ - (row["a_prefix"] ^ row["b_prefix"]).bit_count()
        x, y = ((values(h, k) & np.uint64((1 << bits) - 1)).astype(np.int64) for h in (one, other))
        all_of = np.arange(1 << bits, dtype=np.int64)
        differ = all_of[np.bitwise_count(all_of) <= spare]
        begins = np.searchsorted(y, np.arange((1 << bits) + 1))
        of, starts = np.unique(x, return_index=True)
        for v, low, high in zip(of.tolist(), starts.tolist(), [*starts.tolist()[1:], len(x)]):
            at = begins[v ^ differ]
            count = begins[(v ^ differ) + 1] - at
            ends = np.cumsum(count)
            if not ends[-1]:
                continue
            near = np.repeat(at - ends + count, count) + np.arange(ends[-1])
            step = max(1, PAIRS // (high - low))
            for begin in range(0, len(near), step):
                some = near[begin : begin + step]
                for top in range(low, high, PAIRS):
                    i, j = outer(one[top : min(high, top + PAIRS)], other[some])
                    i, j = i + top, some[j]
                    apart = one[i] ^ other[j]
                    first = np.ones(len(i), bool)
                    for earlier in range(k):
                        first &= np.bitwise_count(values(apart, earlier)) > plan[earlier].differ
                    yield i[first], j[first]

    pairs = a.join(b, ["k", "b_prefix"]).where("a_tile <= b_tile").select("k", "a_prefix", "b_prefix", "a_tile", "b_tile")
    return Found(_work(pairs, tiles), compare)


def _held(row: dict[str, Any]) -> list[dict[str, np.ndarray]]:
    return [{c: np.frombuffer(row[f"{s}_{c}"], np.int64) for c in PAYLOAD} for s in "ab"]


def _pairs_of(found: Found, hashes: DataFrame) -> DataFrame:
    """a_video_id, a_h, a_m, b_...: the pairs themselves, of different videos."""
    columns, compare = [f"{s}_{c}" for s in "ab" for c in PAYLOAD], found.compare

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (row for pdf in batches for row in pdf.to_dict("records")):
            x, y = _held(row)
            same, held, n = row["a_tile"] == row["b_tile"], [], 0

            def rows() -> pd.DataFrame:
                i, j = (np.concatenate(k) for k in zip(*held))
                ordered = x["video_id"][i] < y["video_id"][j]
                sides = [np.where(ordered, x[c][i], y[c][j]) for c in PAYLOAD] + [np.where(ordered, y[c][j], x[c][i]) for c in PAYLOAD]
                return pd.DataFrame(dict(zip(columns, sides)))

            for i, j in compare(row, x["h"].view(np.uint64), y["h"].view(np.uint64)):
                # of two tiles, pairs of either order; of one tile, each pair comes both ways round
                left, right = x["video_id"][i], y["video_id"][j]
                kept = left < right if same else left != right
                held.append((i[kept], j[kept]))
                n += len(held[-1][0])
                if n >= ROWS:
                    yield rows()
                    held, n = [], 0
            if n:
                yield rows()

    kind = hashes.schema["video_id"].dataType
    pairs = found.work.mapInPandas(run, ", ".join(f"{c} long" for c in columns))
    return pairs.select(*[F.col(c).cast(kind).alias(c) if c.endswith("video_id") else F.col(c) for c in columns])


def _counted(codes: list[np.ndarray], weights: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes under n that occur, and the sums of their weights, which are 1 if there are none."""
    code = np.concatenate(codes)
    if n <= COUNTERS and not weights:
        times = np.bincount(code, minlength=n)
        return (some := np.flatnonzero(times)), times[some]
    order = np.argsort(code, kind="stable")
    code = code[order]
    weight = np.concatenate(weights)[order] if weights else np.ones(len(code), np.int64)
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[starts], np.add.reduceat(weight, starts)


def _counts_of(found: Found, hashes: DataFrame) -> DataFrame:
    """src, dst, matches: what match_counts says of the pairs. Tasks add up what they find, so that what moves are videos' pairs and not hashes'."""
    compare = found.compare

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (row for pdf in batches for row in pdf.to_dict("records")):
            x, y = _held(row)
            same, once = row["a_tile"] == row["b_tile"], bool((x["m"] == 1).all() and (y["m"] == 1).all())
            (left, p), (right, q) = (np.unique(side["video_id"], return_inverse=True) for side in (x, y))
            codes, weights, n = [], [], 0
            p = p * len(right)

            def rows() -> pd.DataFrame:
                code, matches = _counted(codes, weights, len(left) * len(right))
                a, b = left[code // len(right)], right[code % len(right)]
                kept = a < b if same else a != b  # of one tile, each pair comes both ways round
                a, b = a[kept], b[kept]
                return pd.DataFrame({"src": np.minimum(a, b), "dst": np.maximum(a, b), "matches": matches[kept]})

            for i, j in compare(row, x["h"].view(np.uint64), y["h"].view(np.uint64)):
                codes.append(p[i] + q[j])
                if not once:
                    weights.append(x["m"][i] * y["m"][j])
                n += len(i)
                if n >= COUNTERS:
                    yield rows()
                    codes, weights, n = [], [], 0
            if n:
                yield rows()

    kind = hashes.schema["video_id"].dataType
    parts = found.work.mapInPandas(run, "src long, dst long, matches long")
    return parts.groupBy(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst")).agg(F.sum("matches").alias("matches"))


def hamming_pairs_tiled(hashes: DataFrame, radius: int, tile: int | None = None) -> DataFrame:
    """The same pairs by comparing tiles of hashes, which numpy does a hundred times as fast as a join's condition.

    The work grows with the square of
    the different hashes; it is for radii at which bands select nothing. A tile is as large as a task holds
    with ease, so that what moves, a tile for each other that it is compared with, stays small against the work.
    """
    rows = materialize(weighted(hashes), "weighted")
    return _pairs_of(_tiled(rows, radius, tile), hashes)


def hamming_pairs(hashes: DataFrame, radius: int, strategy: str = "auto") -> DataFrame:
    """Pairs within the radius. auto: by bands where they select enough; else all pairs, by a broadcast where that is small, by tiles beyond. All give the same rows."""
    if strategy == "auto":  # wider bands in which bits may differ are no better at such radii
        strategy = "banded" if BITS // (radius + 1) >= NARROWEST else "brute"
    return {"banded": hamming_pairs_banded, "brute": hamming_pairs_brute, "tiled": hamming_pairs_tiled}[strategy](hashes, radius)


def hamming_matches(hashes: DataFrame, radius: int, strategy: str = "auto") -> DataFrame:
    """match_counts of hamming_pairs. Where tiles are compared, their tasks count, and no pair of hashes leaves them."""
    if strategy == "auto":
        strategy = "banded" if BITS // (radius + 1) >= NARROWEST else "brute"
    rows = materialize(weighted(hashes), "weighted")
    n = rows.count()
    if strategy == "banded" and _crowded(radius, n):
        return _counts_of(_banded(rows, radius), rows)
    if strategy == "tiled" or strategy == "brute" and n > BROADCAST_ROWS:
        return _counts_of(_tiled(rows, radius), rows)
    return match_counts(hamming_pairs(rows, radius, strategy))


def hamming_pairs_across(hashes: DataFrame, others: DataFrame, radius: int) -> DataFrame:
    """Pairs within the radius of a hash here and one of others, of different videos. hashes are the fewer: they are probes of the bands, or, at radii whose bands select nothing, compared with all others."""
    if BITS // (radius + 1) >= NARROWEST:
        return hamming_pairs_banded(hashes, radius, others=others)
    a, _ = _sides(weighted(hashes))
    _, b = _sides(weighted(others))
    if a.count() <= BROADCAST_ROWS:
        a = F.broadcast(a)
    return a.join(b, (F.col("a_video_id") != F.col("b_video_id")) & (hamming(F.col("a_h"), F.col("b_h")) <= radius))


def match_counts(pairs: DataFrame) -> DataFrame:
    """src, dst, matches: pairs of hashes of each pair of videos."""
    return pairs.groupBy(F.col("a_video_id").alias("src"), F.col("b_video_id").alias("dst")).agg(F.sum(F.col("a_m") * F.col("b_m")).alias("matches"))


def hash_counts(hashes: DataFrame) -> DataFrame:
    """video_id, n: usable hashes of each video."""
    return hashes.where(usable(F.col("h"))).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))


def required_matches(n_a: Column, n_b: Column, percent: float) -> Column:
    return F.ceil(F.greatest(n_a, n_b).cast("double") * F.lit(float(percent)) / F.lit(100.0)).cast("long")


def edges(counts: DataFrame, hashes: DataFrame, number: int | None = None, percent: float | None = None) -> DataFrame:
    """src, dst, matches of the pairs with enough matches: a fixed number, or a percentage of the larger hash count."""
    if percent is None:
        return counts.where(F.col("matches") >= (number or 1))
    n = hash_counts(hashes)
    a, b = n.select(F.col("video_id").alias("src"), F.col("n").alias("n_src")), n.select(F.col("video_id").alias("dst"), F.col("n").alias("n_dst"))
    both = counts.join(a, "src").join(b, "dst").withColumn("required", required_matches(F.col("n_src"), F.col("n_dst"), percent))
    return both.where(F.col("matches") >= F.col("required")).select("src", "dst", "matches")


def matches_between(xs: Column, ys: Column, radius: int) -> Column:
    """Matches of two videos with the hashes xs and ys (h, m)."""
    zero = F.lit(0).cast("long")
    return F.aggregate(xs, zero, lambda total, a: total + F.aggregate(ys, zero, lambda n, b: n + F.when(hamming(a["h"], b["h"]) <= radius, a["m"] * b["m"]).otherwise(zero)))


def _wanted(params: SearchParams, n_a: Column, n_b: Column) -> Column:
    """Matches that two videos of so many hashes need."""
    kind, value = params.required
    return required_matches(n_a, n_b, value) if kind == "percent" else F.lit(int(value)).cast("long")


def _parted(found: DataFrame, heavy: DataFrame, params: SearchParams, strategy: str) -> tuple[DataFrame, DataFrame]:
    """Links between classes that share a match without a heavy hash, and the classes' rows as far as they can match heavy ones.

    Only hashes that aren't heavy are joined. A pair that this finds is counted
    in full: what heavy hashes and those near them add comes from the two
    classes' arrays of these alone. All other pairs have no match but with a heavy hash, so that these arrays say all of them.
    """
    each = found.select("id", "n", F.explode("hs").alias("x")).select("id", "n", F.col("x.h").alias("h"), F.col("x.m").alias("m"))
    distinct = each.select("h").distinct()
    # heavy ones stand as one video, all hashes as another
    both = heavy.select(F.lit(0).alias("video_id"), "h").unionByName(distinct.select(F.lit(1).alias("video_id"), "h"))
    near = materialize(hamming_pairs(both, params.radius, strategy).select(F.col("b_h").alias("h")).distinct(), "near-heavy")
    near = near.join(heavy.withColumn("heavy", F.lit(True)), "h", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    few = each.join(near, "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("h", "m", "heavy"))).alias("hs"))
    few = materialize(few.join(found.select("id", "n"), "id"), "heavy-rows")
    light = each.join(heavy, "h", "left_anti").select(F.col("id").alias("video_id"), "h", "m")
    counts = hamming_matches(light, params.radius, strategy)
    sizes, arrays = found.select("id", "n"), few.select("id", "hs")
    for end, k in (("src", "a"), ("dst", "b")):
        counts = counts.join(sizes.select(F.col("id").alias(end), F.col("n").alias(f"n_{k}")), end).join(arrays.select(F.col("id").alias(end), F.col("hs").alias(f"hs_{k}")), end, "left")
    plain = lambda hs: F.transform(hs, lambda x: F.struct(x["h"].alias("h"), x["m"].alias("m")))
    some = lambda hs, heavy: plain(F.filter(hs, lambda x: x["heavy"] == F.lit(heavy)))
    a, b = F.col("hs_a"), F.col("hs_b")
    more = matches_between(some(a, True), plain(b), params.radius) + matches_between(some(a, False), some(b, True), params.radius)
    links = counts.where(F.col("matches") + F.coalesce(more, F.lit(0)) >= _wanted(params, F.col("n_a"), F.col("n_b"))).select("src", "dst")
    n = F.col("n") if params.required[0] == "percent" else F.lit(0).cast("long")  # where it doesn't count, it keeps no rows apart
    return links, few.select("id", n.alias("n"), plain(F.col("hs")).alias("hs"))


#: Classes of videos that share a hash from which it is heavy, and how often what is left is parted again.
HEAVY = 256
LEVELS = 8


def linked_classes(hashes: DataFrame, params: SearchParams, strategy: str = "auto", heavy_from: int = HEAVY) -> DataFrame:
    """src, dst: links with the same components as edges_for.

    Videos with the same hashes, however many, are one class: its smallest
    video is compared with those of other classes, and its other videos link to
    that one if it has a link, or if two such videos have enough matches.

    Hashes of over heavy_from classes leave the join (see ``_parted``). What
    pairs of classes then have left are matches with heavy hashes, which the
    classes' rows of these say alone: the same question over rows that are
    fewer, and of which many are equal, so that it is asked again. Where that merges no more rows, all pairs are counted.
    """
    rows = weighted(hashes).groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("h", "m"))).alias("hs"))
    rows = rows.withColumn("n", F.aggregate("hs", F.lit(0).cast("long"), lambda x, h: x + h["m"])).withColumnRenamed("video_id", "id")
    rows, levels, before = materialize(rows, "video-hashes"), [], -1
    for level in range(LEVELS + 1):
        found = rows.groupBy("hs", "n").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_videos"))
        found = materialize(found, f"classes{level}")
        heavy = found.select(F.explode("hs").alias("x")).groupBy(F.col("x.h").alias("h")).agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > heavy_from).select("h")
        now = -1
        if level == LEVELS or heavy.isEmpty() or (now := found.count()) == before:  # nothing is heavy, or asking again gets no further
            levels.append((rows, found, materialize(_between(found, params, strategy), f"class-edges{level}")))
            break
        heavy = materialize(heavy, f"heavy{level}")
        between, rest = _parted(found, heavy, params, strategy)
        levels.append((rows, found, materialize(between, f"class-edges{level}")))
        rows, before = materialize(rest, f"rest{level}"), now if level else -1
    links: DataFrame | None = None
    own, wanted = matches_between(F.col("hs"), F.col("hs"), params.radius), _wanted(params, F.col("n"), F.col("n"))
    for level, (rows, found, between) in reversed(list(enumerate(levels))):
        links = between if links is None else links.unionByName(between)
        # what links a class, here or by what is left of it, links all that are equal to it
        ends = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct().withColumn("linked", F.lit(True))
        # of n hashes, all of them here, at least n match themselves
        alike = F.when((F.col("n") >= wanted) & F.lit(level == 0), F.lit(True)).otherwise(own >= wanted)
        many = found.where("n_videos > 1").join(ends, "id", "left").where(F.col("linked") | alike)
        within = rows.join(many.select("hs", "n", F.col("id").alias("rep")), ["hs", "n"]).where("id <> rep")
        links = links.unionByName(within.select(F.col("rep").alias("src"), F.col("id").alias("dst")))
        if len(levels) > 1:
            links = materialize(links, "links")
    assert links is not None
    return links


def _between(found: DataFrame, params: SearchParams, strategy: str) -> DataFrame:
    """Links between classes (id, hs, n) by all pairs of their hashes."""
    rows = found.select(F.col("id").alias("video_id"), F.explode("hs").alias("x")).select("video_id", F.col("x.h").alias("h"), F.col("x.m").alias("m"))
    counts = hamming_matches(rows, params.radius, strategy)
    for end, k in (("src", "a"), ("dst", "b")):
        counts = counts.join(found.select(F.col("id").alias(end), F.col("n").alias(f"n_{k}")), end)
    return counts.where(F.col("matches") >= _wanted(params, F.col("n_a"), F.col("n_b"))).select("src", "dst")


def edges_for(hashes: DataFrame, params: SearchParams, strategy: str = "auto") -> DataFrame:
    kind, value = params.required
    counts = hamming_matches(hashes, params.radius, strategy)
    return edges(counts, hashes, percent=value) if kind == "percent" else edges(counts, hashes, number=int(value))
