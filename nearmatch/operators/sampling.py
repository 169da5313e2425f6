"""Which frames are hashed: the greedy sampler, targets and forward as-of picks.

Over tables of frames these are columns and joins. ``Greedy`` and ``AsOf`` are the
same rules over frames that a task decodes one after another.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearmatch.operators.joins import with_places
from nearmatch.sources.shared import materialize


#: Parts of the duration at which fast hashing looks, and seconds between the frames of slow hashing.
SHARES = (0.30, 0.70)
PERIOD = 1.0


class Greedy:
    """The sampler over the frames of one file: what sample_fold is over an array."""

    def __init__(self, step: float, first: float = 0.0) -> None:
        self.step, self.next = step, first

    def take(self, seconds: float | None) -> bool:
        due = seconds is None or seconds >= self.next
        if due:
            self.next += self.step
        return due


class AsOf:
    """The frame that a target picks from frames (pts, timebase numerator, denominator, ..., keyframe) in any order.

    The first at or after the target; of keyframes the last up to it, or where there is none, the first after it.
    """

    def __init__(self, seconds: float, keyframes: bool) -> None:
        self.seconds, self.keyframes = seconds, keyframes
        self.frame: tuple | None = None
        self.rank: tuple | None = None

    def take(self, frame: tuple) -> bool:
        """Look at a frame; whether no later one, if times rise, can be a better pick."""
        pts, num, den = frame[:3]
        if pts is None or self.keyframes and len(frame) > 6 and not frame[6]:
            return False
        # whole microseconds, then the nearest unit, halves away from 0
        at = int(math.floor(abs(x := round(self.seconds * 1e6) * den / (num * 1e6)) + 0.5) * math.copysign(1, x))
        if not self.keyframes and pts < at:
            return False
        rank = (pts > at, abs(pts - at)) if self.keyframes else (False, pts)
        if self.rank is None or rank < self.rank:
            self.rank, self.frame = rank, frame
        return pts >= at


def sample_frames(frames: DataFrame, partition: str, pts: str, step: float, tie: str) -> DataFrame:
    """frames with due: whether the sampler keeps a frame, in closed form. Times must not be null; see sample_fold.

    The sampler keeps a frame if its time has reached the next due time, which
    starts at 0 and moves by one step for each frame kept. After n frames, the
    last of which is in step f, the number kept is n + min(f + 1 - n) over the
    frames so far, between 0 and n; a frame is due where that number grows.
    """
    w = Window.partitionBy(partition).orderBy(pts, tie)
    rows = frames.withColumn("_n", F.row_number().over(w)).withColumn("_f", F.greatest(F.floor(F.col(pts) / F.lit(step)), F.lit(-1)))
    rows = rows.withColumn("_k", F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_n") + F.min(F.col("_f") + 1 - F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, 0)))))
    return rows.withColumn("due", F.col("_k") > F.lag("_k", 1, 0).over(w)).drop("_n", "_f", "_k")


#: Frames of a chunk, and chunks that one step of the tree puts together.
CHUNK = 4096
FAN = 16
#: Frames of a run that are put together for many runs at once, and frames that a task looks at at once.
PIECE = 128
FRAMES = 1 << 18
#: The step of a frame without a time, and the largest of others: more than is ever kept.
UNTIMED = 1 << 62
LAST_STEP = 1 << 53


@dataclass
class Span:
    """What the sampler does over a run of frames, whatever it has kept before.

    Of n frames kept before it makes n + gain, less the number of drops below
    n. A frame in step f is kept where no more than f were kept before, so that
    f and f + 1 before are the same after: one drop. A frame without a time is always kept
    and drops nothing; one before time 0 never is. Drops below what is reached at all are taken off the gain.
    """

    gain: int
    drops: np.ndarray

    def after(self, kept: int) -> int:
        return kept + self.gain - int(np.searchsorted(self.drops, kept))

    def _before(self, kept: np.ndarray) -> np.ndarray:
        """The largest number before that makes each of kept; negative where none does."""
        return kept - self.gain + np.searchsorted(self.drops - np.arange(len(self.drops)) + self.gain, kept, side="right")

    def then(self, other: Span) -> Span:
        more = self._before(other.drops)
        reached = more >= 0
        return Span(self.gain + other.gain - int((~reached).sum()), np.sort(np.concatenate([self.drops, more[reached]])))

    def from_place(self, frames: int) -> Span:
        """The same where so many frames stand before: no more were kept, so that drops from there on say nothing."""
        return Span(self.gain, self.drops[: np.searchsorted(self.drops, frames)])

    @classmethod
    def of(cls, steps: list[int | None]) -> Span:
        """The span of frames by their steps."""
        return cls.of_runs(np.array([[UNTIMED if f is None else f for f in steps]], np.int64))[0]

    @classmethod
    def of_runs(cls, steps: np.ndarray) -> list[Span]:
        """The span of each row of steps, filled up with -1: pieces of all rows at once, put together in halves."""
        width = max(1, steps.shape[1])
        size = min(PIECE, width)
        n = -(-width // size)
        filled = np.full((len(steps), n * size), -1, np.int64)
        filled[:, : steps.shape[1]] = steps
        gain, drops = _pieces(np.ascontiguousarray(filled.reshape(-1, size).T))
        held = np.ascontiguousarray(drops.T)
        spans = [cls(g, d[:k]) for g, d, k in zip(gain.tolist(), held, (held < UNTIMED).sum(axis=1).tolist())]
        return [_in_halves(spans[at : at + n]) for at in range(0, len(spans), n)]


def _pieces(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gain and drops, in order and filled up with UNTIMED, of the run in each column.

    The drop of a frame in step f is the largest number before that makes f:
    of the numbers that are no drop yet, the one at place f - gain. ranks are those places of the drops so far.
    """
    gain, ranks, drops = np.zeros(steps.shape[1], np.int64), np.full(steps.shape, UNTIMED), np.full(steps.shape, UNTIMED)
    for k, f in enumerate(steps):
        at, so_far = f - gain, ranks[:k]
        timed = (at >= 0) & (f < UNTIMED)
        above = so_far > at
        drops[k] = np.where(timed, at + k - above.sum(axis=0), UNTIMED)
        so_far -= above & timed
        ranks[k] = np.where(timed, at, UNTIMED)
        gain += timed | (f == UNTIMED)
    return gain, np.sort(drops, axis=0)


def _in_halves(spans: list[Span]) -> Span:
    while len(spans) > 1:
        spans = [a.then(b) for a, b in zip(spans[::2], spans[1::2])] + spans[len(spans) & ~1 :]
    return spans[0]


def steps_of(t: np.ndarray, step: float) -> np.ndarray:
    """The largest number of steps that is no more than each time; UNTIMED where there is no time."""
    f = np.floor(t / step)
    f = np.where((f + 1) * step <= t, f + 1, np.where(f * step > t, f - 1, f))
    return np.where(np.isnan(t), UNTIMED, np.clip(np.nan_to_num(f, nan=-1.0, posinf=LAST_STEP, neginf=-1.0), -1, LAST_STEP).astype(np.int64))


def _lists(values: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values))


def sample_chunks(frames: DataFrame, partition: str, pts: str, step: float, *order: str, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """frames with due, as sample_fold has it over each partition in an order, null times included; one partition is as many rows to deal out as it has chunks.

    A chunk of frames is a function from what was kept before it to what is
    kept after it (``Span``). These are put together fan at a time up a tree, and going down again
    each chunk learns what was kept before it, from which it says which of its frames are due.
    What is put together is one row, an array; tasks take many rows at once.
    """
    key = frames.schema[partition].dataType.simpleString()
    placed = with_places(frames, partition, *order, name="_place").withColumn("_chunk", F.expr(f"(_place - 1) div {chunk}"))
    placed = materialize(placed, "chunks")
    of = f"`{partition}` {key}, _chunk long"

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = max(1, FRAMES // chunk)
        return (batch.slice(at, n) for batch in batches for at in range(0, batch.num_rows, n))

    def steps(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Steps of each row's frames, filled up with -1, and which of them are frames."""
        t = batch.column("t")
        n = np.diff(t.offsets.to_numpy())
        there = np.arange(n.max(initial=0)) < n[:, None]
        f = np.full(there.shape, -1, np.int64)
        f[there] = steps_of(t.flatten().to_numpy(zero_copy_only=False), step)
        return f, there

    def rows(batch: pa.RecordBatch, spans: list[Span]) -> pa.RecordBatch:
        drops = _lists(np.concatenate([s.drops for s in spans]), np.array([len(s.drops) for s in spans]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.gain for s in spans], pa.int64()), drops], [partition, "_chunk", "gain", "drops"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some(batches):
            yield rows(batch, [s.from_place(at * chunk) for at, s in zip(batch.column(1).to_pylist(), Span.of_runs(steps(batch)[0]))])

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[Span]]]:
        """Of each row its number and the spans in it."""
        held = batch.column("parts").flatten()
        drops = held.field("drops")
        values, ends = drops.values.to_numpy(), drops.offsets.to_numpy().tolist()
        spans = [Span(g, values[a:b]) for g, a, b in zip(held.field("gain").to_pylist(), ends, ends[1:])]
        ends = batch.column("parts").offsets.to_numpy()
        ends = (ends - ends[0]).tolist()
        return zip(batch.column(1).to_pylist(), (spans[a:b] for a, b in zip(ends, ends[1:])))

    def up(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in some(batches):
                yield rows(batch, [_in_halves(spans).from_place(at * size) for at, spans in parts(batch)])

        return put_together

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some(batches):
            out = []
            for kept, (_, spans) in zip(batch.column("kept").to_pylist(), parts(batch)):
                out.append([kept])
                for span in spans[:-1]:
                    out[-1].append(span.after(out[-1][-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], [partition, "_chunk", "kept"])

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some(batches):
            f, there = steps(batch)
            kept, due = batch.column("kept").to_numpy().copy(), np.zeros(f.shape, bool)
            for k in range(f.shape[1]):
                due[:, k] = kept <= f[:, k]
                kept += due[:, k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(due[there], there.sum(axis=1))], [partition, "_chunk", "due"])

    def packed(spans: DataFrame, level: int) -> DataFrame:
        each = F.sort_array(F.collect_list(F.struct("_chunk", "gain", "drops")))
        return materialize(spans.groupBy(partition, F.expr(f"_chunk div {fan}").alias("_up")).agg(each.alias("parts")), f"spans{level}")

    def beside(left: DataFrame, number: str, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({partition: "_of", "_chunk": "_at"})
        return left.join(right, F.col(partition).eqNullSafe(F.col("_of")) & (F.col(number) == F.col("_at"))).drop("_of", "_at")

    times = F.transform(F.sort_array(F.collect_list(F.struct("_place", F.col(pts).cast("double").alias("t")))), lambda x: x["t"])
    chunks = materialize(placed.groupBy(partition, "_chunk").agg(times.alias("t")), "times")
    levels = [packed(chunks.mapInArrow(first, f"{of}, gain long, drops array<long>"), 0)]
    while not levels[-1].where("_up > 0").isEmpty():
        size = chunk * fan ** len(levels)
        levels.append(packed(levels[-1].mapInArrow(up(size), f"{of}, gain long, drops array<long>"), len(levels)))
    kept = levels[-1].select(partition, F.col("_up").alias("_chunk"), F.lit(0).cast("long").alias("kept"))
    for level in reversed(levels):
        found = beside(level, "_up", kept).mapInArrow(down, f"{of}, kept array<long>")
        found = found.select(partition, "_chunk", F.posexplode("kept").alias("_n", "kept")).withColumn("_chunk", F.expr(f"_chunk * {fan} + _n"))
        kept = materialize(found.drop("_n"), "kept")
    flags = beside(chunks, "_chunk", kept).mapInArrow(flag, f"{of}, due array<boolean>")
    return beside(placed, "_chunk", flags).withColumn("due", F.expr(f"due[int((_place - 1) % {chunk})]")).drop("_place", "_chunk")


def sample_fold(pts: Column, step: float) -> Column:
    """Of an array of times in order, whether each is due: the sampler as a fold. Null times are always due."""
    start = F.struct(F.lit(0.0).alias("next"), F.array().cast("array<boolean>").alias("due"))

    def merge(state: Column, x: Column) -> Column:
        due = x.isNull() | (x.cast("double") >= state["next"])
        return F.struct((state["next"] + F.when(due, F.lit(float(step))).otherwise(F.lit(0.0))).alias("next"), F.concat(state["due"], F.array(due)).alias("due"))

    return F.aggregate(pts, start, merge, lambda s: s["due"])


def forward_asof(frames: DataFrame, targets: DataFrame, key: str, pts: str, target: str, value: str) -> DataFrame:
    """key, target, pts, value of the first frame at or after each target; targets without one are left out. Of frames at one time the smallest value counts.

    Frames and targets are sorted together once, latest first, and each target
    takes the frame that was last passed: no pair of the two is ever made.
    """
    frame = F.struct(F.col(pts).alias("p"), F.col(value).alias("v"))
    rows = frames.where(F.col(pts).isNotNull()).select(F.col(key), F.col(pts).alias("_at"), frame.alias("_frame"), F.lit(None).cast(targets.schema[target].dataType).alias("_target"))
    wanted = targets.where(F.col(target).isNotNull()).select(F.col(key), F.col(target).alias("_at"), F.lit(None).cast(rows.schema["_frame"].dataType).alias("_frame"), F.col(target).alias("_target"))
    # of one time: frames by falling value, then targets, so that a target sees all frames at its time
    w = Window.partitionBy(key).orderBy(F.desc("_at"), F.col("_frame").isNull(), F.desc("_frame")).rowsBetween(Window.unboundedPreceding, 0)
    passed = rows.unionByName(wanted).withColumn("_next", F.last("_frame", ignorenulls=True).over(w))
    found = passed.where(F.col("_target").isNotNull() & F.col("_next").isNotNull())
    return found.select(key, F.col("_target").alias(target), F.col("_next.p").alias(pts), F.col("_next.v").alias(value)).distinct()


def both_or_none(hashes: DataFrame, key: str, wanted: int = 2) -> DataFrame:
    """Hashes of the keys that have exactly as many as wanted: fast hashing is all or nothing."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return hashes.withColumn("_n", n).where(F.col("_n") == wanted).drop("_n")


def without_fatal(hashes: DataFrame, key: str, fatal: str) -> DataFrame:
    """Hashes of the keys of which no frame failed fatally."""
    bad = F.max(F.coalesce(F.col(fatal), F.lit(False)).cast("int")).over(Window.partitionBy(key))
    return hashes.withColumn("_bad", bad).where("_bad = 0").drop("_bad")
