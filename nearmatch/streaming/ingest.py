"""Continuous ingestion: new files of a watched folder, in micro-batches, and the sampler over a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from nearmatch.operators.sampling import Greedy


def watch(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, known: Callable[[], DataFrame], available_now: bool = True) -> StreamingQuery:
    """Hand each micro-batch's files (path, size, modified_at) that are not known yet to handle.

    Spark's checkpoint remembers which files were read; the anti-join makes a
    repeated batch harmless. Spark's file streams pass over names that begin with _ or
    a full stop; a scan (``sources.files.scan``) finds these.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    files = stream.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss").alias("modified_at"))

    def batch(df: DataFrame, number: int) -> None:
        handle(df.dropDuplicates(["path"]).join(known().select("path"), "path", "left_anti"), number)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def sample_stream(frames: DataFrame, step: float, late: str | None = None) -> DataFrame:
    """key, t of the frames of a stream that the greedy sampler keeps; per key it remembers the next due time.

    frames has key and t, and each micro-batch goes on where the one before ended. With late,
    an interval such as "5 seconds", frames also has a timestamp, at, by which they are ordered across
    micro-batches: a frame waits until the watermark, which is so far behind the latest one, has
    passed it. Frames that come later than that are lost, and those of the last such interval wait for more to come.
    """
    if late is None:
        return frames.select("key", "t").groupBy("key").applyInPandasWithState(_at_once(step), "key long, t double", "due double", "append", GroupStateTimeout.NoTimeout)
    waiting = frames.select("key", "t", "at").withWatermark("at", late)
    kind = "due double, at array<long>, t array<double>"
    return waiting.groupBy("key").applyInPandasWithState(_in_order(step), "key long, t double", kind, "append", GroupStateTimeout.EventTimeTimeout)


def _sampled(due: Greedy, times: Iterable[float | None]) -> list[float | None]:
    return [t for t in times if due.take(None if pd.isna(t) else t)]


def _at_once(step: float) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due = Greedy(step, state.get[0] if state.exists else 0.0)
        kept = _sampled(due, pd.concat(list(batches))["t"].sort_values(na_position="last"))
        state.update((due.next,))
        yield pd.DataFrame({"key": [key[0]] * len(kept), "t": kept})

    return run


def _in_order(step: float) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_due, ats, times = state.get if state.exists else (0.0, [], [])
        held = list(zip(ats, times))
        if not state.hasTimedOut:
            for pdf in batches:
                held += zip(pdf["at"].astype("datetime64[ms]").astype("int64").tolist(), pdf["t"].astype(object).where(pdf["t"].notna(), None).tolist())
        held.sort(key=lambda x: (x[0], x[1] is None, x[1] or 0.0))
        passed = state.getCurrentWatermarkMs()
        ready = [t for at, t in held if at <= passed]
        held = held[len(ready) :]
        due = Greedy(step, next_due)
        kept = _sampled(due, ready)
        state.update((due.next, [at for at, _ in held], [t for _, t in held]))
        if held:
            state.setTimeoutTimestamp(max(held[0][0], passed + 1))
        yield pd.DataFrame({"key": [key[0]] * len(kept), "t": kept}).astype({"key": "int64", "t": "float64"})

    return run
