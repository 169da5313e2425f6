"""Media adapters: how metadata and frames are got from files.

No codec library is part of this engine. An adapter is any object with the
methods of ``Adapter``; it runs on executors, in Arrow batches. ``PgmAdapter``
reads binary PGM sequences (one frame a second) and is what tests use; an
adapter for real containers plugs in at the same place.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

from nearmatch import schemas
from nearmatch.settings import HashMethod, SearchParams


class Adapter(Protocol):
    def probe(self, path: str) -> dict[str, Any] | None:
        """Columns of the video table from one file, or none if it can't be read. Of several streams of a kind the last counts."""

    def frames(self, path: str) -> Iterator[tuple]:
        """pts, timebase numerator and denominator, width, height and luma of each frame, in order; and whether it is a keyframe, if that is known.

        An exception says that the file can't be decoded any further: its hashes are discarded.

        An adapter that can seek also has seek(path, seconds), the frames from the last keyframe at or before a time
        on, or from the first one. Fast hashing then reads no others, and an exception counts only where it reads.
        """


class PgmAdapter:
    """Concatenated binary PGM images, 8 bits deep, one a second."""

    _head = re.compile(rb"P5\s+(\d+)\s+(\d+)\s+255\s")

    def frames(self, path: str) -> Iterator[tuple[int | None, int, int, int, int, bytes]]:
        with open(path, "rb") as f:
            n, rest = 0, f.read(64)
            while m := self._head.match(rest):
                w, h = int(m[1]), int(m[2])
                data = rest[m.end() :] + f.read(max(0, w * h - len(rest) + m.end()))
                yield n, 1, 1, w, h, data[: w * h]
                rest = data[w * h :]
                rest += f.read(64 - len(rest))
                n += 1

    def probe(self, path: str) -> dict[str, Any] | None:
        n, last = 0, None
        try:
            for last in self.frames(path):
                n += 1
        except OSError:
            return None
        if last is None:
            return None
        return {"video_codec": "pgm", "pix_fmt": "gray", "profile": "unknown", "level": 0, "width": last[3], "height": last[4], "duration": n, "avg_frame_rate": 1.0, "bit_rate": 0, "sample_rate_avg": 0}


def probe_files(files: DataFrame, adapter: Adapter) -> DataFrame:
    """The file table with the probe's columns and ok; failed probes stay, with ok false, for the error report."""
    names = [f.name for f in schemas.struct(schemas.VIDEO) if f.name not in {"id", "thumbnail_path", *files.columns}]
    kinds = {f.name: f.dataType.simpleString() for f in schemas.struct(schemas.VIDEO)}

    def probe(path: str) -> dict[str, Any] | None:
        try:
            return adapter.probe(path)
        except Exception:  # noqa: BLE001  an adapter's failure is the file's, and the search goes on
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [probe(p) for p in pdf["path"]]
            more = {n: pd.array([None if x is None else x.get(n) for x in found], dtype={"int": "Int32", "bigint": "Int64", "double": "Float64"}.get(kinds[n], "object")) for n in names}
            yield pdf.assign(**more, ok=[x is not None for x in found])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in files.schema] + [f"{n} {kinds[n]}" for n in names] + ["ok boolean"])
    return files.mapInPandas(run, schema)


#: Bytes of luma of one batch of frames.
FRAME_BYTES = 32 << 20


def read_frames(videos: DataFrame, adapter: Adapter) -> DataFrame:
    """The frame table of videos(id, path), for work on frames of your own: a search samples and hashes where it reads (``hash_videos``). In batches of at most FRAME_BYTES or one frame. Where the adapter fails, a row without a frame and with fatal."""
    columns = ["video_id", "pts", "tb_num", "tb_den", "w", "h", "luma", "key", "fatal"]
    kinds = dict.fromkeys(columns[1:6], "Int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for vid, path in zip(pdf["id"], pdf["path"]):
                rows, held = [], 0
                try:
                    for pts, num, den, w, h, luma, *key in adapter.frames(path):
                        rows.append((vid, pts, num, den, w, h, luma, key[0] if key else True, False))
                        held += len(luma)
                        if held >= FRAME_BYTES:
                            yield pd.DataFrame(rows, columns=columns).astype(kinds)
                            rows, held = [], 0
                except Exception:  # noqa: BLE001  as for probes
                    rows.append((vid, None, None, None, None, None, None, False, True))
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype(kinds)

    return videos.select("id", "path").mapInPandas(run, schemas.FRAME)


def _number(x: Any) -> int | None:
    return None if x is None or pd.isna(x) else int(x)


def _hash(frame: tuple, hashes: list[tuple[int, int]], pos: int) -> None:
    from nearmatch.functions.phash import hash_plane

    h = hash_plane(frame[5], _number(frame[3]), _number(frame[4]))
    if h:  # neither null nor 0
        hashes.append((pos, h))


def hash_video(adapter: Adapter, path: str, duration: float | None, params: SearchParams) -> list[int]:
    """The hashes of a file in order, of which never more than two frames are held: its frames are sampled as they are decoded.

    Fast: the first frames at or after 30 and 70 percent of the duration, or the
    keyframes that a seek to these ends at; both or none. Slow: one frame a
    second, by the greedy sampler, of keyframes alone if so set. What fails,
    decoder or hash function, is raised.
    """
    return SAMPLERS[params.method](adapter, path, duration, params)


def _fast(adapter: Adapter, path: str, duration: float | None, params: SearchParams) -> list[int]:
    from nearmatch.operators.sampling import SHARES, AsOf

    keys = params.fastHash.useKeyframesOnly
    targets = [] if duration is None else [s * duration for s in SHARES if s * duration <= duration]
    picks = [AsOf(t, keys) for t in targets]
    if hasattr(adapter, "seek"):
        for pick in picks:
            for frame in adapter.seek(path, pick.seconds):
                if pick.take(frame):
                    break
    else:
        for frame in adapter.frames(path):  # to the end: a failure anywhere is the file's
            for pick in picks:
                pick.take(frame)
    hashes: list[tuple[int, int]] = []
    for pos, pick in enumerate(picks):
        if pick.frame is not None:
            _hash(pick.frame, hashes, pos)
    return [h for _, h in hashes] if len(hashes) == len(SHARES) else []


def _slow(adapter: Adapter, path: str, duration: float | None, params: SearchParams) -> list[int]:
    from nearmatch.operators.sampling import PERIOD, Greedy

    due, hashes = Greedy(PERIOD), []
    for frame in adapter.frames(path):
        if params.slowHash.useKeyframesOnly and len(frame) > 6 and not frame[6]:
            continue
        pts = _number(frame[0])
        if due.take(None if pts is None else pts * frame[1] / frame[2]):
            _hash(frame, hashes, -1 if pts is None else pts)
    return [h for _, h in sorted(hashes)]


#: The sampler of each hash method.
SAMPLERS = {HashMethod.FAST: _fast, HashMethod.SLOW: _slow}

#: Files that a task decodes, where there are enough for all.
VIDEOS = 16


def hash_videos(videos: DataFrame, adapter: Adapter, params: SearchParams) -> DataFrame:
    """video_id, hashes, fatal of each of videos(id, path, duration), one row each: decoded, sampled and hashed where it is read.

    Only paths move between tasks, never pixels. Where a file can't be decoded or hashed to the end, fatal is true and there are no hashes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found, fatal = [], []
            for path, duration in zip(pdf["path"], pdf["duration"]):
                try:
                    found.append(hash_video(adapter, path, None if pd.isna(duration) else float(duration), params))
                    fatal.append(False)
                except Exception:  # noqa: BLE001  as for probes
                    found.append([])
                    fatal.append(True)
            yield pd.DataFrame({"video_id": pdf["id"], "hashes": found, "fatal": fatal})

    tasks = max(1, math.ceil(videos.count() / VIDEOS), videos.sparkSession.sparkContext.defaultParallelism)
    kind = videos.schema["id"].dataType.simpleString()
    dealt = videos.select("id", "path", "duration").repartition(tasks)
    return dealt.mapInPandas(run, f"video_id {kind}, hashes array<long>, fatal boolean")
