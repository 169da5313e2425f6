"""Thumbnails: frames at equal parts of a video, scaled to a square and written as JPEG files where executors can.

Adapters with ``pictures`` give RGB; of others, the luma is a grey picture. An
encoder turns a square into a file's bytes.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmatch.functions import media
from nearmatch.functions.jpeg import jpeg
from nearmatch.sources.probe import Adapter

SIDE = 128

Encoder = Callable[[np.ndarray], bytes]


def pgm(square: np.ndarray) -> bytes:
    h, w = square.shape
    return b"P5\n%d %d\n255\n" % (w, h) + square.tobytes()


def _weights(source: int, side: int) -> np.ndarray:
    """Linear weights of a line's pixels for each of side places; where pixels become fewer, all that a place covers count."""
    reach = max(1.0, source / side)
    centre = (np.arange(side) + 0.5) * source / side - 0.5
    out = np.maximum(0.0, 1 - np.abs(np.arange(source) - centre[:, None]) / reach)
    return out / out.sum(axis=1, keepdims=True)


def to_square(plane: np.ndarray, side: int = SIDE) -> np.ndarray:
    """A picture scaled to a square, linearly."""
    scaled = np.einsum("ay,yx...,bx->ab...", _weights(plane.shape[0], side), plane.astype(float), _weights(plane.shape[1], side), optimize=True)
    return np.clip(np.rint(scaled), 0, 255).astype(np.uint8)


def pictures(adapter: Adapter, path: str) -> Iterator[tuple[int | None, int, int, np.ndarray]]:
    if hasattr(adapter, "pictures"):
        yield from adapter.pictures(path)
        return
    for pts, num, den, w, h, luma, *_ in adapter.frames(path):
        yield pts, num, den, np.frombuffer(luma, np.uint8, w * h).reshape(h, w)


def planned(videos: DataFrame, n: int) -> DataFrame:
    """id, path, i, at, name: the thumbnails of videos(id, path, duration): number, time in seconds and file name."""
    times = media.thumbnail_times(media.media_duration(F.col("duration").cast("double"), F.lit(None).cast("double")), F.lit(n))
    at = videos.select("id", "path", F.posexplode(times).alias("i", "at"))
    return at.withColumn("name", media.thumbnail_name(F.col("path"), F.col("i")))


def write_thumbnails(videos: DataFrame, folder: str, adapter: Adapter, n: int = 4, encode: Encoder = jpeg) -> DataFrame:
    """id, thumbnail_path of each video: files of the first frames at or after each time, in order; the default where there is none."""
    wanted = planned(videos, n).groupBy("id", "path").agg(F.sort_array(F.collect_list(F.struct("i", "at", "name"))).alias("wanted"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            found = []
            for path, rows in zip(pdf["path"], pdf["wanted"]):
                left, made = [(r["at"], r["name"]) for r in rows], []
                try:
                    for pts, num, den, picture in pictures(adapter, path):
                        while left and pts is not None and pts * num / den >= left[0][0]:
                            target = os.path.join(folder, left.pop(0)[1])
                            with open(target, "wb") as f:
                                f.write(encode(to_square(picture)))
                            made.append(target)
                        if not left:
                            break
                except Exception:  # noqa: BLE001  what an adapter can't decode has the thumbnails made so far
                    pass
                found.append(made)
            yield pd.DataFrame({"id": pdf["id"], "thumbnail_path": found})

    made = wanted.mapInPandas(run, "id int, thumbnail_path array<string>")
    joined = videos.select("id").join(made, "id", "left")
    return joined.select("id", media.or_default_thumbnail(F.col("thumbnail_path")).alias("thumbnail_path"))
