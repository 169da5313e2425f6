"""The perceptual hash of a luma plane: box sum, down-scale to 32x32, cosine transform, median threshold.

Arithmetic is double precision. Where a tile has no energy in the cropped
block but rounding noise (solid planes, ramps), the hash is 0, so that it is
dropped; without this, noise would decide all bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

N = 32
BOX = 7
#: Coefficients below this share of the tile's largest value count as noise.
EPSILON = 1e-9


def _basis() -> np.ndarray:
    x, y = np.meshgrid(np.arange(N), np.arange(N))
    c = np.sqrt(2 / N) * np.cos(np.pi / (2 * N) * y * (2 * x + 1))
    c[0] = 1 / np.sqrt(N)
    return c


#: Rows 1 to 8 of the DCT-II basis: the constant row and column are not looked at.
ROWS = _basis()[1:9]


def box_sum(plane: np.ndarray, size: int = BOX) -> np.ndarray:
    """Sums over size x size neighbourhoods; the edge repeats beyond the plane."""
    r = size // 2
    padded = np.pad(plane.astype(np.float64), r, mode="edge")
    total = np.pad(padded.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]


def _weights(source: int) -> np.ndarray:
    """Two-tap linear weights to N places. The first place is clamped after the weight is taken; the second is the one after it, if there is any."""
    at = (np.arange(N) + 0.5) * (source / N) - 0.5
    low = np.floor(at).astype(int)
    w = at - low
    first = np.clip(low, 0, source - 1)
    out = np.zeros((N, source))
    np.add.at(out, (np.arange(N), first), 1 - w)
    np.add.at(out, (np.arange(N), np.minimum(first + 1, source - 1)), w)
    return out


def scale_down(plane: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    return _weights(h) @ plane @ _weights(w).T


def coefficients(tile: np.ndarray) -> np.ndarray:
    """The 64 coefficients of the cropped block of a 32x32 tile, row by row."""
    return (ROWS @ tile @ ROWS.T).ravel()


def pack(block: np.ndarray, scale: float = 0.0) -> int:
    """The signed 64-bit hash of 64 coefficients; 0 if all are noise against scale."""
    if np.abs(block).max() <= EPSILON * max(scale, 1e-300):
        return 0
    above = block > np.median(block)
    value = sum(1 << (64 - i) for i in range(1, 64) if above[i])
    return value - (1 << 64) if value >> 63 else value


def hash_tile(tile: np.ndarray) -> int:
    """The hash of a 32x32 tile that is not scaled down any more: box sum, transform, threshold."""
    summed = box_sum(tile.reshape(N, N))
    return pack(coefficients(summed), float(np.abs(summed).max()))


def hash_plane(luma: bytes | None, width: int | None, height: int | None) -> int | None:
    """The hash of a luma plane; none without pixels or sizes."""
    if luma is None or not width or not height or width <= 0 or height <= 0 or len(luma) < width * height:
        return None
    plane = np.frombuffer(luma, np.uint8, width * height).reshape(height, width)
    tile = scale_down(box_sum(plane))
    return pack(coefficients(tile), float(np.abs(tile).max()))


def phash(luma: Column, width: Column, height: Column) -> Column:
    """The hash of each luma plane, null where there is none, in Arrow batches."""

    @F.pandas_udf("long")
    def run(a: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([hash_plane(x, None if pd.isna(y) else int(y), None if pd.isna(z) else int(z)) for x, y, z in zip(a, w, h)], dtype="Int64")

    return run(luma, width, height)


def phash_or_fatal(luma: Column, width: Column, height: Column) -> Column:
    """As phash, as h of a struct; fatal where the hash function itself failed, which says something of the whole video."""

    @F.pandas_udf("h long, fatal boolean")
    def run(a: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        found, fatal = [], []
        for x, y, z in zip(a, w, h):
            try:
                found.append(hash_plane(x, None if pd.isna(y) else int(y), None if pd.isna(z) else int(z)))
                fatal.append(False)
            except Exception:  # noqa: BLE001  whatever it is, it is told by the flag
                found.append(None)
                fatal.append(True)
        return pd.DataFrame({"h": pd.Series(found, dtype="Int64"), "fatal": fatal})

    return run(luma, width, height)


def phash_tile(tile: Column) -> Column:
    """The hash of each 32x32 tile, an array of 1024 numbers."""

    @F.pandas_udf("long")
    def run(tiles: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or len(t) != N * N else hash_tile(np.asarray(t, np.float64)) for t in tiles], dtype="Int64")

    return run(tile)


def is_flat(luma: bytes, width: int, height: int, dark: float = 16, still: float = 25) -> bool:
    """Whether a plane is solid, dark or without contrast on a grid of every 16th pixel. Optional; off by default."""
    grid = np.frombuffer(luma, np.uint8, width * height).reshape(height, width)[::16, ::16].astype(float)
    return bool(grid.min() == grid.max() or grid.mean() < dark or grid.var() < still)
