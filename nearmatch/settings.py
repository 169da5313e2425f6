"""Search parameters: defaults, limits, JSON text, and the choice of thresholds by hash method."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from enum import IntEnum
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class HashMethod(IntEnum):
    FAST = 0
    SLOW = 1


#: Lowest and highest value of each limited parameter.
LIMITS = {
    "hammingDistance": (0, 64),
    "matchingThreshold": (1, 10_000),
    "skipPercent": (0, 40),
    "matchingThresholdPct": (1.0, 100.0),
    "matchingThresholdNum": (1, 10_000),
    "thumbnailsPerVideo": (1, 4),
}
FAST_FRAMES = (2, 10)


def clamp(value: Any, name: str) -> Any:
    low, high = LIMITS[name]
    return max(low, min(high, value))


def clamp_column(value: Column, name: str) -> Column:
    low, high = LIMITS[name]
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


@dataclass(frozen=True)
class FastHash:
    maxFrames: int = 2
    hammingDistance: int = 4
    matchingThreshold: int = 2
    useKeyframesOnly: bool = True

    def limited(self) -> FastHash:
        frames = self.maxFrames if self.maxFrames in FAST_FRAMES else FAST_FRAMES[0]
        return replace(self, maxFrames=frames, hammingDistance=clamp(self.hammingDistance, "hammingDistance"), matchingThreshold=clamp(self.matchingThreshold, "matchingThreshold"))


@dataclass(frozen=True)
class SlowHash:
    skipPercent: int = 15
    maxFrames: int = 2**31 - 1
    hammingDistance: int = 4
    usePercentThreshold: bool = False
    matchingThresholdPct: float = 50.0
    matchingThresholdNum: int = 5
    useKeyframesOnly: bool = True

    def limited(self) -> SlowHash:
        names = ("skipPercent", "hammingDistance", "matchingThresholdPct", "matchingThresholdNum")
        return replace(self, **{n: clamp(getattr(self, n), n) for n in names})


@dataclass(frozen=True)
class SearchParams:
    useGlob: bool = False
    caseInsensitive: bool = False
    extensions: tuple[str, ...] = ()
    includeFilePatterns: tuple[str, ...] = ()
    includeDirPatterns: tuple[str, ...] = ()
    excludeFilePatterns: tuple[str, ...] = ()
    excludeDirPatterns: tuple[str, ...] = ()
    directories: tuple[tuple[str, bool], ...] = ()
    thumbnailsPerVideo: int = 4
    minBytes: int | None = None
    maxBytes: int | None = None
    method: HashMethod = HashMethod.FAST
    fastHash: FastHash = field(default_factory=FastHash)
    slowHash: SlowHash = field(default_factory=SlowHash)

    def to_json(self) -> str:
        """All keys, absent limits as null."""
        d = dict(vars(self))
        d["directories"] = [{"path": p, "recursive": r} for p, r in self.directories]
        d["method"] = int(self.method)
        d["fastHash"], d["slowHash"] = vars(self.fastHash), vars(self.slowHash)
        return json.dumps(d)

    @classmethod
    def from_json(cls, text: str | None) -> SearchParams:
        """Limited values; no text, or one that is not a complete JSON object, gives the defaults.

        Where an old text has no useKeyframesOnly, it was on for fast and off
        for slow hashing.
        """
        try:
            d = json.loads(text or "")
            lists = ("extensions", "includeFilePatterns", "includeDirPatterns", "excludeFilePatterns", "excludeDirPatterns")
            return cls(
                useGlob=bool(d["useGlob"]),
                caseInsensitive=bool(d["caseInsensitive"]),
                **{n: tuple(d[n]) for n in lists},
                directories=tuple((x["path"], bool(x["recursive"])) for x in d["directories"]),
                thumbnailsPerVideo=clamp(int(d.get("thumbnailsPerVideo", 4)), "thumbnailsPerVideo"),
                minBytes=d.get("minBytes"),
                maxBytes=d.get("maxBytes"),
                method=HashMethod(d.get("method", 0)),
                fastHash=_load(FastHash, d["fastHash"], True).limited() if "fastHash" in d else FastHash(),
                slowHash=_load(SlowHash, d["slowHash"], False).limited() if "slowHash" in d else SlowHash(),
            )
        except (ValueError, KeyError, TypeError):
            return cls()

    @property
    def radius(self) -> int:
        return self.slowHash.hammingDistance if self.method is HashMethod.SLOW else self.fastHash.hammingDistance

    @property
    def required(self) -> tuple[str, float]:
        """How many matches a pair needs: ("number", n), or ("percent", p), which only slow hashing knows."""
        if self.method is HashMethod.FAST:
            return "number", self.fastHash.matchingThreshold
        if self.slowHash.usePercentThreshold:
            return "percent", self.slowHash.matchingThresholdPct
        return "number", self.slowHash.matchingThresholdNum


#: What a text of settings has to say of a way of hashing; keyframes may be left out.
_REQUIRED = {kind: [f.name for f in fields(kind) if f.name != "useKeyframesOnly"] for kind in (FastHash, SlowHash)}


def _load(kind: type, d: dict, keyframes: bool) -> Any:
    known = {name: d[name] for name in _REQUIRED[kind]}
    return kind(**known, useKeyframesOnly=bool(d.get("useKeyframesOnly", keyframes)))


def recoded(text: Column) -> Column:
    """Settings texts as the codec writes them: limited, complete, defaults where a text is none. In Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: SearchParams.from_json(t).to_json())

    return run(text)


def split_list(text: Column) -> Column:
    """A comma-separated list: trimmed, lower-cased, without empty entries."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda e: F.lower(F.trim(e))), lambda e: e != "")


def split_lines(text: Column) -> Column:
    """The lines of a text: trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda e: F.trim(e)), lambda e: e != "")


def megabytes(mb: Column) -> Column:
    """A size limit in bytes; 0 is no limit."""
    return F.when(mb > 0, mb.cast("long") * 1024 * 1024)


def keep_directories(directories, added, removed=None):
    """A directory list with new paths added (each path once, the first entry wins) and removed ones gone."""
    both = directories.select("path", "recursive", F.lit(0).alias("_o")).unionByName(added.select("path", "recursive", F.lit(1).alias("_o")))
    first = both.groupBy("path").agg(F.min_by("recursive", "_o").alias("recursive"))
    return first if removed is None else first.join(removed.select("path"), "path", "left_anti")
