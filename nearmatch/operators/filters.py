"""File predicates: extensions, sizes, glob and regular-expression patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmatch.functions.media import extension, file_name, parent_path
from nearmatch.settings import SearchParams

# The extensions of video files that a scan takes by default.
VIDEO_EXTENSIONS = tuple(
    """
    3g2 3gp amv asf avi bik divx drc f4a f4b f4p f4v
    flv gifv h264 hevc m1v m2ts m2v m4p m4v mkv mod
    mov mp2 mp4 mpe mpeg mpg mpv mxf mng nsv ogg ogv
    qt rm rmvb roq rrc smk svi ts vob webm wmv yuv
    """.split()
)
BULLET = "• "
#: Never found by a binary search of that list, which isn't in order; left out on request only.
UNORDERED = ("mxf", "mng")


def by_extension(path: Column, allowed: Iterable[str] = (), strict_compat: bool = False) -> Column:
    """Whether a file's extension is allowed: the caller's list, with or without dots, or the default one."""
    own = sorted({e.strip().lower().lstrip(".") for e in allowed} - {""})
    names = own or [e for e in VIDEO_EXTENSIONS if not (strict_compat and e in UNORDERED)]
    return extension(path).isin(*names)


def by_size(size: Column, low: int | None = None, high: int | None = None) -> Column:
    """Inclusive limits, each optional; unknown sizes are rejected."""
    ok = size.isNotNull()
    if low is not None:
        ok &= size >= low
    if high is not None:
        ok &= size <= high
    return ok


def glob_to_regex(glob: str) -> str:
    """An anchored pattern: * is any text (slashes too), ? any character, all else itself."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c) if not c.isalnum() and c != "_" else c) for c in glob) + "$"


def pattern_error(pattern: str) -> str | None:
    """What is wrong with a pattern in the dialect that runs it, Java's; without a session, in Python's."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is None:
            re.compile(pattern)
        else:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
    except re.error as e:
        return str(e)
    except (PySparkException, Py4JJavaError) as e:  # Spark's session shows known Java exceptions as its own
        return str(e).splitlines()[0]
    return None


def compile_patterns(patterns: Iterable[str], use_glob: bool = False, ignore_case: bool = False) -> tuple[list[str], list[str]]:
    """Patterns for rlike, and an error line for each invalid one, which is left out."""
    good, errors = [], []
    for raw in patterns:
        pattern = glob_to_regex(raw) if use_glob else raw
        if wrong := pattern_error(pattern):
            errors.append(f"{raw} ➜ {wrong}")
            continue
        good.append(f"(?i){pattern}" if ignore_case else pattern)
    return good, errors


def error_text(errors: Iterable[str]) -> str:
    return "\n".join(BULLET + e for e in errors)


def error_column(errors: Column) -> Column:
    """The same text of an array of messages."""
    return F.array_join(F.transform(errors, lambda e: F.concat(F.lit(BULLET), e)), "\n")


def match_any(text: Column, patterns: Iterable[str]) -> Column:
    """Whether any pattern is found anywhere in the text."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def include_exclude(name: Column, parent: Column, include_file: list[str], include_dir: list[str], exclude_file: list[str], exclude_dir: list[str]) -> Column:
    """If there is any include pattern, one has to match and excludes don't count; otherwise no exclude may match."""
    if include_file or include_dir:
        return match_any(name, include_file) | match_any(parent, include_dir)
    return ~(match_any(name, exclude_file) | match_any(parent, exclude_dir))


def accept_files(files: DataFrame, params: SearchParams, strict_compat: bool = False) -> DataFrame:
    """The rows of files(path, size) that a search takes, cheap predicates first."""
    compiled = {k: compile_patterns(getattr(params, k), params.useGlob, params.caseInsensitive)[0] for k in ("includeFilePatterns", "includeDirPatterns", "excludeFilePatterns", "excludeDirPatterns")}
    path = F.col("path")
    return (
        files.where(by_extension(path, params.extensions, strict_compat))
        .where(by_size(F.col("size"), params.minBytes, params.maxBytes))
        .where(include_exclude(file_name(path), parent_path(path), *compiled.values()))
    )


def pattern_test(df: DataFrame, column: str, pattern: str, use_glob: bool = False, ignore_case: bool = False) -> DataFrame:
    """df with matches: whether the pattern is found; an invalid pattern never is."""
    good, _ = compile_patterns([pattern], use_glob, ignore_case)
    return df.withColumn("matches", match_any(F.col(column), good))


def valid_probe(df: DataFrame) -> DataFrame:
    """Probed rows with a duration and a video stream of some size."""
    return df.where((F.col("duration") > 0) & (F.col("width") > 0) & (F.col("height") > 0))
