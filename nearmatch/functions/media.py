"""Columns for paths, times and labels of media files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the picture of videos without thumbnails.
DEFAULT_THUMBNAIL = "./sneed.png"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """What stands before the last slash; the root for files in it; nothing for a bare name."""
    return F.when(F.instr(path, "/") == 0, F.lit("")).when(path.rlike("^/[^/]*$"), F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the name; none if the name only starts with a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    """The name without its extension."""
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def normal_path(path: Column) -> Column:
    """A path without its scheme, doubled slashes and single dots."""
    p = F.regexp_replace(path, r"^file:/*", "/")
    p = F.regexp_replace(p, r"/(\./)+", "/")
    p = F.regexp_replace(p, "/{2,}", "/")
    return F.regexp_replace(p, r"(?<=.)/\.?$", "")


def local_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def duration_seconds(micros: Column) -> Column:
    """Whole seconds, cut off."""
    return (micros / 1e6).cast("int")


def frame_rate(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def seconds_to_pts(seconds: Column, tb_num: Column, tb_den: Column) -> Column:
    """A time in units of a timebase: whole microseconds first, then the nearest unit, halves away from 0."""
    micros = F.rint(seconds * 1e6)
    return F.round(micros * tb_den / (tb_num * F.lit(1e6))).cast("long")


def seek_targets(duration: Column, shares: tuple[float, ...] = (0.30, 0.70)) -> Column:
    """The times that fast hashing looks at; none beyond the duration."""
    return F.filter(F.array(*[F.lit(float(s)) * duration for s in shares]), lambda t: t <= duration)


def thumbnail_times(duration: Column, n: Column) -> Column:
    """n times that cut a duration into n + 1 equal parts."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i + 1) * duration.cast("double") / (n + 1))).otherwise(F.array().cast("array<double>"))


def media_duration(container: Column, stream: Column) -> Column:
    """The container's duration, else the stream's, else one second."""
    return F.coalesce(F.when(container > 0, container), F.when(stream > 0, stream), F.lit(1.0))


def thumbnail_name(path: Column, i: Column) -> Column:
    return F.concat(stem(path), F.lit("_"), F.left(F.sha1(path), F.lit(8)), F.format_string("_thumb-%03d.jpg", i))


# Two-digit labels round the shortest decimal text of a number, halves up.


def size_label(size: Column) -> Column:
    return F.format_string("%.2f GB", size / F.lit(1024.0**3))


def bit_rate_label(bit_rate: Column) -> Column:
    return F.format_string("%.2f Mbps", bit_rate / F.lit(1e6))


def resolution_label(width: Column, height: Column) -> Column:
    return F.concat(width.cast("string"), F.lit("x"), height.cast("string"))


def group_label(number: Column, members: Column, size: Column) -> Column:
    return F.format_string("Group %d (%d Duplicates - Size: %.2f GB)", number, members, size / F.lit(1024.0**3))


def or_unknown(name: Column, number: Column | None = None) -> Column:
    """A name; without one its number, if any; else unknown."""
    known = F.when(name != "", name)
    return F.coalesce(known, number.cast("string"), F.lit("unknown")) if number is not None else F.coalesce(known, F.lit("unknown"))


def decode_thumbnails(text: Column) -> Column:
    """A stored list of thumbnails: a JSON array, a JSON string, or the raw text; nothing for empty texts."""
    array = F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))
    string = F.when(text.rlike(r'^\s*".*"\s*$'), F.array(F.get_json_object(F.concat(F.lit('{"x":'), text, F.lit("}")), "$.x")))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.coalesce(array, string, F.array(text)))


def encode_thumbnails(paths: Column) -> Column:
    return F.to_json(paths)


def or_default_thumbnail(paths: Column, default: str = DEFAULT_THUMBNAIL) -> Column:
    return F.when(F.coalesce(F.size(paths), F.lit(0)) > 0, paths).otherwise(F.array(F.lit(default)))
