"""Groups of duplicates: membership, sizes, order, selection and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearmatch.functions import media
from nearmatch.operators.components import connected_components
from nearmatch.operators.joins import lookup, with_places
from nearmatch.sources.shared import materialize
from nearmatch.sources.store import with_ids


#: Edges, 16 bytes each, up to which one task finds the groups.
SMALL_GRAPH = 200_000


def known_edges(videos: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst of the edges of which both ends are among videos(id)."""
    ids = videos.select("id")
    known = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return known.select("src", "dst")


def membership(videos: DataFrame, edges: DataFrame) -> DataFrame:
    """group_id (the smallest id), video_id of every video, those without edges alone. Edges to unknown videos don't count."""
    ids = videos.select(F.col("id").alias("video_id"))
    labels = connected_components(known_edges(videos, edges), small=SMALL_GRAPH).select(F.col("id").alias("video_id"), F.col("component"))
    joined = ids.join(labels, ids["video_id"].cast("long") == labels["video_id"], "left").select(ids["video_id"], "component")
    return joined.select(F.coalesce("component", F.col("video_id").cast("long")).cast(ids.schema[0].dataType).alias("group_id"), "video_id")


def members(groups: DataFrame) -> DataFrame:
    """group_id and the ids of its members in order."""
    return groups.groupBy("group_id").agg(F.sort_array(F.collect_list("video_id")).alias("video_ids"))


def with_duplicates(rows: DataFrame, group: str = "group_id", spread: str = "video_id") -> DataFrame:
    """Rows of groups of two or more; spread is a column by which rows of a large group can be dealt out."""
    counts = materialize(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    return lookup(rows, counts, group, "n", spread).where("found.n >= 2").drop("found")


def sizes(rows: DataFrame, group: str = "group_id", size: str = "size") -> DataFrame:
    return rows.groupBy(group).agg(F.sum(size).alias("total_size"), F.count(F.lit(1)).alias("members"))


def except_extreme(rows: DataFrame, group: str, size: str, position: str, largest: bool, name: str = "selected") -> DataFrame:
    """rows with whether each is selected when all but the largest (or smallest) of its group are; of equal ones the first stays.

    Each task finds the head of what it has of a group; heads then meet, and go back beside the group's rows.
    """
    by = (F.col(size).isNull(), F.negative(size)) if largest else (F.col(size).isNotNull(), F.col(size))
    heads = rows.groupBy(group).agg(F.min_by(position, F.struct(*by, F.col(position))).alias("head"), F.count(F.lit(1)).alias("n"))
    found = lookup(rows, materialize(heads, "heads"), group, "n", position)
    return found.withColumn(name, ~F.col(position).eqNullSafe(F.col("found.head"))).drop("found")


def place_in_group(rows: DataFrame, group: str, size: str, tie: str, ascending: bool = False, name: str = "place") -> DataFrame:
    """rows with their places in their groups by size."""
    return with_places(rows, group, F.asc(size) if ascending else F.desc(size), F.asc(tie), name=name)


def group_places(rows: DataFrame, group: str, size: str, ascending: bool = False) -> DataFrame:
    """group, total_size, place of each group by its total size."""
    total = rows.groupBy(group).agg(F.sum(size).alias("total_size"))
    return with_ids(total, 0, F.asc("total_size") if ascending else F.desc("total_size"), F.asc(group), name="place")


def first_in_group(rows: DataFrame, group: str, position: str, name: str = "first_row") -> DataFrame:
    """rows with whether each begins its group in display order."""
    heads = rows.groupBy(group).agg(F.min(position).alias("head"), F.count(F.lit(1)).alias("n"))
    found = lookup(rows, materialize(heads, "firsts"), group, "n", position)
    return found.withColumn(name, F.col(position).eqNullSafe(F.col("found.head"))).drop("found")


#: Thumbnails that a list shows of a video.
THUMBNAILS = 4


def shown_thumbnails(paths: Column) -> Column:
    return F.slice(paths, 1, THUMBNAILS)


def report(rows: DataFrame, group: str = "group_id", tie: str = "id") -> DataFrame:
    """What a list of groups shows: a header row per group of two or more, and its members by size.

    rows has group, tie, path, size, bit_rate, width, height, avg_frame_rate,
    duration, video_codec, pix_fmt, profile and thumbnail_path.
    """
    shown = place_in_group(with_duplicates(rows, group, tie), group, "size", tie, name="position")
    per = shown.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("total"))
    heads = materialize(with_ids(per, 0, group, name="number"), "numbered-groups")
    columns = {
        "label": media.group_label(F.col("number"), F.col("members"), F.col("total")),
        "position": F.lit(0),
        "row_type": F.lit("group"),
    }
    header = heads.select(F.col(group), "number", *[c.alias(k) for k, c in columns.items()])
    body = lookup(shown, heads.select(group, "number", "members"), group, "members", tie).select(
        group,
        F.col("found.number").alias("number"),
        F.col("path").alias("label"),
        F.col("position").cast("int").alias("position"),
        F.lit("video").alias("row_type"),
        F.col(tie),
        media.size_label(F.col("size")).alias("size_text"),
        media.bit_rate_label(F.col("bit_rate")).alias("bit_rate_text"),
        media.resolution_label(F.col("width"), F.col("height")).alias("resolution"),
        F.format_string("%.2f fps", "avg_frame_rate").alias("frame_rate_text"),
        F.format_string("%d s", "duration").alias("duration_text"),
        F.concat_ws(" / ", media.or_unknown(F.col("video_codec")), media.or_unknown(F.col("pix_fmt")), media.or_unknown(F.col("profile"))).alias("codec"),
        shown_thumbnails(F.col("thumbnail_path")).alias("thumbnails"),
    )
    return header.unionByName(body, allowMissingColumns=True)
