"""Actions on groups, as plans: nothing is linked or deleted until a plan is applied."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmatch.operators.joins import lookup
from nearmatch.sources.shared import materialize

#: What a linked file takes over from its source; pixel format, profile and level are not among it.
COPIED = ("size", "bit_rate", "video_codec", "audio_codec", "width", "height", "duration", "avg_frame_rate", "sample_rate_avg", "modified_at")


def hardlink_plan(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """rows(group, video_id, position, selected, inode, device) with source_id, action and new_links.

    Of each group with two selected members or more, the first selected one is
    the source; other selected members are linked to it, unless they are the
    same file already. Members that are the source's file afterwards, selected
    or not, get their number as link count. Sources and counts are found where
    a group's rows are, and go back beside them: a group may have any number of rows.
    """
    chosen = F.col("selected")
    source = F.min_by(F.struct("video_id", "inode", "device"), F.when(chosen, F.col("position")))
    of_group = rows.groupBy(group).agg(F.when(F.count_if(chosen) >= 2, source).alias("s"), F.count(F.lit(1)).alias("n"))
    found = lookup(rows, materialize(of_group, "sources"), group, "n", "video_id").withColumnRenamed("found", "_f")
    s = F.col("_f.s")
    same = (F.col("inode") == s["inode"]) & (F.col("device") == s["device"])
    action = (
        F.when(s.isNull(), F.lit("none"))
        .when(F.col("video_id") == s["video_id"], F.lit("source"))
        .when(chosen & same, F.lit("already"))
        .when(chosen, F.lit("link"))
        .otherwise(F.lit("none"))
    )
    acted = found.withColumn("action", action).withColumn("_same", F.coalesce(same, F.lit(False)) | (F.col("action") == "link"))
    acted = materialize(acted.withColumn("source_id", s["video_id"]).drop("_f"), "actions")
    links = acted.groupBy(group).agg(F.count_if("_same").alias("links"), F.count(F.lit(1)).alias("n"))
    linked = lookup(acted, materialize(links, "links"), group, "n", "video_id")
    return linked.select(*rows.columns, "source_id", "action", F.when(F.col("_same"), F.col("found.links")).cast("long").alias("new_links"))


def updated_videos(videos: DataFrame, plan: DataFrame) -> DataFrame:
    """videos as they are after a plan: link counts, and for linked rows the source's file and metadata, without thumbnails."""
    src = videos.select(F.col("id").alias("_sid"), *[F.col(c).alias(f"_s_{c}") for c in (*COPIED, "inode", "device")])
    p = plan.select(F.col("video_id").alias("id"), "source_id", "action", "new_links")
    joined = videos.join(p, "id", "left").join(src, F.col("source_id") == F.col("_sid"), "left")
    linked, changed = F.col("action") == "link", F.col("new_links").isNotNull()
    values = {c: F.when(changed & F.col("_sid").isNotNull(), F.col(f"_s_{c}")).otherwise(F.col(c)) for c in COPIED}
    values |= {c: F.when(linked, F.col(f"_s_{c}")).otherwise(F.col(c)) for c in ("inode", "device")}
    values["num_hard_links"] = F.coalesce(F.col("new_links").cast("int"), F.col("num_hard_links"))
    values["thumbnail_path"] = F.when(linked, F.array().cast("array<string>")).otherwise(F.col("thumbnail_path"))
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in videos.columns])


def delete_plan(videos: DataFrame, selected: DataFrame, mode: str = "list") -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes): mode says how far: list, database (``Store.delete_videos``) or disk (``delete_files`` first). Applying it is the caller's."""
    if mode not in ("list", "database", "disk"):
        raise ValueError(f"unknown mode: {mode}")
    gone = selected_rows(videos, selected).withColumn("mode", F.lit(mode))
    return videos.join(selected.select("id"), "id", "left_anti"), gone


def selected_rows(rows: DataFrame, chosen: DataFrame, key: str = "id") -> DataFrame:
    """rows whose key is among those chosen."""
    return rows.join(chosen.select(key), key, "left_semi")


def delete_files(gone: DataFrame) -> DataFrame:
    """Remove the files of what goes (id, path) from disk, where the files are; id and error, null if it went well or there was no file.

    Rows of files that can't be removed are for the caller to report; they go from the tables as the others do.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors = []
            for path in pdf["path"]:
                try:
                    if path:
                        os.remove(path)
                    errors.append(None)
                except FileNotFoundError:
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
            yield pd.DataFrame({"id": pdf["id"], "error": errors})

    return gone.select(F.col("id").cast("long"), "path").mapInPandas(run, "id long, error string")


def replace_by_link(source: str, target: str) -> None:
    """Make target a hard link of source in one step: link beside it, then rename over it."""
    beside = f"{target}.{uuid.uuid4().hex}.link"
    os.link(source, beside)
    try:
        os.replace(beside, target)
    except OSError:
        os.unlink(beside)
        raise


def apply_hardlinks(plan_with_paths: DataFrame) -> DataFrame:
    """Link the rows (video_id, path, source_path) of a plan with action link, where the files are; video_id and error, null if it went well."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors = []
            for path, source in zip(pdf["path"], pdf["source_path"]):
                try:
                    replace_by_link(source, path)
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
            yield pd.DataFrame({"video_id": pdf["video_id"], "error": errors})

    rows = plan_with_paths.where("action = 'link'").select(F.col("video_id").cast("long"), "path", "source_path")
    return rows.mapInPandas(run, "video_id long, error string")
