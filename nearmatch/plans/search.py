"""The whole search: scan, filter, skip known files, probe, hash, detect, store."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmatch.functions.media import or_default_thumbnail
from nearmatch.operators import filters, groups, similarity
from nearmatch.operators.components import connected_components
from nearmatch.settings import SearchParams
from nearmatch.sources import files as scans
from nearmatch.sources.probe import Adapter, hash_videos, probe_files
from nearmatch.sources.shared import materialize
from nearmatch.sources.store import Change, State, Store


def find_duplicates(videos: DataFrame, hashes: DataFrame, params: SearchParams, strategy: str = "auto") -> DataFrame:
    """group_id, video_id of every video: components of the pairs with enough matching hashes.

    hashes has video_id and h, one row for each hash.
    """
    return groups.membership(videos, similarity.linked_classes(hashes, params, strategy))


def detection(params: SearchParams) -> str:
    """What groups depend on besides hashes."""
    return json.dumps([params.radius, *params.required])


def redetect(store: Store, change: Change, params: SearchParams) -> DataFrame | None:
    """group_id, video_id of every video, as find_duplicates has it, from the groups of the last detection and what has come and gone since.

    Two videos are linked or not by their own hashes alone. So new hashes are
    compared with all, and nothing else with anything, but the members of
    groups that lost one, which are compared with each other. Links to videos of
    groups that stay are links to the groups. None where the last detection had
    other settings, or its tables have been written anew.
    """
    if (change.base.detected or {}).get("settings") != detection(params):
        return None
    hashes, videos, groups_of = (store.since(change, name) for name in ("hash", "video", "dup_group_map"))
    if hashes is None or videos is None or groups_of is None:
        return None
    now = change.read("video").select(F.col("id").alias("video_id"))
    before = store.rows(State(0, change.base.detected["tables"]), "dup_group_map")
    rehashed = hashes[1].select(F.col("key").alias("video_id"))
    lost = before.join(now, "video_id", "left_anti").select("video_id").unionByName(rehashed)
    broken = materialize(before.join(lost, "video_id", "left_semi").select("group_id").distinct(), "broken-groups")
    fresh = hashes[0].select("video_id").unionByName(now.join(before, "video_id", "left_anti")).distinct()
    fresh = materialize(fresh.join(now, "video_id", "left_semi"), "fresh-videos")
    left = before.join(now, "video_id", "left_semi").join(fresh, "video_id", "left_anti")
    stay = left.join(broken, "group_id", "left_anti")
    apart = materialize(left.join(broken, "group_id", "left_semi").select("video_id").unionByName(fresh), "to-compare")

    every = change.read("hash").select("video_id", F.explode("hashes").alias("h"))
    among = similarity.linked_classes(every.join(apart, "video_id", "left_semi"), params)
    new, old = every.join(fresh, "video_id", "left_semi"), every.join(stay.select("video_id"), "video_id", "left_semi")
    counts = similarity.match_counts(similarity.hamming_pairs_across(new, old, params.radius))
    kind, value = params.required
    sizes = new.unionByName(old)
    across = similarity.edges(counts, sizes, percent=value) if kind == "percent" else similarity.edges(counts, sizes, number=int(value))
    onto = across.select("src", F.col("dst").alias("video_id")).join(stay, "video_id").select("src", F.col("group_id").alias("dst"))
    found = connected_components(among.select("src", "dst").unionByName(onto).distinct(), small=groups.SMALL_GRAPH)
    found = materialize(found, "merged")
    mapped = stay.unionByName(apart.select(F.col("video_id").alias("group_id"), "video_id"))
    joined = mapped.join(found, mapped["group_id"].cast("long") == found["id"], "left")
    return joined.select(F.coalesce("component", F.col("group_id").cast("long")).cast("int").alias("group_id"), "video_id")


def store_changes(store: Store, change: Change, found: DataFrame, params: SearchParams) -> None:
    """Groups found by redetect in place of those stored, of which only what differs is written."""
    found = materialize(found, "groups")
    now = change.read("dup_group_map")
    moved = materialize(found.join(now, ["group_id", "video_id"], "left_anti"), "moved")
    gone = now.join(found, ["group_id", "video_id"], "left_anti").select("video_id")
    change.delete("dup_group_map", gone.unionByName(moved.select("video_id")), "video_id")
    change.add("dup_group_map", moved)
    heads, known = found.select("group_id").distinct(), change.read("dup_group").select("group_id")
    new = heads.join(known, "group_id", "left_anti").withColumn("created_at", F.current_timestamp())
    change.delete("dup_group", known.join(heads, "group_id", "left_anti"), "group_id")
    change.add("dup_group", new)
    change.detected = detection(params)
    change.commit()


def detect(store: Store, params: SearchParams) -> DataFrame:
    """The groups of all stored videos, which are stored: by what has changed since the last detection, or from all hashes."""
    change = store.change()
    found = redetect(store, change, params)
    if found is not None:
        store_changes(store, change, found, params)
    else:
        hashes = change.read("hash").select("video_id", F.explode("hashes").alias("h"))
        found = materialize(find_duplicates(change.read("video"), hashes, params), "groups")
        store.store_groups(found, change, detection(params))
    return store.read("dup_group_map")


def unseen(files: DataFrame, known: DataFrame) -> DataFrame:
    return files.join(known.select("path"), "path", "left_anti")


def known_counts(files: DataFrame, known: DataFrame) -> DataFrame:
    """found, known, new: how many of files(path) there are, and are among known(path) or not."""
    marks = known.select("path").distinct().withColumn("k", F.lit(True))
    joined = files.select("path").join(marks, "path", "left")
    return joined.agg(F.count(F.lit(1)).alias("found"), F.count("k").alias("known"), F.count_if(F.col("k").isNull()).alias("new"))


#: Files named in Progress.errors.
SHOWN = 100


@dataclass
class Progress:
    """Counts of a search, and what went wrong."""

    found: int = 0
    new: int = 0
    probed: int = 0
    hashed: int = 0
    failed: int = 0
    errors: list[str] = field(default_factory=list)
    #: All files that can't be probed, of which errors names SHOWN; a table in the shared folder, gone when the application ends.
    failures: DataFrame | None = None


def ingest(spark: SparkSession, store: Store, files: DataFrame, params: SearchParams, adapter: Adapter, progress: Progress) -> None:
    """Add files to the store: probe, keep what is a video, sample, hash. A file whose hashing fails is known afterwards."""
    probed = materialize(probe_files(files, adapter), "probed")
    progress.failures = materialize(probed.where("NOT ok"), "failed")
    progress.failed = progress.failures.count()
    progress.errors += [f"cannot read {r['path']}" for r in progress.failures.select("path").orderBy("path").limit(SHOWN).collect()]
    if progress.failed > SHOWN:
        progress.errors.append(f"cannot read {progress.failed - SHOWN} more files, {progress.failed} in all")
    good = filters.valid_probe(probed.where("ok"))
    progress.probed = good.count()
    if not progress.probed:
        return
    added = store.insert_videos(good.withColumn("thumbnail_path", or_default_thumbnail(F.array().cast("array<string>"))))
    arrays = hash_videos(added, adapter, params).where("NOT fatal AND size(hashes) > 0").select("video_id", "hashes")
    arrays = materialize(arrays, "hashes")
    progress.hashed = arrays.count()
    store.insert_hashes(arrays)


def search(spark: SparkSession, store: Store, params: SearchParams, adapter: Adapter) -> tuple[DataFrame, Progress]:
    """Run a search; returns the groups, which are stored too. The groups are always those of all stored hashes (see ``detect``); detection is in vain (``Conflict``) if these change meanwhile."""
    progress = Progress()
    roots, errors = scans.check_roots(spark, [p for p, _ in params.directories])
    progress.errors += errors
    files = materialize(filters.accept_files(scans.scan_all(spark, roots, params.directories), params), "files")
    progress.found = files.count()
    new = materialize(scans.with_identity(unseen(files, store.read("video"))), "new")
    progress.new = new.count()
    if progress.new:
        ingest(spark, store, new, params, adapter, progress)
    found = detect(store, params)
    store.compact()
    return found, progress
