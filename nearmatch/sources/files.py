"""Directory scans as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyarrow import fs as arrow_fs
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmatch import schemas
from nearmatch.functions.media import local_time, normal_path
from nearmatch.sources.shared import materialize


def recursive_for(root: str, directories: Iterable[tuple[str, bool]]) -> bool:
    """Whether a root is scanned with its folders: what the first entry for it says; yes if there is none."""
    return next((r for p, r in directories if p == root), True)


def check_roots(spark: SparkSession, roots: Iterable[str]) -> tuple[list[str], list[str]]:
    """Roots that exist, and an error line for each other one. Looks through Spark's file systems."""
    good, errors = [], []
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(conf)
        if fs.exists(path) and fs.getFileStatus(path).isDirectory():
            good.append(root)
        else:
            errors.append(f"not a directory: {root}")
    return good, errors


def _mounted(folder: str) -> Iterator[tuple[str, int, int, bool]]:
    with os.scandir(folder) as found:
        for x in found:
            try:
                if x.is_dir(follow_symlinks=False):
                    yield x.path, 0, 0, True
                elif x.is_file():
                    s = x.stat()
                    yield x.path, s.st_size, int(s.st_mtime), False
            except OSError:
                continue


def _remote(folder: str) -> Iterator[tuple[str, int, int, bool]]:
    folder = folder.rstrip("/")
    fs, path = arrow_fs.FileSystem.from_uri(folder)
    store = folder[: len(folder) - len(path)]
    for x in fs.get_file_info(arrow_fs.FileSelector(path)):
        if x.type in (arrow_fs.FileType.File, arrow_fs.FileType.Directory):
            yield store + x.path, x.size or 0, int((x.mtime_ns or 0) // 1_000_000_000), x.type == arrow_fs.FileType.Directory


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What stands in each folder: path, size, seconds of its last change, and whether it is a folder. Folders that can't be read are passed over."""
    for pdf in batches:
        rows: list[tuple[str, int, int, bool]] = []
        for folder in pdf["folder"]:
            try:
                rows += _mounted(folder) if folder.startswith("/") else _remote(folder)
            except OSError:
                continue
        yield pd.DataFrame(rows, columns=["path", "size", "seconds", "folder"]).astype({"size": "int64", "seconds": "int64", "folder": "bool"})


def opened_by_tasks(root: str) -> bool:
    """Whether Python tasks can list a root: a mounted folder, or a store that Arrow knows, such as s3, gs, abfs, or hdfs where its library is installed."""
    if root.startswith("/"):
        return True
    try:
        arrow_fs.FileSystem.from_uri(root)
        return True
    except (OSError, ValueError, NotImplementedError):
        return False


def _walk(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    """path, size, seconds of the files of a folder that tasks can list. One job for each level of folders, whose folders are dealt over the executors."""
    kind, empty = "path string, size long, seconds long, folder boolean", "path string, size long, seconds long"
    files = spark.createDataFrame([], empty)
    folders = spark.createDataFrame([(root,)], "folder string")
    while True:
        level = materialize(folders.mapInPandas(_listed, kind), "listing")
        files = files.unionByName(level.where("NOT folder").drop("folder"))
        below = level.where("folder").select(F.col("path").alias("folder"))
        if not recursive or below.isEmpty():
            return files
        folders = below.repartition("folder")


def _walk_hadoop(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    """The same for a folder that only Spark's file systems open, of which Python tasks know nothing: listed by the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    rows, folders = [], [path]
    while folders:
        folder = folders.pop()
        try:
            found = list(fs.listStatus(folder))
        except (PySparkException, Py4JJavaError):
            if folder is path:
                raise
            continue
        for x in found:
            if x.isFile():
                rows.append((x.getPath().toString(), x.getLen(), x.getModificationTime() // 1000))
            elif recursive and x.isDirectory():
                folders.append(x.getPath())
    return spark.createDataFrame(rows, "path string, size long, seconds long")


def scan(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, size, modified_at of the files in root, and in all folders below it if recursive.

    Whatever their names: hidden files and folders count. Links to files count
    as files, links to folders aren't followed; folders that can't be read are
    passed over; an empty root has no files. Contents are not read.
    """
    local = root.removeprefix("file:")
    root = "/" + local.lstrip("/") if local.startswith("/") else root
    files = (_walk if opened_by_tasks(root) else _walk_hadoop)(spark, root, recursive)
    return files.select(normal_path(F.col("path")).alias("path"), "size", local_time(F.timestamp_seconds("seconds")).alias("modified_at"))


def scan_all(spark: SparkSession, roots: Iterable[str], directories: Iterable[tuple[str, bool]] = ()) -> DataFrame:
    """The scans of all roots; a path that two roots share counts once."""
    directories = list(directories)
    out = spark.createDataFrame([], "path string, size long, modified_at string")
    for root in roots:
        out = out.unionByName(scan(spark, root, recursive_for(root, directories)))
    return union_directories([out])


def union_directories(scans: list[DataFrame]) -> DataFrame:
    """One table of all scans, each path once."""
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    return out.dropDuplicates(["path"])


def with_identity(files: DataFrame) -> DataFrame:
    """The file table: adds inode, device and link count. Files of a mounted folder that can't be asked are left out; files of other stores have 0, 0 and 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for path in pdf["path"]:
                try:
                    s = os.stat(path) if path.startswith("/") else None
                    found.append((s.st_ino, s.st_dev, s.st_nlink) if s else (0, 0, 1))
                except OSError:
                    found.append(None)
            known = [x is not None for x in found]
            pdf, found = pdf[known], [x for x in found if x is not None]
            inode, device, links = zip(*found) if found else ((), (), ())
            yield pd.DataFrame({"path": pdf["path"], "size": pdf["size"], "inode": inode, "device": device, "num_hard_links": links, "modified_at": pdf["modified_at"]})

    return files.select("path", "size", "modified_at").mapInPandas(run, schemas.FILE)
