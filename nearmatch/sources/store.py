"""The catalog of videos, hashes and groups: Parquet tables below one folder.

A table is a list of segments, folders of rows that were added at once, and of
folders of keys that were deleted; a read merges them: a row counts unless its
key was deleted after it was added. So an insert writes what it adds, a delete
writes keys, and an update writes keys and new rows, whatever the size of the
table. ``compact`` writes a table's rows as one segment again.

Commit files are numbered and never changed; the one of the highest number
lists the segments of every table. A change (``Change``) pins the commit that it
reads. Its files stand when its commit file does, which is made under its
number only if no other has that number, so of two writers one is first. The other
goes on behind if the tables that it read are as they were, and else raises
``Conflict``: nothing is lost, and nothing of it has happened.

``vacuum`` removes what no commit of the last hours names, and files of changes
that were cut off as long ago.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearmatch import schemas
from nearmatch.settings import SearchParams
from nearmatch.sources.shared import materialize

TABLES = {"video": schemas.VIDEO, "hash": schemas.HASH, "dup_group": schemas.DUP_GROUP, "dup_group_map": schemas.DUP_GROUP_MAP, "app_settings": schemas.APP_SETTINGS}
#: The column by which rows of a table are deleted.
KEYS = {"video": "id", "hash": "video_id", "dup_group": "group_id", "dup_group_map": "video_id", "app_settings": "id"}
#: Folders of a table from which compact writes it anew.
MANY = 64


class Conflict(OSError):
    """A table that a change read has been changed by another meanwhile."""


def upsert(old: DataFrame, new: DataFrame, key: str, whole: bool = False) -> DataFrame:
    """old with the columns of new where a row's key is in both; null in new keeps the old value, unless whole rows are written. No rows are added."""
    named = new.dropDuplicates([key]).select(F.col(key), F.lit(True).alias("_found"), *[F.col(c).alias(f"_new_{c}") for c in new.columns if c != key])
    joined = old.join(named, key, "left")

    def value(c: str) -> Column:
        changed = F.col("_found") if whole else F.col(f"_new_{c}").isNotNull()
        return F.when(changed, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*[value(c) if c != key and c in new.columns else F.col(c) for c in old.columns])


def put(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with the same key, or added."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def with_value(rows: DataFrame, key: str, wanted: int, column: str, value: int) -> DataFrame:
    """rows with a value in a column of the row with the wanted key."""
    changed = F.when(F.col(key) == wanted, F.lit(value)).otherwise(F.col(column))
    return rows.withColumn(column, changed)


def without(rows: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """rows whose key isn't among those gone."""
    return rows.join(gone.select(F.col(gone_key).alias(key)), key, "left_anti")


def known_members(groups: DataFrame, members: DataFrame, videos: DataFrame) -> DataFrame:
    """group_id, video_ids of each of groups(group_id): its members(group_id, video_id) among videos(id) in order; perhaps none."""
    known = members.join(videos.select(F.col("id").alias("video_id")), "video_id", "left_semi")
    found = known.groupBy("group_id").agg(F.sort_array(F.collect_list("video_id")).alias("video_ids"))
    none = F.array().cast(found.schema["video_ids"].dataType)
    return groups.select("group_id").distinct().join(found, "group_id", "left").withColumn("video_ids", F.coalesce("video_ids", none))


def with_ids(rows: DataFrame, start: int, *order: str | Column, name: str = "id") -> DataFrame:
    """rows with a number, counting on from start in an order, without a single-task sort of whole rows.

    Rows are written in range partitions, which are counted; a row's number is
    its place in its partition plus the rows of all partitions before. Ties
    get numbers in any order.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = materialize(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = placed.groupBy("_part").count().withColumn("_before", before).select("_part", "_before")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(F.broadcast(counts), "_part").withColumn(name, nth + F.col("_before") + start).drop("_part", "_before")


def copy_metadata(videos: DataFrame, source_id: int, target_id: int) -> DataFrame:
    """videos with all columns but id and path of the target's row taken from the source's."""
    keep = ("id", "path")
    src = videos.where(F.col("id") == source_id).select(*[F.col(c).alias(f"_s_{c}") for c in videos.columns if c not in keep]).limit(1)
    joined = videos.join(F.broadcast(src), F.col("id") == target_id, "left")
    has = F.col("id") == target_id
    return joined.select(*[F.col(c) if c in keep else F.when(has, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) for c in videos.columns])


def decode_hashes(blobs: DataFrame) -> DataFrame:
    """video_id, hashes of rows(video_id, hash_blob); rows without a whole number are dropped."""
    from nearmatch.functions.hashing import decode_blob

    return blobs.select("video_id", decode_blob(F.col("hash_blob")).alias("hashes")).where(F.size("hashes") > 0)


@dataclass
class State:
    """What a commit file says: for each table its entries, ["add" or "del", folder], in order; the highest id given so far; and the last detection's settings and tables."""

    number: int = 0
    tables: dict[str, list[list[str]]] = field(default_factory=dict)
    last_id: int = 0
    detected: dict | None = None

    @classmethod
    def parse(cls, number: int, text: str) -> State:
        d = json.loads(text)
        if "tables" not in d:  # of a store from before there were segments: one folder for each table
            return cls(number, {n: [["add", v]] for n, v in d.items()}, -1)
        return cls(number, d["tables"], d["last_id"], d.get("detected"))

    def text(self) -> str:
        return json.dumps({"tables": self.tables, "last_id": self.last_id, "detected": self.detected})

    def folders(self) -> set[tuple[str, str]]:
        return {(n, f) for n, entries in self.tables.items() for _, f in entries}


class Change:
    """Reads of one commit, and what is to be added, deleted and replaced; all of it stands after commit(), or nothing.

    Deletions come before additions, so that both together are an update.
    """

    def __init__(self, store: Store) -> None:
        self.store, self.base = store, store.state()
        self.seen: set[str] = set()
        self.last_id = self.base.last_id
        self.entries: dict[str, list[list[str]]] = {}
        self.replaced: set[str] = set()
        #: Settings of the detection that this change is, if it is one.
        self.detected: str | None = None

    def read(self, name: str) -> DataFrame:
        self.seen.add(name)
        return self.store.rows(self.base, name)

    def _write(self, name: str, kind: str, rows: DataFrame, schema: str) -> None:
        folder = f"{kind}-{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.struct(schema)]).write.parquet(f"{self.store.path}/{name}/{folder}")
        self.entries.setdefault(name, []).append([kind, folder])

    def add(self, name: str, rows: DataFrame) -> None:
        self._write(name, "add", rows, TABLES[name])

    def delete(self, name: str, keys: DataFrame, column: str) -> None:
        """Delete the rows whose key is in a column of keys."""
        kind = schemas.struct(TABLES[name])[KEYS[name]].dataType.simpleString()
        self._write(name, "del", keys.select(F.col(column).alias("key")).where("key IS NOT NULL").distinct(), f"key {kind}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """All rows of a table by others, which may be read from it."""
        self.replaced.add(name)
        self.add(name, rows)

    def new_ids(self, rows: DataFrame, *order: str) -> DataFrame:
        """rows with ids that no video ever had."""
        if self.base.last_id < 0:
            self.last_id = self.read("video").agg(F.max("id")).first()[0] or 0
        self.seen.add("video")
        numbered = with_ids(rows, self.last_id, *order)
        self.last_id += numbered.count()
        return numbered

    def commit(self) -> State:
        store = self.store
        while True:
            now = store.state()
            if moved := sorted(n for n in self.seen | self.replaced if now.tables.get(n) != self.base.tables.get(n)):
                raise Conflict(f"changed meanwhile: {', '.join(moved)}")
            tables = {n: ([] if n in self.replaced else now.tables.get(n, [])) + self.entries.get(n, []) for n in now.tables | self.entries}
            detected = now.detected if self.detected is None else {"settings": self.detected, "tables": tables}
            after = State(now.number + 1, tables, max(now.last_id, self.last_id), detected)
            if store.publish(after):
                return after


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self.log = self._hadoop(f"{self.path}/_commits")
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self.log.getFileSystem(self.conf)
        self.fs.mkdirs(self.log)

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _commits(self) -> list[str]:
        names = [x.getPath().getName() for x in self.fs.listStatus(self.log)]
        return sorted(n for n in names if n.endswith(".json"))

    def _parsed(self, name: str) -> State:
        stream = self.fs.open(self._hadoop(f"{self.path}/_commits/{name}"))
        try:
            return State.parse(int(name.removesuffix(".json")), bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def state(self) -> State:
        names = self._commits()
        return self._parsed(names[-1]) if names else State()

    def publish(self, state: State) -> bool:
        """Make a state's commit file, whole; false if there is one of its number.

        A local file system links a file that is written already, HDFS renames
        one: both refuse a name that is taken. Elsewhere the file is created
        under its name without overwriting; a store that checks this when the
        file is closed, as object stores with conditional writes do, keeps writers apart.
        """
        now = self._hadoop(f"{self.path}/_commits/{state.number:012d}.json")
        scheme = self.fs.getUri().getScheme()
        if scheme not in ("file", "hdfs", "viewfs"):
            return self._create(now, state.text())
        beside = self._hadoop(f"{self.path}/_commits/{uuid.uuid4().hex}.new")
        self._create(beside, state.text())
        try:
            if scheme == "file":
                local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(local(now), local(beside))
                return True
            return self.fs.rename(beside, now)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        finally:
            self.fs.delete(beside, False)

    def _create(self, path, text: str) -> bool:
        try:
            stream = self.fs.create(path, False)
            stream.write(bytearray(text.encode("utf-8")))
            stream.close()
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise

    def rows(self, state: State, name: str) -> DataFrame:
        """A table as a commit has it.

        Segments between two deletions are read together; rows meet the keys
        that were deleted after them in one anti-join.
        """
        schema, key = schemas.struct(TABLES[name]), KEYS[name]
        entries = [*state.tables.get(name, [])]
        if not any(kind == "add" for kind, _ in entries):
            return self.spark.createDataFrame([], schema)
        if all(kind == "add" for kind, _ in entries):
            return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/{f}" for _, f in entries])
        epoch, added, gone = 0, {}, {}
        for kind, folder in entries:
            if kind == "del":
                epoch += 1
            (added if kind == "add" else gone).setdefault(epoch, []).append(f"{self.path}/{name}/{folder}")

        def union(parts: dict[int, list[str]], kind) -> DataFrame:
            each = [self.spark.read.schema(kind).parquet(*folders).withColumn("_epoch", F.lit(e)) for e, folders in parts.items()]
            out = each[0]
            for x in each[1:]:
                out = out.unionByName(x)
            return out

        last = union(gone, f"key {schema[key].dataType.simpleString()}").groupBy("key").agg(F.max("_epoch").alias("_gone"))
        return union(added, schema).join(last, (F.col(key) == F.col("key")) & (F.col("_epoch") < F.col("_gone")), "left_anti").drop("_epoch")

    def read(self, name: str) -> DataFrame:
        return self.rows(self.state(), name)

    def since(self, change: Change, name: str) -> tuple[DataFrame, DataFrame] | None:
        """Rows added to a table and keys deleted from it since the last detection; none if its folders then aren't all there any more."""
        before, now = (change.base.detected or {"tables": {}})["tables"].get(name, []), change.base.tables.get(name, [])
        if now[: len(before)] != before:
            return None
        change.seen.add(name)
        new = now[len(before) :]
        schema = schemas.struct(TABLES[name])
        kinds = {"add": schema, "del": f"key {schema[KEYS[name]].dataType.simpleString()}"}
        folders = {k: [f"{self.path}/{name}/{f}" for kind, f in new if kind == k] for k in kinds}
        each = [self.spark.read.schema(kinds[k]).parquet(*folders[k]) if folders[k] else self.spark.createDataFrame([], kinds[k]) for k in kinds]
        return each[0], each[1]

    def change(self) -> Change:
        return Change(self)

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Replace tables, all of them or none."""
        change = self.change()
        for name, rows in tables.items():
            change.replace(name, rows)
        change.commit()

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace a table."""
        self.commit({name: rows})

    def compact(self, many: int = MANY) -> list[str]:
        """Write tables of that many folders or more as one segment each; which ones."""
        change = self.change()
        names = [n for n, entries in change.base.tables.items() if len(entries) >= many]
        for name in names:
            change.replace(name, change.read(name))
        if change.base.detected and change.base.detected["tables"] == change.base.tables:
            change.detected = change.base.detected["settings"]  # nothing has come since: it is the detection of what is written now
            change.seen.update(change.base.tables)
        if names:
            change.commit()
        return names

    def vacuum(self, hours: float = 24) -> None:
        """Remove folders that no commit of the last hours has named and that are as old, and older commit files."""
        before = time.time() * 1000 - hours * 3_600_000
        at = {x.getPath().getName(): x.getModificationTime() for x in self.fs.listStatus(self.log)}
        names = self._commits()
        # a commit was the last one until the next one stood
        live = [n for n, after in zip(names, [*names[1:], None]) if after is None or at[after] >= before]
        kept = set().union(*[self._parsed(n).folders() for n in live]) if live else set()
        for name in TABLES:
            root = self._hadoop(f"{self.path}/{name}")
            for x in self.fs.listStatus(root) if self.fs.exists(root) else []:
                if (name, x.getPath().getName()) not in kept and x.getModificationTime() < before:
                    self.fs.delete(x.getPath(), True)
        for n, t in at.items():
            if n not in live and (n.endswith(".json") or re.search(r"\.new(\.crc)?$", n)) and t < before:
                self.fs.delete(self._hadoop(f"{self.path}/_commits/{n}"), False)

    def insert_videos(self, rows: DataFrame) -> DataFrame:
        """Append rows without ids, in the order of their paths; returns what was added. Paths may occur twice."""
        change = self.change()
        names = [f.name for f in schemas.struct(schemas.VIDEO)]
        rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in names if c != "id"])
        change.add("video", change.new_ids(rows, "path").select(*names))
        change.commit()
        (entry,) = change.entries["video"]
        return self.spark.read.schema(schemas.struct(schemas.VIDEO)).parquet(f"{self.path}/video/{entry[1]}")

    def insert_hashes(self, rows: DataFrame) -> None:
        """Append video_id, hashes; empty ones are left out, and a video that has hashes keeps them."""
        change = self.change()
        new = rows.where(F.size("hashes") > 0).join(change.read("hash").select("video_id"), "video_id", "left_anti")
        change.add("hash", new.select("video_id", "hashes"))
        change.commit()

    def _rewrite(self, change: Change, name: str, rows: DataFrame) -> None:
        """Other rows for those with the same keys."""
        rows = materialize(rows, "rewritten")
        change.delete(name, rows, KEYS[name])
        change.add(name, rows)
        change.commit()

    def update_videos(self, rows: DataFrame) -> None:
        """Write whole rows over those with their ids; null is written too. Ids that no video has are passed over."""
        change = self.change()
        old = change.read("video").join(rows.select("id"), "id", "left_semi")
        self._rewrite(change, "video", upsert(old, rows, "id", whole=True))

    def set_link_count(self, video_id: int, n: int) -> None:
        change = self.change()
        self._rewrite(change, "video", with_value(change.read("video").where(F.col("id") == video_id), "id", video_id, "num_hard_links", n))

    def copy_metadata(self, source_id: int, target_id: int) -> None:
        change = self.change()
        both = change.read("video").where(F.col("id").isin(source_id, target_id))
        self._rewrite(change, "video", copy_metadata(both, source_id, target_id).where(F.col("id") == target_id))

    def delete_videos(self, ids: DataFrame) -> None:
        """Videos with their hashes and memberships, at once; their groups stay, perhaps empty."""
        change = self.change()
        for name in ("video", "hash", "dup_group_map"):
            change.delete(name, ids, "id")
        change.commit()

    def store_groups(self, groups: DataFrame, change: Change | None = None, settings: str | None = None) -> None:
        """Replace all groups by (group_id, video_id), groups of one included; both tables at once, from one evaluation of groups.

        With the change that groups were found in, they stand only if what it read still does.
        """
        change = change or self.change()
        change.detected = settings
        groups = materialize(groups, "groups")
        change.replace("dup_group", groups.select("group_id").distinct().withColumn("created_at", F.current_timestamp()))
        change.replace("dup_group_map", groups)
        change.commit()

    def load_groups(self) -> DataFrame:
        """group_id and its members' ids in order; members that are no videos any more are left out, groups stay."""
        return known_members(self.read("dup_group"), self.read("dup_group_map"), self.read("video"))

    def save_settings(self, params: SearchParams) -> None:
        row = self.spark.createDataFrame([(1, params.to_json())], schemas.APP_SETTINGS)
        change = self.change()
        self._rewrite(change, "app_settings", row)

    def load_settings(self) -> SearchParams:
        row = self.read("app_settings").where("id = 1").first()
        return SearchParams.from_json(row["settings_json"] if row else None)


def read_config(path: str) -> str | None:
    """dbPath of a config file, if it is a text that isn't empty."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f).get("dbPath")
    except (OSError, ValueError, AttributeError):
        return None
    return found if isinstance(found, str) and found else None


def write_config(path: str, db_path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"dbPath": db_path}, f)
