"""WARC archives: a writer, and a reader that splits files anywhere.

Both are Spark data sources (format "warc"). The writer puts each record in a
gzip member of its own; a task writes files of about ``FILE_BYTES``, under
names that no other attempt uses, and the commit file names those of the
attempts that counted. Only these are read again; a folder without a commit
file is read as it is, so archives of others are too.

The reader cuts every file into byte ranges. A task looks for the first gzip
magic at or after its range's start, and takes it for a member only if it
inflates to the header of a WARC record. From there members follow each other:
it owns every record whose member starts inside its range, and reads the last
of them to the end, beyond the range if need be. The inflated bytes pass gzip's
checksum, and payloads their record's digest. Where a member is followed by
something else, the task looks for magic again.

A member may hold, uncompressed, an archive of its own. A range that starts
inside such a member would take the inner records for the file's; these lie
within a member that an earlier range has read, by which ``outer`` finds and
leaves them out: range by range, without a shuffle of the records.

Copies: of the records with equal payloads of at least ``LEAST`` bytes that of
the smallest page_id is the response, the others are revisits: they hold the
HTTP header and the digest of the payload, and name the response.

Defined results: null html is an empty payload, and a null url leaves its field
out; white space and control characters in a url are percent-encoded; repeated
page_ids are records of their own, and of equal ones with equal payloads any is
the response; a null page_id comes after all others; an empty table gives an
archive without records; columns besides page_id, url and html are ignored. A
record that is cut off or damaged is an error, unless onError is skip: then
reading goes on at the next record.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha1, sha256
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from nearmatch.llm.common import lookup, materialize, numbered, own, table, text_batches
from nearmatch.sources.shared import goes_at_exit, shared_path

#: Shorter payloads are never revisits.
LEAST = 100
#: Bytes from which a task starts another file, and of a range that one task reads.
FILE_BYTES = 1 << 30
SPLIT_BYTES = 16 << 20
#: Bytes of one read, of those inflated at a time, of a record header at most, and of a batch that goes to Spark.
CHUNK = 1 << 20
INPUT = 1 << 15
HEADER_BYTES = 1 << 16
BATCH_BYTES = 4 << 20

MAGIC = b"\x1f\x8b\x08"
DATE = "2000-01-01T00:00:00Z"
#: Fixed value: the profile of revisits that are known by their payload's digest.
SAME_DIGEST = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"
SCHEMA = f"file string, range_start long, offset long, length long, {RECORD}, headers map<string,string>"


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it, by Arrow: tasks have no Hadoop client in Python."""
    path = re.sub(r"^file:/+", "/", path)
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def record(fields: list[tuple[str, str | None]], http: list[tuple[str, str]], payload: bytes) -> bytes:
    """A WARC record with an HTTP response, of which fields without a value are left out."""
    block = b"HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in http).encode() + b"\r\n" + payload
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, level: int, file_bytes: int, date: str, overwrite: bool) -> None:
        self.path, self.level, self.file_bytes, self.date, self.overwrite = path, level, file_bytes, date, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        files: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size >= self.file_bytes:
                        if out is not None:
                            out.close()
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                    data = member(self._record(row), self.level)
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def _record(self, row: dict) -> bytes:
        uri = row["target_uri"]
        revisit = row["record_type"] == "revisit"
        fields = [
            ("WARC-Type", row["record_type"]),
            ("WARC-Record-ID", f"<{row['record_id']}>"),
            ("WARC-Date", self.date),
            ("WARC-Target-URI", None if uri is None else re.sub(r"[\s\x00-\x20\x7f]", lambda m: quote(m[0]), uri)),
            ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
            ("WARC-Refers-To", f"<{row['refers_to']}>" if revisit else None),
            ("WARC-Profile", SAME_DIGEST if revisit else None),
        ]
        http = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(row["payload_bytes"]))]
        return record(fields, http, b"" if revisit else row["payload"] or b"")

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        names = [x.base_name for x in fs.get_file_info(arrow_fs.FileSelector(root))]
        with fs.open_output_stream(f"{root}/_commit-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([n for m in messages if m for n in m.files]).encode())
        if self.overwrite:
            for name in names:
                if re.match(r"_commit-|part-", name) and name not in {n for m in messages if m for n in m.files}:
                    fs.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        for name in (n for m in messages if m for n in m.files):
            fs.delete_file(f"{root}/{name}")


class Damaged(ValueError):
    """Bytes that are no whole WARC record."""


class Source:
    """A file's bytes from any place, read in chunks and dropped once passed."""

    def __init__(self, f: pa.NativeFile) -> None:
        self.f, self.base, self.held = f, 0, b""

    def at(self, offset: int, n: int) -> bytes:
        """n bytes from offset, fewer at the end of the file."""
        if not self.base <= offset <= self.base + len(self.held):
            self.base, self.held = offset, b""
        if offset + n > self.base + len(self.held):
            self.base, self.held = offset, self.held[offset - self.base :]
            self.f.seek(offset + len(self.held))
            self.held += self.f.read(max(CHUNK, n - len(self.held)))
        return self.held[offset - self.base : offset - self.base + n]


class Inflated:
    """The bytes of the gzip member at an offset, as they are asked for."""

    def __init__(self, source: Source, offset: int) -> None:
        self.source, self.next = source, offset
        self.z, self.held = zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.z.eof:
            return False
        data = self.z.unconsumed_tail
        if not data:
            data = self.source.at(self.next, INPUT)
            self.next += len(data)
        try:
            out = self.z.decompress(data, CHUNK)
        except zlib.error as e:
            raise Damaged(str(e)) from e
        if not (data or out or self.z.eof):
            raise Damaged("the file ends within a member")
        self.held += out
        self.next -= len(self.z.unused_data)
        return True

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        if len(self.held) < n:
            raise Damaged("the member ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def until(self, end: bytes, most: int) -> bytes:
        while (at := self.held.find(end)) < 0:
            if len(self.held) > most or not self._more():
                raise Damaged("no end of a header")
        return self.take(at + len(end))

    def ended(self) -> bool:
        """Whether nothing but line ends is left."""
        while True:
            while self.held[:1] in (b"\r", b"\n"):
                del self.held[:1]
            if self.held or not self._more():
                return not self.held


def fields_of(lines: bytes) -> dict[str, str]:
    """Named fields; a line that starts with white space goes on with the one before."""
    text = re.sub(r"\r?\n[ \t]+", " ", lines.decode("utf-8", "replace"))
    pairs = (line.partition(":") for line in text.split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def record_head(data: Inflated) -> dict[str, str]:
    head = data.until(b"\r\n\r\n", HEADER_BYTES)
    if not re.match(rb"WARC/\d+\.\d+\r\n", head):
        raise Damaged("no WARC version")
    found = fields_of(head)
    if "warc-type" not in found or not found.get("content-length", "").isdigit():
        raise Damaged("a record without type or length")
    return found


def is_member(source: Source, offset: int) -> bool:
    """Whether the magic at offset begins a member that inflates to a record's header."""
    try:
        return bool(record_head(Inflated(source, offset)))
    except Damaged:
        return False


def next_member(source: Source, offset: int, end: int) -> int:
    """The first member that starts at or after offset and before end; end if there is none."""
    while offset < end:
        data = source.at(offset, min(CHUNK, end - offset + len(MAGIC) - 1))
        at = data.find(MAGIC)
        if at < 0 or offset + at >= end:
            offset += max(1, len(data) - len(MAGIC) + 1)
        elif is_member(source, offset + at):
            return offset + at
        else:
            offset += at + 1
    return end


def checked_payload(head: dict[str, str], block: bytes) -> tuple[bytes, int | None]:
    """The payload of a record's block, whose digest has to be that of the header if there is one, and the length that its HTTP header gives."""
    payload, length = block, None
    if head.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        n = fields_of(http).get("content-length", "")
        length = int(n) if n.isdigit() else None
    kind, _, value = head.get("warc-payload-digest", "").partition(":")
    if head["warc-type"].lower() == "response" and kind.lower() in ("sha256", "sha1"):
        now = (sha256 if kind.lower() == "sha256" else sha1)(payload)
        if value.lower() not in (now.hexdigest(), b32encode(now.digest()).decode().lower()):
            raise Damaged("the payload's digest is another")
    return payload, length


def read_range(source: Source, start: int, end: int, skip: bool) -> Iterator[dict]:
    """The records whose members start in [start, end)."""
    at = next_member(source, start, end)
    while at < end:
        try:
            rows, data = [], Inflated(source, at)
            while not data.ended():
                head = record_head(data)
                payload, length = checked_payload(head, data.take(int(head["content-length"])))
                kind, _, value = head.get("warc-payload-digest", "").partition(":")
                whole = head["warc-type"].lower() != "revisit"
                ours = whole and not (kind == "sha256" and len(value) == 64)
                row = {"record_id": head.get("warc-record-id", "").strip("<>"), "record_type": head["warc-type"], "target_uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to", "").strip("<>") or None}
                rows.append(row | {"offset": at, "payload_bytes": len(payload) if whole else length, "payload_digest": sha256(payload).hexdigest() if ours else value, "payload": payload, "headers": list(head.items())})
        except Damaged as e:
            if not skip:
                raise Damaged(f"at byte {at}: {e}") from e
            at = next_member(source, at + 1, end)
            continue
        for row in rows:
            yield row | {"length": data.next - at}
        at = data.next
        if at < end and source.at(at, len(MAGIC)) != MAGIC:
            at = next_member(source, at, end)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


_ARROW = pa.schema(
    [
        ("file", pa.string()), ("range_start", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
        ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("headers", pa.map_(pa.string(), pa.string())),
    ]
)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, split: int, payloads: bool, skip: bool) -> None:
        self.path, self.split, self.payloads, self.skip = path, split, payloads, skip

    def partitions(self) -> list[Range]:
        fs, root = file_system(self.path)
        found = fs.get_file_info(root)
        if found.type == arrow_fs.FileType.File:
            return self._ranges(found)
        infos = {x.base_name: x for x in fs.get_file_info(arrow_fs.FileSelector(root))}
        if commits := [x for n, x in infos.items() if n.startswith("_commit-")]:
            names = []
            for x in commits:
                with fs.open_input_stream(x.path) as f:
                    names += json.loads(f.read())
        else:
            names = [n for n in infos if n.endswith(".warc.gz")]
        return [r for n in sorted(names) for r in self._ranges(infos[n])]

    def _ranges(self, info: arrow_fs.FileInfo) -> list[Range]:
        return [Range(info.path, at, min(at + self.split, info.size)) for at in range(0, info.size, self.split)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no file
            return
        fs, _ = file_system(self.path)
        rows: list[dict] = []
        held = 0
        with fs.open_input_file(partition.file) as f:
            for row in read_range(Source(f), partition.start, partition.end, self.skip):
                held += len(row["payload"]) + 1000 if self.payloads else 1000
                rows.append(row | {"file": partition.file, "range_start": partition.start} | ({} if self.payloads else {"payload": None}))
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class WarcSource(DataSource):
    """Format "warc". Options of reads: splitBytes, payload (false leaves it null), onError (raise or skip); of writes: level, fileBytes, date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        o = self.options
        return WarcReader(o["path"], int(o.get("splitBytes", SPLIT_BYTES)), o.get("payload", "true") == "true", o.get("onError", "raise") == "skip")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        o = self.options
        return WarcWriter(o["path"], int(o.get("level", 6)), int(o.get("fileBytes", FILE_BYTES)), o.get("date", DATE), overwrite)


def outer(records: DataFrame) -> DataFrame:
    """records without those that lie inside a member of an earlier range. records should be a written table: they are read twice."""
    ends = records.groupBy("file", "range_start").agg(F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("end"))
    before = Window.partitionBy("file").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    late = ends.withColumn("until", F.max("end").over(before)).where("first < until").select("file", "range_start", "until")
    late = materialize(late, "inner")
    if late.isEmpty():
        return records
    return records.join(late, ["file", "range_start"], "left").where("until IS NULL OR offset >= until").drop("until")


def page_records(pages: DataFrame) -> DataFrame:
    """The record of each of pages(page_id, url, html): columns of RECORD. Revisits have no payload."""
    row = own("row")
    rows = numbered(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")), "page_id")
    rows = rows.withColumn("sha", F.unhex(F.sha2("html", 256))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    number = F.when(F.col("page_id").eqNullSafe(F.col(row)), "").otherwise(F.concat(F.lit(":"), F.col(row).cast("string")))
    rows = rows.withColumn("record_id", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), number))
    first = F.min_by(F.struct(F.col(row).alias("row"), "record_id"), F.struct(F.col("page_id").isNull(), "page_id", row))
    copies = rows.where(F.col("payload_bytes") >= LEAST).groupBy("sha").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = materialize(copies.select("sha", F.col("first.row").alias("row"), F.col("first.record_id").alias("response"), "n"), "responses")
    tagged = lookup(rows, copies, "sha", "n", row)
    revisit = F.col("found").isNotNull() & (F.col(row) != F.col("found.row"))
    return tagged.select(
        "record_id",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, F.col("found.response")).alias("refers_to"),
        "payload_bytes",
        F.lower(F.hex("sha")).alias("payload_digest"),
        F.when(~revisit, F.col("html").cast("binary")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str, **options: str) -> None:
    """Write columns of RECORD as WARC files below path."""
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").options(**options).save(path)


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records below path: columns of SCHEMA. See ``outer`` for archives within archives."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(path)


def page_of(record_id: str) -> Column:
    return F.regexp_extract(record_id, "^urn:page:(-?[0-9]+)", 1).try_cast("long")


SQL = """
SELECT page_id, n AS payload_bytes, sha AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS sha, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    path = shared_path(spark, "warc")
    write_warc(page_records(table(spark, sf_dir, "pages")), path)
    goes_at_exit(spark, path)
    records = read_warc(spark, path, payload="false").drop("payload", "headers")
    records = outer(materialize(records, "records"))
    return records.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))
