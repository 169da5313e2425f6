"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

FILE = "path string, size long, inode long, device long, num_hard_links int, modified_at string"
VIDEO = (
    "id int, path string, modified_at string, video_codec string, audio_codec string, pix_fmt string, profile string, level int, "
    "width int, height int, duration int, size long, bit_rate int, num_hard_links int, inode long, device long, "
    "sample_rate_avg int, avg_frame_rate double, thumbnail_path array<string>"
)
HASH = "video_id int, hashes array<bigint>"
HASH_BLOB = "video_id int, hash_blob binary"
HASH_LONG = "video_id int, pos int, h long"
DUP_GROUP = "group_id int, created_at timestamp"
DUP_GROUP_MAP = "group_id int, video_id int"
FRAME = "video_id int, pts long, tb_num int, tb_den int, w int, h int, luma binary, key boolean, fatal boolean"
#: One row at most; declared for parity with no reader or writer.
HARDWARE_FILTER = "id int, path string"

_FAST = "struct<maxFrames:int,hammingDistance:int,matchingThreshold:bigint,useKeyframesOnly:boolean>"
_SLOW = "struct<skipPercent:int,maxFrames:int,hammingDistance:int,usePercentThreshold:boolean,matchingThresholdPct:double,matchingThresholdNum:bigint,useKeyframesOnly:boolean>"
SETTINGS = (
    "useGlob boolean, caseInsensitive boolean, extensions array<string>, includeFilePatterns array<string>, includeDirPatterns array<string>, "
    "excludeFilePatterns array<string>, excludeDirPatterns array<string>, directories array<struct<path:string,recursive:boolean>>, "
    f"thumbnailsPerVideo int, minBytes bigint, maxBytes bigint, method int, fastHash {_FAST}, slowHash {_SLOW}"
)

#: Settings of the search are one JSON text in one row.
APP_SETTINGS = "id int, settings_json string"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
