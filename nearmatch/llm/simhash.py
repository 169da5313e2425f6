"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared once each, whatever the number of their documents.
A fingerprint's cell is the population counts of its four 16-bit words: two
fingerprints whose counts differ by more than the radius, summed over the
words, cannot link. Cells in order form tiles of bounded size (large cells are
split by hash); tile pairs further apart than the radius are skipped; the
others are compared exactly, cell against near cells, with numpy's exclusive-or
and bit counts, in blocks of at most ``BLOCK`` pairs. A block's links are folded
into the tile pair's spanning forest before the next block is compared, so that
a tile of near copies never lists its pairs; components of the forests are the
components of all links.

The histogram of cells, at most 17^4 rows, and the tile pairs, at most about
MAX_TILES^2 / 2, are all that reaches the driver.

Defined results: texts without words (null and empty ones too) have
fingerprint zero, which links like any other; repeated rows share a
fingerprint; a null doc_id never names a component unless all its ids are
null; empty tables give no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmatch.llm.common import lookup, materialize, numbered, own, shuffle_partitions, table, text_batches
from nearmatch.operators.components import connected_components
from nearmatch.operators.groups import SMALL_GRAPH

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 4096
MAX_TILES = 768
#: Tiles that one copy of a tile is compared with.
PARTNERS = 16
#: Fingerprint pairs of one numpy call.
BLOCK = 1 << 18

_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle; of the whole sequence if it is shorter; none without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxh64_intdigest(joined, SEED)]
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    ends = np.append(gaps, len(joined)).tolist()[size - 1 :]
    starts = [0, *(gaps + 1).tolist()]
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)]


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is set if over half the shingle hashes have it."""
    hashes = [shingle_hashes(t) for t in texts]
    n = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    h = np.array([x for hs in hashes for x in hs], np.uint64)
    begins = np.cumsum(n[some]) - n[some]
    # counters of 8 bits hold up to 255 hashes: parts of documents
    parts_of = -(-n[some] // 255)
    first = np.cumsum(parts_of) - parts_of
    within = np.arange(parts_of.sum()) - np.repeat(first, parts_of)
    parts = np.repeat(begins, parts_of) + 255 * within
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, parts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[some] |= (2 * counts[:, byte] > n[some]).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def with_fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, the fingerprint as a signed long, and the columns in keep, of each row of docs(doc_id, text)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(part.column(1).to_pylist()).view(np.int64)), *part.columns[2:]], names=["doc_id", "fp", *keep])

    kinds = "".join(f", `{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"doc_id long, fp long{kinds}")


def cells_of(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit words."""
    return np.bitwise_count(fp[:, None] >> np.array([48, 32, 16, 0], np.uint64) & np.uint64(0xFFFF)).astype(np.int16)


def plan_tiles(cells: np.ndarray, counts: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First tile and number of tiles of each cell (in order), and the tiles' lowest and highest counts."""
    first, parts, low, high = [], [], [], []
    room = 0
    for cell, n in zip(cells, counts):
        if n > tile:
            k = -(-int(n) // tile)
            first.append(len(low))
            parts.append(k)
            low += [cell] * k
            high += [cell] * k
            room = 0
            continue
        if n > room:
            low.append(cell)
            high.append(cell)
            room = tile
        room -= n
        low[-1], high[-1] = np.minimum(low[-1], cell), np.maximum(high[-1], cell)
        first.append(len(low) - 1)
        parts.append(1)
    return np.array(first), np.array(parts), np.array(low), np.array(high)


def tile_pairs(low: np.ndarray, high: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs of tiles, each with itself too, whose population counts come within the radius."""
    out = []
    for i in range(len(low)):
        apart = np.maximum(0, np.maximum(low[i:] - high[i], low[i] - high[i:])).sum(axis=1)
        out += [(i, int(j) + i) for j in np.flatnonzero(apart <= radius)]
    return out


class Forest:
    """Components of positions 0 to n - 1, and the links that joined them. Holds two arrays of n, however many links it sees."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.left: list[int] = []
        self.right: list[int] = []

    def add(self, at: int, others: np.ndarray) -> None:
        """Links position at to each of the others."""
        own = self.label[at]
        labels = self.label[others]
        new = labels != own
        while new.any():  # one step for each component that is joined
            k = int(np.argmax(new))
            self.left.append(at)
            self.right.append(int(others[k]))
            self.label[self.label == labels[k]] = own
            new &= labels != labels[k]


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles, each in the order of its cells: positions in a, and in b after those of a.

    Blocks of at most BLOCK pairs are compared, and folded into the forest
    before the next one. same: b is a.
    """
    ca, cb = cells_of(a), cells_of(b)
    starts_a = np.flatnonzero(np.r_[True, (ca[1:] != ca[:-1]).any(axis=1)])
    starts_b = np.flatnonzero(np.r_[True, (cb[1:] != cb[:-1]).any(axis=1)])
    sizes_b = np.diff(np.r_[starts_b, len(b)])
    cell_b = np.repeat(np.arange(len(starts_b)), sizes_b)
    shift = 0 if same else len(a)
    found = Forest(len(a) + (0 if same else len(b)))
    for at, end in zip(starts_a.tolist(), np.r_[starts_a[1:], len(a)].tolist()):
        near = np.abs(cb[starts_b] - ca[at]).sum(axis=1) <= radius
        if same:
            near &= starts_b >= at
        columns = np.flatnonzero(near[cell_b])
        for first in range(0, len(columns), BLOCK):
            part = columns[first : first + BLOCK]
            others = b[part]
            step = max(1, BLOCK // len(part))
            for lo in range(at, end, step):
                hit = np.bitwise_count(a[lo : min(end, lo + step), None] ^ others) <= radius
                for row in np.flatnonzero(hit.any(axis=1)).tolist():
                    found.add(lo + row, part[hit[row]] + shift)
    return np.array(found.left, np.int64), np.array(found.right, np.int64)


def linked(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (src, dst) between different fingerprints of distinct(fp): forests with the components of all links."""
    spark = distinct.sparkSession
    words = [F.bit_count(F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(0xFFFF))) for s in (48, 32, 16, 0)]
    cell = ((words[0] * 17 + words[1]) * 17 + words[2]) * 17 + words[3]
    celled = distinct.select("fp", cell.alias("cell"))
    histogram = celled.groupBy("cell").count().toPandas().sort_values("cell")
    codes, counts = histogram["cell"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64)
    tile = max(tile, -(-int(counts.sum()) // MAX_TILES))
    cells = np.stack([codes // 17**3, codes // 17**2 % 17, codes // 17 % 17, codes % 17], axis=1).astype(np.int16)
    first, parts, low, high = plan_tiles(cells, counts, tile)
    where = spark.createDataFrame(pd.DataFrame({"cell": codes, "first": first.astype(np.int64), "parts": parts.astype(np.int64)}), "cell long, first long, parts long")
    near = np.array(tile_pairs(low, high, radius) if len(low) else np.zeros((0, 2)), np.int64)
    nth = np.arange(len(near)) - np.searchsorted(near[:, 0], near[:, 0])
    pairs = spark.createDataFrame(pd.DataFrame({"i": near[:, 0], "j": near[:, 1], "nth": nth}), "i long, j long, nth long")
    tiled = celled.join(F.broadcast(where), "cell").select("fp", (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts"))).alias("tile"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        c = cells_of(fp)
        fp = fp[np.lexsort((fp, *c.T[::-1]))]
        return pd.DataFrame({"tile": [pdf["tile"].iloc[0]], "fps": [fp.tobytes()]})

    tiles = materialize(tiled.groupBy("tile").applyInPandas(pack, "tile long, fps binary"), "tiles")
    # a tile goes once to each group of its partners, in front of them
    grouped = pairs.withColumn("part", F.floor(F.col("nth") / PARTNERS))
    partners = grouped.join(tiles, F.col("j") == F.col("tile")).select("i", "part", "j", "fps")
    first = grouped.select("i", "part").distinct().join(tiles, F.col("i") == F.col("tile")).select("i", "part", F.lit(-1).cast("long").alias("j"), "fps")
    n = max(1, min(4 * shuffle_partitions(spark), len(low) ** 2))
    work = first.unionByName(partners).repartition(n, "i", "part").sortWithinPartitions("i", "part", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(0, np.uint64)
        for batch in batches:
            for k in range(batch.num_rows):
                i, j, y = batch.column(0)[k].as_py(), batch.column(2)[k].as_py(), np.frombuffer(batch.column(3)[k].as_py(), np.uint64)
                if j < 0:
                    x = y
                    continue
                s, t = forest(x, y, radius, i == j)
                if len(s):
                    both = (x if i == j else np.concatenate([x, y])).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(both[s]), pa.array(both[t])], names=["src", "dst"])

    return work.mapInArrow(run, "src long, dst long")


def _grouped(rows: DataFrame, radius: int, **more: Column) -> DataFrame:
    """fp, first_id, n_same, component of each different fingerprint of rows(doc_id, fp), and what more aggregates of its rows say."""
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_same"), *[c.alias(k) for k, c in more.items()])
    distinct = materialize(distinct, "distinct")
    labels = connected_components(linked(distinct.select("fp"), radius), small=SMALL_GRAPH).withColumnRenamed("id", "fp")
    return distinct.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id, n_same (documents with that fingerprint) of each row of docs(doc_id, text)."""
    rows = materialize(with_fingerprints(docs), "fingerprints")
    grouped = _grouped(rows, radius)
    ids = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    entries = materialize(grouped.join(ids, "component").select("fp", "component_id", "n_same"), "components")
    found = lookup(rows, entries, "fp", "n_same", "doc_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("found.component_id").alias("component_id"), F.col("found.n_same").alias("n_same"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near-duplicates with all its columns: that of the smallest doc_id, of a null one only if there is no other."""
    row = own("row")
    marked = numbered(docs)
    rows = materialize(with_fingerprints(marked, (row,)).withColumnRenamed(row, "row"), "fingerprints")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    stay = _grouped(rows, radius, head=head).groupBy("component").agg(F.min("head").alias("head"))
    return marked.join(stay.select(F.col("head.row").alias(row)), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
