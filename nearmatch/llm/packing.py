"""Best-fit packing of documents into fixed-length token sequences.

Method: best fit by decreasing length gives a first packing of each group of
pieces; a swap-based local search over its underfull bins then moves
documents and exchanges one for one or two for one, always towards the fuller
bin, so that the sum of squared fills grows until bins empty or no step is
left. Groups are hashes of the documents, even whatever the data; what stands
in underfull bins afterwards is dealt into new, fewer groups and packed again,
until it is one group: a reduction tree over ever smaller leftovers. Where a round
fills hardly any bin, the emptiest bins of all groups make the last group. No task
ever holds more than a group, and nothing but counts reaches the driver.

Only documents over the sequence length are cut: a first piece with the
remainder, then whole sequences, which need no packing.

Defined results: null text is an empty document, whose only token is the end
mark; repeated rows are packed once each; equal lengths are interchangeable,
ordered by doc_id; empty tables give no rows; columns besides doc_id and text
are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import partial
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearmatch.llm.common import bucket_of, groups_for, materialize, table, text_batches

SEQUENCE = 1024
END_ID = 2
#: Pieces of a group; its packing needs a few MB.
GROUP = 20_000
#: The ranks of byte_bpe_50k.json; a test holds the ids against that file's tokenizer.
VOCABULARY = "byte_bpe_50k.tiktoken"


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    ``ranks`` is a file of byte sequences and ranks. Where a text has no two
    white-space characters in a row, the last two parts of the pattern, of
    which one looks ahead, are both a single white-space character; the
    pattern without looking ahead splits such texts alike and twice as fast.
    """

    def __init__(self, ranks: str, pattern: str) -> None:
        import tiktoken

        with open(ranks, "rb") as f:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        make = partial(tiktoken.Encoding, mergeable_ranks=known, special_tokens={})
        self.full = make(f"full-{ranks}", pat_str=pattern).encode_ordinary
        single = pattern.replace(r"|\s+(?!\S)|\s+", r"|\s")
        self.single = make(f"single-{ranks}", pat_str=single).encode_ordinary
        self.runs = re.compile(r"\s\s").search

    def encode(self, text: str) -> bytes:
        return array("I", (self.full if self.runs(text) else self.single)(text)).tobytes()


def pieces_of(docs: DataFrame, ranks: str, pattern: str, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of docs(doc_id, text)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(ranks, pattern).encode
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                out: list[list] = [[], [], [], [], []]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(text or "") + end
                    n, start = len(ids) // 4, 0
                    first = n % length or min(n, length)
                    for k, size in enumerate([first] + [length] * ((n - first) // length)):
                        for column, value in zip(out, (doc, k, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]))):
                            column.append(value)
                        start += size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit by decreasing length: each piece goes to the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(open_rooms, size)
        if at == len(open_rooms):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = open_rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms.pop(at)
        bins[b].append(i)
        room -= size
        if room:
            if not by_room[room]:
                insort(open_rooms, room)
            by_room[room].append(b)
    return bins


class _Pairs:
    """Sums of two pieces of one bin, over all bins of a pool."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.lengths = lengths
        self.homes: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.sums: list[int] = []  # those that a bin has, in order
        self.of_bin: dict[int, list[int]] = {}

    def add(self, home: int, members: list[int]) -> None:
        sizes = sorted(self.lengths[i] for i in members)
        different = sorted(set(sizes))
        sums = {x + y for k, x in enumerate(different) for y in different[k + 1 :]} | {2 * x for x, y in zip(sizes, sizes[1:]) if x == y}
        self.of_bin[home] = sorted(sums)
        for total in self.of_bin[home]:
            if not self.homes[total]:
                insort(self.sums, total)
            self.homes[total][home] = None

    def remove(self, home: int) -> None:
        for total in self.of_bin.pop(home):
            del self.homes[total][home]
            if not self.homes[total]:
                self.sums.pop(bisect_left(self.sums, total))

    def largest(self, most: int) -> int:
        at = bisect_right(self.sums, most)
        return self.sums[at - 1] if at else 0

    def pieces(self, total: int, bins: list[list[int]]) -> tuple[tuple[int, int, int], tuple[int, int, int]]:
        home = next(iter(self.homes[total]))
        rows = sorted((self.lengths[i], i, home) for i in bins[home])
        lo, hi = 0, len(rows) - 1
        while rows[lo][0] + rows[hi][0] != total:
            if rows[lo][0] + rows[hi][0] > total:
                hi -= 1
            else:
                lo += 1
        return rows[lo], rows[hi]


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Steps between underfull bins, each towards the fuller one, until none is left; empty bins go.

    A pass fills the fullest bin in turn from all others that are to come;
    passes repeat until one makes no step. Every step raises the sum of
    squared fills, which is bounded, so the search ends.
    """
    fills = [sum(lengths[i] for i in b) for b in bins]
    while _pass(bins, fills, lengths, capacity):
        pass
    return [b for b in bins if b]


def _pass(bins: list[list[int]], fills: list[int], lengths: list[int], capacity: int) -> bool:
    """Whether a step was made."""
    moved = False
    heap = [(-fills[k], k) for k in range(len(bins)) if 0 < fills[k] < capacity]
    heapify(heap)
    # pieces of the bins that are still to come, by length
    pool = sorted((lengths[i], i, k) for _, k in heap for i in bins[k])
    pairs = _Pairs(lengths, capacity)
    for _, k in sorted(heap, key=lambda x: (-x[0], -x[1])):
        pairs.add(k, bins[k])
    while heap:
        fill, a = heappop(heap)
        if -fill != fills[a] or a not in pairs.of_bin:  # it has given since, and stands in the heap again
            continue
        for i in bins[a]:
            pool.pop(bisect_left(pool, (lengths[i], i, a)))
        pairs.remove(a)
        while pool and fills[a] < capacity:
            step = _best_step(bins, a, pool, pairs, lengths, capacity - fills[a])
            if step is None:
                break
            moved = True
            gained, given, taken = step
            home = taken[0][2]
            pairs.remove(home)
            for x in taken:
                pool.pop(bisect_left(pool, x))
                bins[x[2]].remove(x[1])
                bins[a].append(x[1])
                fills[x[2]] -= x[0]
            if given is not None:
                bins[a].remove(given)
                bins[home].append(given)
                fills[home] += lengths[given]
                insort(pool, (lengths[given], given, home))
            fills[a] += gained
            if bins[home]:
                pairs.add(home, bins[home])
                heappush(heap, (-fills[home], home))
    return moved


def _best_step(bins: list[list[int]], a: int, pool: list[tuple[int, int, int]], pairs: _Pairs, lengths: list[int], gap: int) -> tuple | None:
    """(tokens gained, piece given away or None, pieces taken from one bin) of the step that fills the gap best."""
    best: tuple | None = None
    at = bisect_right(pool, (gap, 1 << 60, 0)) - 1  # a move
    if at >= 0:
        best = (pool[at][0], None, (pool[at],))
        if pool[at][0] == gap:
            return best
    by_size: dict[int, int] = {}
    for i in bins[a]:
        by_size.setdefault(lengths[i], i)
    for size, i in by_size.items():  # one for one
        at = bisect_right(pool, (size + gap, 1 << 60, 0)) - 1
        if at >= 0 and pool[at][0] > size and (best is None or pool[at][0] - size > best[0]):
            best = (pool[at][0] - size, i, (pool[at],))
            if best[0] == gap:
                return best
    two: tuple | None = None
    for size, i in [(0, None), *by_size.items()]:  # two of one bin for one, or for nothing
        gained = pairs.largest(size + gap) - size
        if gained > max(best[0] if best else 0, two[0] if two else 0):
            two = (gained, i, size)
    return (two[0], two[1], pairs.pieces(two[0] + two[2], bins)) if two else best


def pack_group(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths.tolist(), capacity)


def _pack_round(items: DataFrame, groups: int, seed: int, capacity: int, last: bool) -> DataFrame:
    """items with bin, offset and closed: whether its place is final."""
    items = items.withColumn("grp", bucket_of(["doc_id", "piece", "ids_crc32"], groups, seed))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", na_position="first").reset_index(drop=True)
        n = len(pdf)
        lengths = pdf["length"].to_numpy(np.int64)
        bin_of, offset, closed = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        for k, members in enumerate(pack_group(lengths, capacity)):
            sizes = lengths[members]
            bin_of[members] = k
            offset[members] = np.cumsum(sizes) - sizes
            closed[members] = last or int(sizes.sum()) == capacity
        return pdf.assign(bin=bin_of, offset=offset, closed=closed)

    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, grp long, bin long, offset long, closed boolean"
    return items.groupBy("grp").applyInPandas(run, fields)


def pack(docs: DataFrame, ranks: str, pattern: str, capacity: int = SEQUENCE, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece.

    A sequence_id is round * 2^56 + group * 2^24 + bin; whole sequences have round 0.
    """
    pieces = materialize(pieces_of(docs, ranks, pattern, capacity, end_id), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    done = [
        pieces.where(F.col("length") == capacity).select(*columns, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    ]
    rest, turn = pieces.where(F.col("length") < capacity), 0
    left = rest.count()
    while left:
        turn += 1
        groups = groups_for(left, group)
        packed = materialize(_pack_round(rest, groups, turn, capacity, last=groups == 1), f"packed{turn}")
        number = F.lit(turn << 56) + F.col("grp") * F.lit(1 << 24) + F.col("bin")
        done.append(packed.where("closed").select(*columns, number.alias("sequence_id"), "offset"))
        if groups == 1:
            break
        rest, before = packed.where("NOT closed").select(*columns), left
        left = rest.count()
        if left > 0.9 * before and groups_for(left, group) > 1:  # hardly any bin became full: the next round would repeat this one
            fill = F.sum("length").over(Window.partitionBy("grp", "bin"))
            upto = F.count(F.lit(1)).over(Window.partitionBy("grp").orderBy("fill", "bin").rangeBetween(Window.unboundedPreceding, Window.currentRow))
            open_ = materialize(packed.where("NOT closed").withColumn("fill", fill).withColumn("upto", upto), "open")
            emptiest = F.col("upto") <= max(1, group // groups)
            done.append(open_.where(~emptiest).select(*columns, number.alias("sequence_id"), "offset"))
            merged = materialize(_pack_round(open_.where(emptiest).select(*columns), 1, turn + 1, capacity, last=True), "merged")
            number = F.lit((turn + 1) << 56) + F.col("grp") * F.lit(1 << 24) + F.col("bin")
            done.append(merged.select(*columns, number.alias("sequence_id"), "offset"))
            break
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    text_batches(spark)
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
