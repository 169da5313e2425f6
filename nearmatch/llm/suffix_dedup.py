"""Suffix-array deduplication of bytes, through a run-length index.

Removes every byte that a string of ``LENGTH`` bytes covers which also starts
anywhere else, in another document or the same one.

The documents' repetitive parts come as spans, anchor by anchor (see repeats),
and are indexed in pieces of bounded size. A piece's index is the run-compressed
Burrows-Wheeler transform of its spans: of each run the symbol and the number
of rows, and samples of its two ends. A sample is a text position and the
length of the longest common prefix of its suffix with that of the row before
(at a run's first row) or after (at its last). Matching statistics are streamed
over the text from the samples: inside a run a statistic is one less than that
of the text position before. Equal spans of one anchor stand once in the index,
with their number as their weight: their rows are next to each other
throughout, so they only make runs longer, and each of their statistics reaches
to the end of the span. Windows whose statistic reaches LENGTH are marked.

Defined results: null text is empty; documents shorter than LENGTH lose
nothing; of equal documents (repeated rows too) of LENGTH bytes or more all
lose everything; rows with a null doc_id are compared like any other; empty
tables give no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from nearmatch.llm.common import table, text_batches
from nearmatch.llm.repeats import ANYWHERE, HOT, NONE, Spans, Units, find, of_kinds, removal, results

LENGTH = 200
GRAM = 32

_TABLE = np.random.default_rng(200).integers(0, 1 << 63, 256, dtype=np.uint64)


def _split(text: str | None) -> tuple[bytes, np.ndarray]:
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return raw, _TABLE[np.frombuffer(raw, np.uint8)]


def units(length: int = LENGTH, gram: int = GRAM) -> Units:
    return Units(length, gram, _split, lambda raw, _, a, b: raw[a:b], lambda raw: [], len)


class RunLengthIndex:
    """Run-compressed transform of a text of symbols (0: end of a span), with samples at both ends of each run.

    What follows the end of a span doesn't count: ends differ from each other,
    in the order of the spans. least: statistics under it may be given too low.
    """

    #: Symbols that one 64-bit key holds.
    PACKED = 8

    def __init__(self, text: np.ndarray, least: int = 0) -> None:
        self.given = len(text)
        if not len(text) or text[-1]:
            text = np.r_[text, 0]
        n = self.n = len(text)
        ends = np.flatnonzero(text == 0)
        self.span = np.repeat(np.arange(len(ends)), np.diff(np.r_[-1, ends]))
        self.left = ends[self.span] - np.arange(n)  # symbols up to the end of the span
        order, levels = self._sorted(text)
        before = text[order - 1]
        before[(order == 0) | (before == 0)] = -1  # the start of a span
        new = (before[1:] != before[:-1]) | (before[1:] < 0)  # the start of a span is a run of its own
        heads, lasts = np.flatnonzero(np.r_[True, new]), np.flatnonzero(np.r_[new, True])
        self.symbols, self.rows = before[heads], lasts - heads + 1
        tops, bottoms = heads[heads > 0], lasts[lasts < n - 1]
        up = self._common(text, levels, order[tops], order[tops - 1], least)
        down = self._common(text, levels, order[bottoms], order[bottoms + 1], least)
        #: Text positions and common prefixes at the first and at the last rows of runs.
        self.first = np.r_[order[:1], order[tops]], np.r_[0, up]
        self.last = np.r_[order[bottoms], order[-1:]], np.r_[down, 0]

    def _sorted(self, text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffixes in order, and by width which first symbols are equal: by doubling."""
        n, width = self.n, self.PACKED
        key = np.zeros(n + width, np.uint64)
        key[:n] = text
        for step in (1, 2, 4):
            key[: n + width - step] = key[: n + width - step] << np.uint64(8 * step) | key[step:]
        key = key[:n]
        cut = self.left < width - 1
        key[cut] &= ~np.uint64(0) << (np.uint64(8) * (np.uint64(width - 1) - self.left[cut].astype(np.uint64)))
        order = np.argsort(key)
        key = key[order]
        rows, sub = np.arange(n), order  # rows whose suffixes aren't told apart yet, and these suffixes
        rank = np.empty(n, np.int32)  # the first row of those with equal symbols
        levels: list[tuple[int, np.ndarray]] = []
        while True:
            first = np.r_[True, key[1:] != key[:-1]]
            rank[sub] = np.maximum.accumulate(np.where(first, rows, 0))
            levels.append((width, rank.copy()))
            alone = first & np.r_[first[1:], True]
            rows, sub = rows[~alone], sub[~alone]
            if not len(rows):
                return order, levels
            # of equal beginnings either all or none hold the end of their span
            ended = self.left[sub] < width
            following = np.where(ended, self.span[sub], rank[np.where(ended, 0, sub + width)])
            key = rank[sub].astype(np.int64) * n + following
            again = np.argsort(key)
            key, sub = key[again], sub[again]
            order[rows] = sub
            width *= 2

    def _common(self, text: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
        """Lengths of the longest common prefixes of suffixes a and b, no longer than their spans."""
        at, end = np.zeros(len(a), np.int64), self.n - 1
        most = np.minimum(self.left[a], self.left[b])
        rest = np.arange(len(a))
        for width, rank in reversed(levels):
            x, y = np.minimum(a[rest] + at[rest], end), np.minimum(b[rest] + at[rest], end)
            # keys of spans that end within the first width are equal too
            same = (rank[x] == rank[y]) & (at[rest] + width <= most[rest])
            at[rest[same]] += width
            if least:  # the levels below can add less than this one's width
                rest = rest[at[rest] + width > least]
        width = self.PACKED // 2
        while width:
            x, y = a[rest] + at[rest], b[rest] + at[rest]
            same = at[rest] + width <= most[rest]
            for k in range(width):
                same &= text[np.minimum(x + k, end)] == text[np.minimum(y + k, end)]
            at[rest[same]] += width
            width //= 2
        return at

    def _stream(self, sampled: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Statistics of all positions from those of the samples."""
        known, at = np.full(self.n, -1, np.int64), np.zeros(self.n, np.int64)
        at[sampled], known[sampled] = values, sampled
        last = np.maximum.accumulate(known)
        return np.where(last >= 0, np.maximum(at[last] - (np.arange(self.n) - last), 0), 0)

    def statistics(self) -> np.ndarray:
        """Of each position, the length of its longest match that starts elsewhere in the text, within the span."""
        return np.maximum(self._stream(*self.first), self._stream(*self.last))[: self.given]


def decide(spans: Spans, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marks of all windows that occur twice among the spans of their key."""
    kind, key, content, weight = spans.kinds()
    indexed = np.flatnonzero(np.bincount(key, weight)[key] > 1)
    if not len(indexed):
        return NONE
    text = np.frombuffer(b"\xff".join([content[k] for k in indexed.tolist()]) + b"\xff", np.uint8).astype(np.int16) + 1
    text[text == 256] = 0  # no byte of UTF-8 is 255
    index = RunLengthIndex(text, length)
    again = index.statistics() >= length
    again |= (weight[indexed] > 1)[index.span] & (index.left >= length)
    edges = np.flatnonzero(np.diff(np.r_[0, again.astype(np.int8), 0]))
    first, last = edges[::2], edges[1::2] - 1
    which = index.span[first]
    begins = np.r_[0, np.flatnonzero(text == 0)[:-1] + 1][which]
    at, mark = of_kinds(kind, indexed[which])
    return at, (first - begins)[mark], (last - begins)[mark], np.full(len(at), ANYWHERE)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs(doc_id, text)."""
    u = units(length, gram)
    found = find(docs, u, lambda spans: decide(spans, length), hot)
    gone = removal(found, u, lambda raw, _, out: np.frombuffer(raw, np.uint8)[~out].tobytes())
    return results(found, gone, earlier=False).withColumnRenamed("n", "n_bytes")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
