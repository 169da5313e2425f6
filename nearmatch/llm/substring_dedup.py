"""Substring deduplication of words, by level-wise doubling.

Removes every word that a window of ``LENGTH`` words covers whose sequence
also starts in a document with a smaller doc_id.

Spans of documents come anchor by anchor (see repeats): runs of GRAM words that
are repeated. Among the spans of a piece, levels of window lengths each about
twice the last lead from single words to LENGTH: a window is a candidate at
one level only if the two windows of the level before that make it up are
both repeated, and survives if it is repeated itself; the search ends where no
candidate survives.

Defined results: null text has no words; documents of fewer than LENGTH words
lose nothing; of equal word sequences all but those of the smallest doc_id
lose everything; repeated rows share a doc_id and a result; a null doc_id
stands after all others, and none is smaller than another; empty tables give
no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from nearmatch.llm.common import table, text_batches
from nearmatch.llm.repeats import HOT, LAST, NONE, Spans, Units, find, of_kinds, removal, results

LENGTH = 50
GRAM = 12


def _split(text: str | None) -> tuple[bytes, np.ndarray]:
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").split() if text else []
    return b" ".join(words), np.array([xxh64_intdigest(w) for w in words], np.uint64)


def _places(joined: bytes) -> list:
    """Where each word starts, and one place beyond the end."""
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return [0, *(gaps + 1).tolist(), len(joined) + 1]


def units(length: int = LENGTH, gram: int = GRAM) -> Units:
    return Units(length, gram, _split, lambda joined, at, a, b: joined[at[a] : at[b] - 1], _places, lambda joined: joined.count(b" ") + 1)


def levels(length: int) -> list[int]:
    """Window lengths from 1 to length, each at most twice the one before."""
    out = [length]
    while out[-1] > 1:
        out.append(-(-out[-1] // 2))
    return out[::-1]


def repeated_windows(words: np.ndarray, length: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of words that occur twice, and a number for each that equal windows share. Negative words end spans; a word of weight n stands for n."""
    n = len(words)
    weights = np.ones(n, np.int64) if weights is None else weights
    _, label = np.unique(words, return_inverse=True)
    alive = words >= 0
    width = 1
    for wider in levels(length)[1:]:
        step = wider - width
        starts = np.flatnonzero(alive[: max(0, n - step)] & alive[step:])
        if not len(starts):
            return starts, starts
        pair = label[starts] * np.int64(n) + label[starts + step]
        order = np.argsort(pair)
        ordered = pair[order]
        group = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        twice = np.bincount(group, weights=weights[starts[order]])[group] > 1
        kept, group = starts[order[twice]], group[twice]
        alive = np.zeros(n, bool)
        alive[kept] = True
        label = np.zeros(n, np.int64)
        label[kept] = group
        width = wider
    starts = np.flatnonzero(alive)
    return starts, label[starts]


def decide(spans: Spans, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marks of all windows that occur twice among the spans of their key, with the smallest id of the documents that have them.

    Equal spans are one, with their number as its weight: all that is in a span
    of weight 2 or more is repeated at every level.
    """
    kind, key, content, weight = spans.kinds()
    searched = np.flatnonzero(np.bincount(key, weight)[key] > 1)
    if not len(searched):
        return NONE
    numbers: dict[bytes, int] = {}
    parts: list[int] = []
    ends = np.zeros(len(searched), np.int64)
    for k, at in enumerate(searched.tolist()):
        parts += [numbers.setdefault(w, len(numbers)) for w in content[at].split(b" ")]
        parts.append(-1)
        ends[k] = len(parts)
    sizes = np.diff(np.r_[0, ends])
    did = np.full(len(weight), LAST)
    np.minimum.at(did, kind, spans.did)
    starts, label = repeated_windows(np.array(parts, np.int64), length, np.repeat(weight[searched], sizes))
    if not len(starts):
        return NONE
    span = np.searchsorted(ends, starts, side="right")
    least = np.full(int(label.max()) + 1, LAST)
    np.minimum.at(least, label, did[searched[span]])
    least, first = least[label], starts - (ends - sizes)[span]
    # runs of consecutive windows of one span whose smallest ids are the same
    new = np.flatnonzero(np.r_[True, (span[1:] != span[:-1]) | (first[1:] != first[:-1] + 1) | (least[1:] != least[:-1])])
    last = np.r_[new[1:], len(starts)] - 1
    at, mark = of_kinds(kind, searched[span[new]])
    a, b, least = first[new][mark], first[last][mark], least[new][mark]
    wanted = least <= spans.did[at]
    return at[wanted], a[wanted], b[wanted], least[wanted]


def _keep(joined: bytes, at: list, gone: np.ndarray) -> bytes:
    words = joined.split(b" ") if joined else []
    return b" ".join(w for w, out in zip(words, gone.tolist()) if not out)


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs(doc_id, text)."""
    u = units(length, gram)
    found = find(docs, u, lambda spans: decide(spans, length), hot)
    return results(found, removal(found, u, _keep), earlier=True).withColumnRenamed("n", "n_words").drop("n_spans")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
