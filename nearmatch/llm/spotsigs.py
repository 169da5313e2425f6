"""Document fingerprints by SpotSigs.

A signature is an anchor and the chain of the content words that follow it, up
to ``CHAIN`` of them, common words between them left out. Anchors are the
common words and the start of the text; at the end of a text chains are
shorter. So every text with a word has a signature; one without words, empty or
not, has its whole text as one.

The fingerprint is the set of a document's signatures: their 32-bit hashes in
order, as text. Equal sets, and with them equal texts, have equal fingerprints.
``likeness`` of two fingerprints is the Jaccard similarity of their sets.
Comparisons against a threshold are pruned: sets whose lengths lie too far
apart (the smaller over the larger bounds the similarity) are not compared, and
while two ordered sets are merged, what is left of them bounds what can still
be reached.

The query compares given pairs and wants every likeness, so its threshold is 0.
``similar`` joins a whole table at a threshold: documents of equal fingerprints
are one class; classes are partitioned by length (``length_part``), such that
sets which reach the threshold are in the same part or in neighbouring ones;
within these, sets that share one of their first signatures, enough of them that
similar sets must, are compared, pruned. Pairs are those of classes, never of
all copies.

Defined results: null text is empty; two empty texts are alike (1); repeated
doc_ids follow each other in the order of their texts; one row alone is its
own next document; rows with a null doc_id come first; empty tables give no
rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmatch.llm.common import groups_for, lookup, materialize, table, text_batches

CHAIN = 2
#: Documents of a part of the order, and the most parts: larger parts only stream longer.
PART = 4000
MAX_PARTS = 10_000

# Common words of English, French, German and Spanish.
COMMON = frozenset(
    """
a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you
au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour qui que sa se ses son sont sur un une vous
aber als am an auch auf aus bei bin das dem den der des die ein eine einen einer er es hat ich im ist mit nach nicht sich sie sind so und uns von war wie wir zu zum zur
al como con del el ella ellos era es esta este fue ha hay la las lo los me mi muy no nos o para pero por que se sin su sus te un una y ya yo
""".split()
)

_words = re.compile(r"\w+").findall


def signatures(text: str, chain: int = CHAIN) -> np.ndarray:
    """The ordered set of a text's signatures, as 32-bit hashes."""
    from xxhash import xxh32_intdigest

    content: list[str] = []
    anchors: list[tuple[str, int]] = [("", 0)]
    for w in _words(text.lower()):
        if w in COMMON:
            anchors.append((w, len(content)))
        else:
            content.append(w)
    if content or len(anchors) > 1:
        found = {" ".join((w, *content[k : k + chain])) for w, k in anchors}
    else:
        found = {text}
    return np.unique(np.array([xxh32_intdigest(s.encode("utf-8", "surrogatepass")) for s in found], np.uint32))


def fingerprint(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def parse(text: str) -> np.ndarray:
    """The signatures of a fingerprint."""
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def likeness(a: str, b: str, threshold: float = 0.0) -> float:
    """Likeness of two fingerprints; 0 as soon as it can't reach the threshold."""
    return jaccard(parse(a), parse(b), threshold)


def jaccard(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard similarity of two ordered sets; 0 as soon as it can't reach the threshold."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(not len(b))
    if len(a) < threshold * len(b):
        return 0.0
    needed = int(np.ceil(threshold * (len(a) + len(b)) / (1 + threshold) - 1e-9))
    step, shared = max(1, len(a) // 4), 0
    for at in range(0, len(a), step):
        part = a[at : at + step]
        place = np.searchsorted(b, part)
        place[place == len(b)] = 0
        shared += int(np.count_nonzero(b[place] == part))
        if shared + len(a) - at - len(part) < needed:
            return 0.0
    return shared / (len(a) + len(b) - shared)


def length_part(n: int, threshold: float) -> int:
    """The range of set lengths that n is in: each range ends where its first length falls under the threshold."""
    part, end = 0, 1
    while n > end:
        end = int(end / threshold) + 1
        part += 1
    return part


def prefix(n: int, threshold: float) -> int:
    """How many of its n ordered signatures a set has to share one of with any set that reaches the threshold."""
    return n - int(np.ceil(threshold * n - 1e-9)) + 1


def similar(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class_id of each row of docs(doc_id, text); a, b, likeness of the pairs of classes that reach the threshold, a < b).

    A class is named by its smallest doc_id; repeated rows share a class; rows
    without an id have the class of their text, or null.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [signatures(b.column(1)[k].as_py() or "") for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int32())], names=["doc_id", "sigs", "n"])

    rows = materialize(source.mapInArrow(sets, "doc_id long, sigs binary, n int"), "signatures")
    classes = rows.groupBy("sigs", "n").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_docs"))
    classes = materialize(classes, "classes")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, bool]] = []
            for k in range(b.num_rows):
                sigs, n, at = np.frombuffer(b.column(0)[k].as_py(), np.uint32), b.column(1)[k].as_py(), b.column(2)[k].as_py()
                part = length_part(n, threshold)
                for token in sigs[: prefix(n, threshold)].tolist():  # at home in its part, and a visitor of the next
                    out += [(part, token, at, True), (part + 1, token, at, False)]
            columns = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.bool_()))], names=["part", "token", "id", "home"])

    named = classes.where("class_id IS NOT NULL")
    keys = materialize(named.select("sigs", "n", "class_id").mapInArrow(tokens, "part int, token long, id long, home boolean"), "tokens")
    homes = keys.where("home").select("part", "token", F.col("id").alias("x"))
    others = keys.select("part", "token", F.col("id").alias("y"), "home")
    # two at home meet once, as a visitor meets one at home
    met = homes.join(others, ["part", "token"]).where("x <> y AND (NOT home OR x < y)")
    met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    sides = [named.select(F.col("class_id").alias(c), F.col("sigs").alias(f"{c}_sigs")) for c in ("a", "b")]
    wanted = met.join(sides[0], "a").join(sides[1], "b").select("a", "b", "a_sigs", "b_sigs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [jaccard(*(np.frombuffer(b.column(c)[k].as_py(), np.uint32) for c in (2, 3)), threshold) for k in range(b.num_rows)]
            whole = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.float64())], names=["a", "b", "likeness"])
            yield whole.filter(pa.array([x >= threshold for x in near], pa.bool_()))

    pairs = wanted.mapInArrow(compare, "a long, b long, likeness double")
    members = lookup(rows.select("doc_id", "sigs"), classes.select("sigs", "class_id", "n_docs"), "sigs", "n_docs", "doc_id")
    return members.select("doc_id", F.col("found.class_id").alias("class_id")), pairs


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the start of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, part: int = PART, max_parts: int = MAX_PARTS) -> DataFrame:
    """doc_id, text, part, extra, ordered within each part; a part ends with the row that follows it, marked extra.

    The parts are ranges of doc_ids that begin at existing ids. The row with
    the first id of a part is also sent to the part before, that of the first
    part to the last. Only these ids, at most max_parts, pass through the driver.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), "doc_id", "text")
    ids = docs.select("k")
    parts = min(max_parts, groups_for(ids.count(), part))
    ranged = ids.repartitionByRange(parts, "k").groupBy(F.spark_partition_id().alias("range")).agg(F.min("k").alias("k"))
    starts = sorted(r["k"] for r in ranged.collect())
    n = max(1, len(starts))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(starts, np.int64)
        for b in batches:
            k = b.column(0).to_numpy()
            home = np.searchsorted(edges, k, side="right") - 1
            also = np.flatnonzero(edges[home] == k)
            take = np.r_[np.arange(len(k)), also]
            where = np.r_[home, (home[also] - 1) % n]
            rows = b.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(where, pa.int64()), pa.array(np.arange(len(take)) >= len(k))], names=["k", "doc_id", "text", "part", "extra"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.mapInArrow(places, f"k long, doc_id {kind}, text string, part long, extra boolean")
    return dealt.repartition(n, "part").sortWithinPartitions("part", "extra", "k", "text").select("doc_id", "text", "part", "extra")


def compare_edited(docs: DataFrame, part: int = PART) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs(doc_id, text)."""
    source = in_order(docs, part)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: part, doc_id, text, signatures
        for b in batches:
            rows = []
            for doc, text, where, extra in zip(*(b.column(k).to_pylist() for k in range(4))):
                text = text or ""
                if held is not None and held[0] != where:
                    held = None
                if held is not None and held[1] is _DONE:
                    continue  # more rows with the cut id: only the first follows the part
                sigs = signatures(text)
                if held is not None:
                    rows.append(_row(held, text, sigs))
                held = (where, _DONE, "", sigs) if extra else (where, doc, text, sigs)
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = (b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return source.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_DONE = object()


def _row(held: tuple, following: str, next_sigs: np.ndarray) -> tuple:
    _, doc, text, sigs = held
    new = edited(text, following)
    new_sigs = signatures(new)
    return (
        doc,
        len(text),
        sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
        fingerprint(sigs),
        fingerprint(new_sigs),
        jaccard(sigs, new_sigs),
        jaccard(sigs, next_sigs),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return compare_edited(table(spark, sf_dir, "documents"))
