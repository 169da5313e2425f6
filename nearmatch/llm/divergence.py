"""Source divergence audit: how far the term frequencies of a language's sources lie apart.

A term is a run of ASCII letters and of bytes from 0x80, A-Z lower-cased. A
language keeps the terms that at least ``LEAST`` of its documents have. Each
group (lang, source) and each language gives a kept term the share
p = 1 + floor(SCALE * (count + 1) / (N + V)), and what a term adds to the
divergence of p from q is floor((p - q)^2 / q). All of it is exact.

1. Tasks tokenise bytes: a batch's texts are one UTF-8 buffer, a lookup table
   marks the bytes of terms, and where marks begin and end are the slices.
   Slices are grouped by xxHash; every slice is compared with its group's first
   byte by byte, and those that differ, of which the hash collides, are told
   apart by their bytes. Documents by terms in CSR form give, by reduceat, the
   counts and document counts of each group, which Spark adds up.
2. Spark keeps terms, and gives each group's and language's p.
3. Pairs of sources: a language's kept terms are dealt into blocks. A block's
   counts are CSR rows, one for each source; what one source's row adds to all
   pairs is a reduceat over the block. Terms that a source doesn't have share one
   p, so the work is sources times counts that aren't zero, never the dense
   table, and Spark adds the blocks' sums, of which there are no more than counts.
4. Terms of a group: the ``TOP`` that add most, against the language's p.

Counts, kept terms and pairs are of all documents; nothing is collected to the
driver. A group's terms are dealt out by term, whatever the group's size.

Defined results: null text, lang and source are ''; a source without kept terms
has p = 1 + floor(SCALE / V) throughout; a language without kept terms gives
its pairs the value 0; a language's only source has no pairs; repeated rows
count as documents of their own; an empty table gives no rows; columns besides
text, lang and source are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearmatch.llm.common import materialize, table, text_batches

#: Documents of a language that have a term that is kept.
LEAST = 3
SCALE = 1_000_000_000
#: Terms of a group that are reported.
TOP = 200
#: Bytes of text that are tokenised at once, more where one document has more; bytes compared at once.
BYTES = 4 << 20
COMPARED = 1 << 20
#: Counts of a block of terms, or the square of a language's number of sources where that is more.
COUNTS = 1 << 17

_TERM = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each term of documents that stand in data between offsets; no term crosses documents."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _TERM[data]
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True
    now, before = inside[1:], inside[:-1]
    starts = np.flatnonzero(now & (~before | edges))
    ends = np.flatnonzero(before & (~now | edges))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _differ(low: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether n[i] bytes from a[i] differ from those from b[i]."""
    out = np.zeros(len(a), bool)
    cuts = np.searchsorted(np.cumsum(n), np.arange(COMPARED, n.sum() + COMPARED, COMPARED), side="left") + 1 if len(n) else []
    begin = 0
    for end in cuts:
        end = min(int(end), len(n))
        m = n[begin:end]
        if len(m):
            at = np.repeat(np.arange(len(m)), m)
            k = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
            unlike = low[a[begin:end][at] + k] != low[b[begin:end][at] + k]
            out[begin + at[unlike]] = True
        begin = end
    return out


def grouped(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest: Callable[[bytes], int] | None = None) -> tuple[np.ndarray, list[bytes]]:
    """The number of each slice's term, and the terms. digest is xxHash unless another is given."""
    from xxhash import xxh3_64_intdigest

    digest, data = digest or xxh3_64_intdigest, low.tobytes()
    keys = np.array([digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
    term, different = pd.factorize(keys)
    first = np.empty(len(different), np.int64)
    first[term[::-1]] = np.arange(len(term))[::-1]
    terms = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    n, heads = ends - starts, first[term]
    unlike = n != n[heads]
    same = np.flatnonzero(~unlike)
    unlike[same] = _differ(low, starts[same], starts[heads[same]], n[same])
    more: dict[bytes, int] = {}
    for i in np.flatnonzero(unlike).tolist():  # the hash is another term's
        term[i] = more.setdefault(data[starts[i] : ends[i]], len(terms) + len(more))
    return term, terms + list(more)


def group_counts(term: np.ndarray, doc: np.ndarray, group: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """group, term, occurrences, documents of each term in each group; group has that of each document."""
    cells, c = np.unique(doc.astype(np.int64) * n_terms + term, return_counts=True)  # documents by terms, row by row
    row, column = cells // n_terms, cells % n_terms
    key = group[row] * n_terms + column
    order = np.argsort(key, kind="stable")
    key, begins = np.unique(key[order], return_index=True)
    if not len(key):
        return (np.zeros(0, np.int64),) * 4
    return key // n_terms, key % n_terms, np.add.reduceat(c[order], begins), np.diff(np.append(begins, len(order)))


_COUNTS = "lang string, source string, term string, c long, d long"


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BYTES, side="right")) - 1)
            low, high = int(offsets[begin]), int(offsets[end])
            if high > low:
                yield _counted(np.frombuffer(texts.buffers()[2], np.uint8)[low:high], offsets[begin : end + 1] - low, batch.slice(begin, end - begin))
            begin = end


def _counted(data: np.ndarray, offsets: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
    starts, ends, doc = slices(data, offsets)
    term, terms = grouped(_LOWER[data], starts, ends)
    names = pd.MultiIndex.from_arrays([batch.column(c).to_pandas() for c in ("lang", "source")])
    group, found = pd.factorize(names)
    g, t, c, d = group_counts(term, doc, group.astype(np.int64), max(1, len(terms)))
    lang, source = (pa.array(found.get_level_values(k), pa.string()).take(pa.array(g)) for k in (0, 1))
    return pa.RecordBatch.from_arrays([lang, source, pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(t)), pa.array(c, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "term", "c", "d"])


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count among a total of kept terms; sums are of up to 38 digits on the way."""
    wide = lambda c: c.cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", wide(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + kept))).cast("long")


def added(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, c, in_lang (its occurrences in the language), head (true in one row of each term of a language) of the terms kept."""
    counts = docs.mapInArrow(count_terms, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    of_term = Window.partitionBy("lang", "term")
    counts = counts.withColumn("d", F.sum("d").over(of_term)).where(F.col("d") >= LEAST)
    return counts.withColumn("in_lang", F.sum("c").over(of_term)).withColumn("head", F.row_number().over(of_term.orderBy("source")) == 1).drop("d")


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, s (its number in the language from 0), n, v, n_lang, sources, counts, p0 (p of a count of 0) of each group."""
    groups = docs.select("lang", "source").distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    langs = kept.groupBy("lang").agg(F.count_if("head").alias("v"), F.sum("c").alias("n_lang"), F.count(F.lit(1)).alias("counts"))
    out = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "n_lang", "counts"])
    of_lang = Window.partitionBy("lang")
    out = out.withColumn("s", F.row_number().over(of_lang.orderBy("source")) - 1).withColumn("sources", F.count(F.lit(1)).over(of_lang))
    return out.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))))


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sum of each row of CSR values; begins has a row's first place, and the end."""
    some = np.flatnonzero(np.diff(begins))
    out = np.zeros(len(begins) - 1, np.int64)
    if len(some):
        out[some] = np.add.reduceat(values, begins[some])
    return out


def pair_sums(s: np.ndarray, term: np.ndarray, p: np.ndarray, p0: np.ndarray) -> np.ndarray:
    """For sources a and b, the sum over terms 0..max(term) of added(p of a, p of b). s, term, p: the counts that aren't zero; p0: each source's p of those that are."""
    order = np.lexsort((term, s))
    s, term, p = s[order], term[order], p[order]
    begins = np.searchsorted(s, np.arange(len(p0) + 1))
    n_terms = int(term.max()) + 1
    f = lambda a, b: (a - b) * (a - b) // b
    # all terms of a against b's p0
    out = f(p0[:, None], p0[None, :]) * (n_terms - np.diff(begins))[:, None]
    for b in range(len(p0)):
        out[:, b] += _sums(f(p, p0[b]), begins)
    # and what differs where b has the term
    base = p0[s]
    for a in range(len(p0)):
        dense = np.full(n_terms, p0[a])
        mine = slice(begins[a], begins[a + 1])
        dense[term[mine]] = p[mine]
        of_a = dense[term]
        out[a] += _sums(f(of_a, p) - f(of_a, base), begins)
    return out


def _block(counts: pa.Table, bases: pa.Table) -> pa.Table:
    columns = ["lang", "a", "b", "value"]
    if not counts.num_rows:
        return pa.table({"lang": pa.array([], pa.string()), **{c: pa.array([], pa.int64()) for c in columns[1:]}})
    term = counts["term"].combine_chunks().dictionary_encode()
    term = (term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term).indices.to_numpy().astype(np.int64)
    p0 = np.array(bases["p0s"][0].as_py(), np.int64)
    sums = pair_sums(counts["s"].to_numpy().astype(np.int64), term, counts["p"].to_numpy().astype(np.int64), p0)
    a, b = np.nonzero(~np.eye(len(p0), dtype=bool))
    return pa.table({"lang": pa.array([bases["base_lang"][0].as_py()] * len(a), pa.string()), "a": a, "b": b, "value": sums[a, b]})


def audit(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (lang, source, item, value) of each two sources of a language, and terms (lang, source, item, value) whose p is above the language's."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = materialize(kept_terms(docs), "kept")
    groups = materialize(groups_of(docs, kept), "groups")
    scored = kept.join(groups.select("lang", "source", "s", "n", "v", "n_lang", "sources", "counts"), ["lang", "source"])
    blocks = F.ceil(F.col("counts") / F.greatest(F.lit(COUNTS), F.col("sources") * F.col("sources")))
    scored = scored.select(
        "lang", "source", "s", "term", F.pmod(F.xxhash64("term"), blocks).alias("block"), share(F.col("c"), F.col("n"), F.col("v")).alias("p"), share(F.col("in_lang"), F.col("n_lang"), F.col("v")).alias("q")
    )
    scored = materialize(scored, "scored")
    terms = scored.where("p > q").select("lang", "source", F.col("term").alias("item"), added(F.col("p"), F.col("q")).alias("value"))

    bases = groups.where("v > 0").groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "p0"))), lambda x: x["p0"]).alias("p0s"))
    bases = scored.select("lang", "block").distinct().join(bases, "lang").select(F.col("lang").alias("base_lang"), F.col("block").alias("base_block"), "p0s")
    work = scored.select("lang", "block", "s", "term", "p").groupBy("lang", "block").cogroup(bases.groupBy("base_lang", "base_block"))
    sums = work.applyInArrow(_block, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    a = groups.select("lang", F.col("s").cast("long").alias("a"), "source")
    b = groups.select(F.col("lang").alias("b_lang"), F.col("s").cast("long").alias("b"), F.col("source").alias("item"))
    pairs = a.join(b, (F.col("lang") == F.col("b_lang")) & (F.col("a") != F.col("b"))).select("lang", "a", "b", "source", "item")
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    return pairs, terms


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT lang, source, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, source, t.term, count(*) AS c FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, source, t.term),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
             1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(n.n, 0) + l.v) AS p,
             1 + (1000000000::HUGEINT * (k.c + 1)) // (l.n + l.v) AS q
      FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang
      LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""


def ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    pairs, terms = audit(table(spark, sf_dir, "documents"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= TOP))
