"""Toxicity scores from class-conditional Kneser-Ney models.

Counts are of documents: how many toxic and how many ordinary ones hold a word
or an expression (two words in a row). Each class's model of words takes a
discount off its counts, and gives what that leaves to continuation counts,
of the different words that precede a word in either class; the models of
expressions give it to the counts of both classes together. Backing off to the same
counts, a rare word or expression weighs nothing until one class uses it more.
Discounts are estimated from how many n-grams occur one to four times.

A place in a text has the log-likelihood ratio, toxic to ordinary, of its word
or of the expression that ends there, whichever is larger, above that of an
unknown word. A text's evidence is length-normalised: the power mean of order
``POWER`` of its places, in which a few toxic expressions in a long text count
without its length counting. One slope and one offset, fitted on labelled
documents that the models have not seen, make it a score.

Labels are learnt from rows of the training folds alone (``crc32(doc_id) mod
5`` is not 0), at most ``SAMPLE`` documents of each class, the first by a hash
of the doc_id; whole texts are counted, copies in the sample once. The model
keeps every word and expression that more than one document has; those of one
document say no more than unknown ones. They stand in it as 64-bit hashes in
sorted arrays; its size grows with the sample.

Defined results: null and empty texts have no words and get the score of no
evidence; without labels of both classes the score is the share of toxic
labels (0 without any); repeated label rows of a document count once, as
toxic if one says so; null labels are left out; repeated documents score
alike; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmatch.llm.common import materialize, table, text_batches

SAMPLE = 20_000
#: Words whose hashes a Python worker remembers.
SEEN = 50_000
#: Words that a Python worker scores, and keys that it counts, at once.
HELD = 50_000
#: Discounts of counts 1, 2 and 3 or more where too few n-grams occur one to four times to estimate them.
DISCOUNT = 0.75
#: Of the power mean: a power of 2.
POWER = 8
FOLDS = 5
#: Of the labelled sample, one in so many documents fits slope and offset, the others the models.
CALIBRATION = 4
#: Keeps the slope of a small sample small.
RIDGE = 0.1

_words = re.compile(r"\w+").findall
_ODD = np.int64(-7046029254386353131)


def words_of(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


class Vocabulary:
    """64-bit hashes of words, and what else is known of each; those of the last SEEN words are kept."""

    def __init__(self, known: Callable[[np.ndarray], np.ndarray] | None = None) -> None:
        self.places: dict[str, int] = {}
        self.hashes = np.zeros(0, np.int64)
        self.known, self.values = known, np.zeros(0)

    def ids(self, words: list[str]) -> np.ndarray:
        """A place in hashes and values of each word."""
        from xxhash import xxh64_intdigest

        new = set(words).difference(self.places)
        if new and len(self.places) + len(new) > SEEN:
            self.__init__(self.known)
            new = set(words)
        if new:
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
            hashes = np.array([xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in new], np.uint64).view(np.int64)
            self.hashes = np.concatenate([self.hashes, hashes])
            if self.known:
                self.values = np.concatenate([self.values, self.known(hashes)])
        return np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))


def expressions(ids: np.ndarray) -> np.ndarray:
    """A key of each word with the one before it, from the second on."""
    with np.errstate(over="ignore"):
        key = ids[:-1] * _ODD + ids[1:]
        return (key ^ (key >> np.int64(29))) * _ODD


def find(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted in the sorted values, and whether they are there."""
    if not len(values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(values, wanted)
    at[at == len(values)] = 0
    return at, values[at] == wanted


class Model:
    """Log-likelihood ratios, toxic to ordinary. Word 0 stands for every word that the model doesn't know."""

    def __init__(self, words: np.ndarray, word: np.ndarray, bigrams: np.ndarray, bigram: np.ndarray) -> None:
        self.words, self.word = words, word  # hashes of words 1 and up, sorted, and ratios
        self.bigrams, self.bigram = bigrams, bigram  # keys of expressions, sorted, and ratios
        self.ready = False

    def __getstate__(self) -> dict:
        return {c: getattr(self, c) for c in ("words", "word", "bigrams", "bigram")} | {"ready": False}

    def _prepare(self) -> None:
        """What a worker adds to a model: a table of 2^bits flags of the keys, and the words it has seen."""
        self.bits = max(10, min(24, int(len(self.bigrams)).bit_length() + 3))
        self.flags = np.zeros(1 << self.bits, bool)
        self.flags[self._flag(self.bigrams)] = True
        self.vocabulary = Vocabulary(self._ratios)
        self.ready = True

    def _flag(self, keys: np.ndarray) -> np.ndarray:
        return keys.view(np.uint64) >> np.uint64(64 - self.bits)

    def _ratios(self, hashes: np.ndarray) -> np.ndarray:
        """Of words, above that of an unknown word."""
        at, known = find(self.words, hashes)
        return self.word[np.where(known, at + 1, 0)].astype(float) - self.word[0]

    def features(self, text: str | None) -> tuple[int, float, float]:
        """Number of words, mean and power mean of their ratios above an unknown word's."""
        n, mean, evidence = self.features_of([text])
        return int(n[0]), float(mean[0]), float(evidence[0])

    def features_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.ready:
            self._prepare()
        out = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
        first, words, sizes = 0, [], []
        for k, text in enumerate(texts):
            found = words_of(text)
            words += found
            sizes.append(len(found))
            if len(words) >= HELD or k == len(texts) - 1:
                for whole, part in zip(out, self._slice(words, np.array(sizes))):
                    whole[first : k + 1] = part
                first, words, sizes = k + 1, [], []
        return out

    def _slice(self, words: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mean, evidence = np.zeros(len(n)), np.zeros(len(n))
        if not words:
            return n, mean, evidence
        ids = self.vocabulary.ids(words)
        ratio = self.vocabulary.values[ids]
        some = np.flatnonzero(n)
        begins = (np.cumsum(n) - n)[some]
        if len(ids) > 1:
            keys = expressions(self.vocabulary.hashes[ids])
            maybe = self.flags[self._flag(keys)]
            maybe[begins[1:] - 1] = False  # the first word of a text ends no expression
            maybe = np.flatnonzero(maybe)
            maybe = maybe[np.argsort(keys[maybe])]  # in order, neighbours in the model are near in memory
            at, known = find(self.bigrams, keys[maybe])
            place = maybe[known] + 1
            ratio[place] = np.maximum(ratio[place], self.bigram[at[known]])
        power = np.maximum(ratio, 0.0)
        for _ in range(POWER.bit_length() - 1):
            power *= power
        mean[some] = np.add.reduceat(ratio, begins) / n[some]
        evidence[some] = (np.add.reduceat(power, begins) / n[some]) ** (1 / POWER)
        return n, mean, evidence


@dataclass
class Scorer:
    """A model that the executors share, and how its evidence becomes a score."""

    shared: Broadcast | None
    prior: float
    slope: float = 0.0
    offset: float = 0.0

    def of(self, texts: list[str | None]) -> np.ndarray:
        if self.shared is None:
            return np.full(len(texts), self.prior)
        model = self.shared.value
        evidence = model.features_of(texts)[2]
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * evidence, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> tuple[float, float]:
    """Slope and offset by Newton's steps; the slope, in units of x's spread, is penalised."""
    mean, spread = x.mean(), x.std() + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w, penalty = np.zeros(2), np.array([1e-6, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[1] / spread, w[0] - w[1] * mean / spread


def _counts(sample: DataFrame) -> DataFrame:
    """key, w, n0, n1: how many ordinary and toxic documents hold a word (w is null) or an expression that ends with the word w."""

    def batch(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, last = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        toxic = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
        # a word's last is 0; no word's expression meets it but by the chance of two equal 64-bit hashes
        keys, first, place, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        n1 = np.bincount(place, weights=toxic, minlength=len(keys)).astype(np.int64)
        last = last[first]
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(last, mask=last == 0), pa.array(n - n1), pa.array(n1)], names=["key", "w", "n0", "n1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        parts: list[tuple[int, np.ndarray, np.ndarray]] = []
        held = 0
        for b in batches:
            for row in range(b.num_rows):
                toxic, found = b.column(0)[row].as_py(), words_of(b.column(1)[row].as_py())
                if not found:
                    continue
                at = vocabulary.ids(found)
                ids = vocabulary.hashes[at]
                words = np.unique(ids)
                pairs, first = np.unique(expressions(ids), return_index=True)
                parts += [(toxic, words, np.zeros(len(words), np.int64)), (toxic, pairs, ids[1:][first])]
                held += len(words) + len(pairs)
                if held >= HELD:
                    yield batch(parts)
                    parts, held = [], 0
        if parts:
            yield batch(parts)

    rows = sample.select("toxic", "text").mapInArrow(run, "key long, w long, n0 long, n1 long")
    return rows.groupBy("key", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def discounts(times: list[int]) -> list[float]:
    """What to take off counts of 1, 2 and 3 or more, from how many n-grams occur one, two, three and four times."""
    if min(times) == 0:
        return [DISCOUNT] * 3
    y = times[0] / (times[0] + 2 * times[1])
    return [min(max(k - (k + 1) * y * times[k] / times[k - 1], 0.1), k) for k in (1, 2, 3)]


def _rest(counts: DataFrame, shared: Column) -> tuple[Column, list[float]]:
    """The log-likelihood ratio of counts(n0, n1), backing off to the column shared, and each class's share that goes there."""
    seen = [F.sum((F.col(f"n{c}") == k).cast("long")) for c in (0, 1) for k in (1, 2, 3, 4)]
    more = [F.sum((F.col(f"n{c}") > 2).cast("long")) for c in (0, 1)]
    row = [int(x or 0) for x in counts.agg(*seen, *more, F.sum("n0"), F.sum("n1")).first()]
    p, left = [], []
    for c in (0, 1):
        times, total = row[4 * c : 4 * c + 4], max(1, row[10 + c])
        off = discounts(times)
        left.append(max(1e-9, (off[0] * times[0] + off[1] * times[1] + off[2] * row[8 + c]) / total))
        n = F.col(f"n{c}")
        taken = F.when(n == 0, 0.0).when(n == 1, off[0]).when(n == 2, off[1]).otherwise(off[2])
        p.append((n - taken) / F.lit(float(total)) + F.lit(left[c]) * shared)
    return F.log(p[1] / p[0]).cast("float"), left


def _columns(df: DataFrame) -> list[np.ndarray]:
    found = df.orderBy("key").toArrow()
    return [c.to_numpy() for c in found.columns]


def _language_models(counts: DataFrame) -> Model:
    """Kneser-Ney ratios from the counts. Only keys of more than one document and their ratios reach the driver."""
    singles, both = counts.where("w IS NULL").drop("w"), counts.where("w IS NOT NULL")
    before = both.groupBy(F.col("w").alias("key")).agg(F.count(F.lit(1)).alias("before"))
    words = singles.join(before, "key", "left").fillna({"before": 0})
    size = both.count() + singles.count() + 1
    ratio, left = _rest(singles, (F.col("before") + 1) / F.lit(float(size)))
    known, word = _columns(words.where("n0 + n1 > 1").select("key", ratio.alias("ratio")))
    total = both.agg(F.sum(F.col("n0") + F.col("n1"))).first()[0] or 1
    ratio, _ = _rest(both, (F.col("n0") + F.col("n1")) / F.lit(float(total)))
    keys, bigram = _columns(both.where("n0 + n1 > 1").select("key", ratio.alias("ratio")))
    unknown = np.float32(np.log(left[1] / left[0]))
    return Model(known, np.concatenate([[unknown], word]).astype(np.float32), keys, bigram)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """The scorer of docs(doc_id, text) and labels(doc_id, toxic), from the training folds."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    marks = marks.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0).withColumn("place", F.xxhash64("doc_id", F.lit(5)))
    chosen = [marks.where(F.col("toxic") == c).orderBy("place", "doc_id").limit(sample) for c in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1]).withColumn("calibrates", F.pmod("place", F.lit(CALIBRATION)) == 0)
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "calibrates", "text"), "labelled")
    n = {(r["toxic"], r["calibrates"]): r["count"] for r in rows.groupBy("toxic", "calibrates").count().collect()}
    total, toxic = sum(n.values()), sum(v for k, v in n.items() if k[0] == 1)
    prior = toxic / total if total else 0.0
    if not (n.get((0, False)) and n.get((1, False))):
        return Scorer(None, prior)
    counted = rows.where("NOT calibrates").dropDuplicates(["toxic", "text"])
    model = _language_models(materialize(_counts(counted), "ngrams"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    del model
    held = rows.where("calibrates") if n.get((0, True)) and n.get((1, True)) else rows
    found = features(held.select("toxic", "text"), shared, ["toxic"]).toArrow()
    x, y = found["evidence"].to_numpy(), found["toxic"].to_numpy().astype(float)
    slope, offset = logistic(x, y)
    # both classes were sampled up to the same number: weigh back to the shares of all training rows
    share = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    mean = y.mean()
    offset += np.log(share.get(1, 1) / share.get(0, 1)) - np.log(mean / (1 - mean))
    return Scorer(shared, prior, float(slope), float(offset))


def features(rows: DataFrame, shared: Broadcast, keep: list[str]) -> DataFrame:
    """The columns in keep, and words, mean and evidence of each row's text."""
    source = rows.select(*keep, "text")
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *map(pa.array, m.features_of(b.column(n).to_pylist()))], names=[*keep, "words", "mean", "evidence"])

    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{kinds}, words long, mean double, evidence double")


def score(docs: DataFrame, scorer: Scorer, keep: list[str]) -> DataFrame:
    """The columns in keep, score and predicted of each row of docs."""
    source = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)
    at = source.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scorer.of(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{kinds}, score double, predicted int")


def keep_ordinary(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows of docs that are not predicted to be toxic, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scorer.of(b.column(at).to_pylist()) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs(doc_id, text)."""
    docs = docs.select("doc_id", "text")
    scored = score(docs, fit(docs, labels), ["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
