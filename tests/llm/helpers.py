"""Small corpora with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re
from collections import Counter
from hashlib import sha256

from pyspark.sql import functions as F

#: Names that operators use inside; tables may have columns of these names too.
CLASHING = ("key", "sha", "norm", "h", "n", "fp", "size", "uid", "grp", "found", "part", "k", "score", "piece", "_key", "_id", "toxic", "bin", "spans", "lo")


def documents(spark, rows, extra=True):
    """A documents table of (doc_id, text) or (doc_id, text, source)."""
    rows = [(*r, "s")[:3] for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    if extra:
        df = df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])
    return df.repartition(3)


def corpus(seed=0, n=60, words=300):
    """Random documents with copies, near copies, shared passages, null, empty and blank texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    text = lambda k: rng.choice([" ", "\n", "  "]).join(rng.choice(vocabulary) for _ in range(k))
    passage = " ".join(rng.choice(vocabulary) for _ in range(80))
    out: list[str | None] = [None, "", " \t\n", "x", "A"]
    while len(out) < n:
        kind = rng.randrange(6)
        body = text(rng.randrange(1, words))
        if kind == 0 and len(out) > 8:
            body = rng.choice([t for t in out if t])
        elif kind == 1:
            body = f"{body} {passage} {text(20)}"
        elif kind == 2 and len(out) > 8:
            ws = rng.choice([t for t in out if t]).split(" ")
            ws[rng.randrange(len(ws))] = "changed"
            body = " ".join(ws)
        elif kind == 3:
            body = text(7) + " " + " ".join([text(5)] * 30)
        out.append(body)
    return [(3 * i % 1009 + i % 3, t) for i, t in enumerate(out)]


def brute_bytes(rows, length):
    c: Counter = Counter()
    for _, t in rows:
        b = (t or "").encode()
        c.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if c[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        starts = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), starts, sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def brute_words(rows, length):
    first: dict = {}
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    for i in sorted(split):
        for k in range(len(split[i]) - length + 1):
            first.setdefault(tuple(split[i][k : k + length]), i)
    out = {}
    for i, ws in split.items():
        gone = [False] * len(ws)
        for k in range(len(ws) - length + 1):
            if first[tuple(ws[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        out[i] = (len(ws), sum(gone), sha256(" ".join(w for w, g in zip(ws, gone) if not g).encode()).hexdigest())
    return out
