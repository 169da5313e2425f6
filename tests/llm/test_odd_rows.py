"""Very long texts, missing ids and texts, and repeated rows, in each operator."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pytest
from helpers import documents

from nearmatch.llm import exact_dedup, html_extract, licenses, mixing, packing, simhash, spotsigs, substring_dedup, suffix_dedup, toxicity

LONG = " ".join(f"w{k}" for k in range(150_000))
NOTICE = "Licensed under the MIT License."
ROWS = [(1, LONG), (2, LONG), (2, LONG), (None, LONG), (3, None), (3, None), (None, None), (4, f"{LONG} {NOTICE}"), (5, "")]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ROWS).cache()


def _by(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=str)


def test_packing(odd):
    P = pytest.importorskip("public_tokenizers")
    got = packing.pack(odd, P.path(packing.VOCABULARY), P.PATTERN).toPandas()
    n = len(packing.Encoder(P.path(packing.VOCABULARY), P.PATTERN).encode(LONG)) // 4 + 1
    assert (got["piece"] == 0).sum() == len(ROWS) and got.groupby("sequence_id")["length"].sum().max() <= packing.SEQUENCE
    assert got[got["doc_id"] == 1]["length"].sum() == n and got[got["doc_id"] == 2]["length"].sum() == 2 * n
    assert got[got["doc_id"].isna()]["length"].sum() == n + 1 and got[got["doc_id"] == 3]["length"].sum() == 2


def test_simhash(odd):
    got = simhash.near_duplicates(odd).toPandas()
    long = got[got["doc_id"].isin([1, 2])]
    assert len(got) == len(ROWS) and long["fingerprint"].nunique() == 1 and set(long["component_id"]) == {1}
    empty = got[got["fingerprint"] == "0" * 16]
    assert len(empty) == 4 and set(empty["component_id"]) == {3}


def test_mixing(odd):
    got = mixing.mix(odd).toPandas()
    assert len(got) == len(ROWS) and sorted(got["size"]) == [0, 0, 0, 0, *[150_000] * 4, 150_005] and (got["taken"] <= 3 * got["size"]).all()
    assert mixing.mixed_documents(odd).count() == got["copies"][got["size"] > 0].sum()


def test_suffix_dedup(odd):
    n = len(LONG)
    got = _by(suffix_dedup.suffix_dedup(odd), "n_bytes", "n_removed", "n_spans")
    kept = len(NOTICE) + 1
    assert got == sorted([(1, n, n, 1), (2, n, n, 1), (2, n, n, 1), (None, n, n, 1), (3, 0, 0, 0), (3, 0, 0, 0), (None, 0, 0, 0), (4, n + kept, n, 1), (5, 0, 0, 0)], key=str)


def test_substring_dedup(odd):
    got = _by(substring_dedup.substring_dedup(odd), "n_words", "n_removed")
    n = 150_000
    assert got == sorted([(1, n, 0), (2, n, n), (2, n, n), (None, n, n), (3, 0, 0), (3, 0, 0), (None, 0, 0), (4, n + 5, n), (5, 0, 0)], key=str)


def test_toxicity(spark, odd):
    marks = spark.createDataFrame([(k, int(k % 2)) for k in range(1, 6)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd, marks).toPandas()
    assert len(got) == len(ROWS) and got["score"].between(0, 1).all() and got[got["doc_id"].isin([1, 2])]["score"].nunique() == 1
    assert got[got["doc_id"].isin([3, 5])]["score"].nunique() == 1


def test_fingerprints(odd):
    got = spotsigs.compare_edited(odd).toPandas()
    assert len(got) == len(ROWS) and got["n_chars"].max() == len(LONG) + 1 + len(NOTICE)
    of = got[got["n_chars"] == len(LONG)]
    assert len(of) == 4 and of["fingerprint"].nunique() == 1
    members, pairs = spotsigs.similar(odd)
    assert members.count() == len(ROWS) and {tuple(r)[:2] for r in pairs.collect()} <= {(1, 4)}


def test_html(spark):
    page = f"<html><body><nav>menu</nav><article><p>{LONG}</p></article></body></html>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "v", None), (3, None, "")]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    assert got["n_chars"].tolist() == [len(LONG)] * 3 + [0, 0] and got["text"][2] == LONG


def test_exact_dedup(odd):
    got = _by(exact_dedup.exact_dedup(odd), "keep_id", "group_size", "text_sha256")
    a, b, c = (sha256(t.encode()).hexdigest() for t in (LONG, "", f"{LONG} {NOTICE}"))
    assert got == sorted([(1, 1, 4, a), (2, 1, 4, a), (2, 1, 4, a), (None, 1, 4, a), (3, 3, 4, b), (3, 3, 4, b), (None, 3, 4, b), (4, 4, 1, c), (5, 3, 4, b)], key=str)
    assert exact_dedup.exact_dedup(odd).where("kept").count() == 3


def test_licenses(odd):
    got = licenses.scan_licenses(odd).toPandas()
    assert len(got) == len(ROWS) and got["license"].notna().sum() == 1
    (found,) = got[got["license"] == "MIT"].itertuples()
    assert (found.doc_id, found.span_start, found.span_end) == (4, len(LONG) + 1, len(LONG) + len(NOTICE)) and np.isclose(found.coverage, 1)
