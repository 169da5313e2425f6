from __future__ import annotations

import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from helpers import corpus, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from nearmatch.llm import html_extract, licenses, mixing, packing, spotsigs, toxicity

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(P.path(packing.VOCABULARY), P.PATTERN)


@pytest.mark.parametrize("text", ["", " ", "a", "It's  two\n\nlines\t x ", " lead", "trail ", " nbsp   wide", "漢字 café 123abc !?%$ <|endoftext|> \x1c\x1d a", "\r\n x\r\ny", "don't we'll they're"])
def test_encoder_matches_the_tokenizer(encoder, reference_ids, text):
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference_ids(text)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoder_matches_on_any_text(text):
    if any(0xD800 <= ord(c) <= 0xDFFF for c in text):
        return
    from tokenizers import Tokenizer

    global _T, _E
    try:
        t, e = _T, _E
    except NameError:
        t, e = _T, _E = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.Encoder(P.path(packing.VOCABULARY), P.PATTERN)
        t.encode_special_tokens = True
    assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_encoder_matches_on_whole_and_long_texts(encoder, reference_ids):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()]
    texts += ["word " * 50_000, "x" * 100_000, "  \n\t" * 20_000, "漢字かな" * 20_000, "".join(texts)]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == reference_ids(t)


def test_packing(spark, reference_ids):
    rows = corpus(6, words=900) + [(2000, "w " * 3000)]
    rows += [rows[7]]
    got = packing.pack(documents(spark, rows), P.path(packing.VOCABULARY), P.PATTERN, group=20).toPandas()
    ids: dict = {}
    for i, t in rows:
        ids.setdefault(i, (reference_ids(t or "") + [2], []))[1].append(1)
    assert got.groupby("doc_id")["length"].sum().to_dict() == {i: len(x) * len(n) for i, (x, n) in ids.items()}
    for r in got.itertuples():
        assert zlib.crc32(np.array(ids[r.doc_id][0][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for _, x in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert x["offset"].tolist() == [0, *x["length"].cumsum().tolist()[:-1]] and x["length"].sum() <= packing.SEQUENCE
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // packing.SEQUENCE) + 3
    assert packing.pack(documents(spark, []), P.path(packing.VOCABULARY), P.PATTERN).count() == 0


@given(st.lists(st.integers(1, 100), max_size=80))
@settings(max_examples=60, deadline=None)
def test_local_search_keeps_pieces_and_never_adds_bins(lengths):
    first = packing.best_fit(np.array(lengths, np.int64), 100)
    n, squares = len(first), sum(sum(lengths[i] for i in b) ** 2 for b in first)
    after = packing.local_search([list(b) for b in first], lengths, 100)
    assert sorted(i for b in after for i in b) == list(range(len(lengths)))
    assert len(after) <= n and all(sum(lengths[i] for i in b) <= 100 for b in after)
    assert sum(sum(lengths[i] for i in b) ** 2 for b in after) >= squares


def test_local_search_empties_a_bin():
    lengths = [60, 60, 40, 40]
    assert len(packing.local_search([[0], [1], [2, 3]], lengths, 100)) == 2


def test_local_search_takes_two_from_any_bin():
    lengths = [60, 30, 20, 20, 45] + [42, 41] * 20  # two of the second bin for one of the first fill it
    after = packing.local_search([[0, 1], [2, 3, 4]] + [[k, k + 1] for k in range(5, 45, 2)], lengths, 100)
    assert sorted(i for b in after for i in b) == list(range(45)) and any({0, 2, 3} == set(b) for b in after)


def test_packing_merges_the_emptiest_bins_of_all_groups(spark, reference_ids):
    n = len(reference_ids("w " * 270))
    rows = [(i, "w " * 270) for i in range(97)]
    got = packing.pack(documents(spark, rows), P.path(packing.VOCABULARY), P.PATTERN, group=10).toPandas()
    assert sorted(got["doc_id"]) == list(range(97)) and (got.groupby("sequence_id")["length"].sum() <= packing.SEQUENCE).all()
    assert n == 271 and got["sequence_id"].nunique() == 33  # three fit in one; without the merge there are 34


def test_mixing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 60)), None if i % 10 == 0 else f"s{min(i % 7, 3)}") for i in range(900)] + [(5, "a b", "s1"), (5, "a b", "s1"), (1000, None, "empty")]
    a = mixing.mix(documents(spark, rows)).toPandas()
    b = mixing.mix(documents(spark, rows).repartition(5)).toPandas()
    order = ["doc_id", "size", "taken"]
    assert a[order].sort_values(order).values.tolist() == b[order].sort_values(order).values.tolist()
    assert len(a) == len(rows) and (a["taken"] <= 3 * a["size"]).all() and (a["taken"] % a["size"].clip(lower=1) == 0).all()
    for _, g in a.groupby(["target", "source_size"]):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 60
    assert abs(a.groupby(["target", "source_size"]).first().reset_index()["target"].sum() - a["size"].sum()) < 1e-6  # no two sources of this table share both
    assert mixing.mix(documents(spark, [])).count() == 0


def test_mixing_reduction_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = [(i, "w " * (i % 40 + 1), "hot" if i % 3 else "cold") for i in range(600)]
    a = mixing.mix(documents(spark, rows)).toPandas()
    assert len(a) == 600
    for _, g in a.groupby("target"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 40


def test_targets_reshare_the_excess(spark):
    rows = [("a", 100), ("b", 10), ("c", 10), (None, 500), ("d", 0)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    # weights: a 1, b 2, c 3, d 1, null 2; b, c and d are full at 30, 30 and 0; the rest goes 1 to 2, to a and null
    assert got == pytest.approx({"a": 560 / 3, "b": 30, "c": 30, "d": 0, None: 1120 / 3})


def test_pivotal_keeps_mass_and_means():
    size, p = np.array([5.0, 5, 5, 5]), np.array([0.5, 0.25, 0.75, 0.5])
    total = np.zeros(4)
    for k in range(4000):
        out, at = mixing.pivotal(size, p, mixing._uniform(np.arange(4) + 4 * k, 1))
        assert at < 0 and out.sum() == pytest.approx(2)
        total += out
    assert np.allclose(total / 4000, p, atol=0.03)


@given(st.lists(st.tuples(st.integers(1, 60), st.booleans()), min_size=1, max_size=30), st.floats(0.01, 0.99), st.floats(0, 0.999))
@settings(max_examples=100, deadline=None)
def test_settling_leaves_what_no_flip_or_exchange_lessens(docs, share, u):
    size = np.array([7, *(n for n, _ in docs)])
    p = np.array([share, *(float(x) for _, x in docs)])
    out = mixing.settle(size, p, 0, u)
    assert set(out.tolist()) <= {0.0, 1.0} and out[0] == float(u < share)
    first = int(round((out[0] - share) * 7))
    error = first + int(((out - p) * size)[1:].sum())
    assert abs(error) <= abs(first)
    for drop in [0, *size[1:][out[1:] == 1]]:
        for add in [0, *size[1:][out[1:] == 0]]:
            assert abs(error - drop + add) >= abs(error)


def test_mixed_documents(spark):
    df = documents(spark, [(1, "a b c", "x"), (2, "d", "y"), (3, None, "y")])
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and 3 not in {r["doc_id"] for r in out.collect()}


def _toxic_corpus():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(600):
        ws = [f"w{k}" for k in rng.integers(0, 300, 40)]
        bad = i % 5 == 0
        if bad:
            ws[10] = ws[30] = "vile"
        rows.append((i, " ".join(ws)))
        if i % 10 != 9:
            labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = _toxic_corpus()
    rows += [(1000, None), (1001, ""), (1002, "vile vile"), (0, rows[0][1])]
    marks = spark.createDataFrame([*labels, (3, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(documents(spark, rows), marks).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    held = got[got["held_out"] & (got["doc_id"] < 600)]
    assert ((held["predicted"] == 1) == (held["doc_id"] % 5 == 0)).mean() > 0.97
    by = got.set_index("doc_id")["predicted"]
    assert by[1000] == by[1001] == 0 and by[1002] == 1


def test_toxicity_keeps_every_repeated_bigram(spark):
    rows = [(int(i > 200), " ".join(f"w{i // 2}x{k}" for k in range(1000))) for i in range(240)] + [(1, "zz vile once")] * 2 + [(0, "never seen")]
    model = toxicity._language_models(toxicity._counts(spark.createDataFrame(rows, "toxic int, text string")))
    assert len(model.word) == 1 + 120 * 1000 + 3 and len(model.bigrams) == 120 * 999 + 2
    assert model.features("zz vile")[2] > model.features("never seen")[2] == model.features("new words")[2]


def _kneser_ney(rows, text):
    """The evidence of a text, from the definition: dictionaries of document counts."""
    import math
    from collections import Counter

    split = [(c, re.findall(r"\w+", t.lower())) for c, t in rows]
    words, pairs = (Counter(), Counter()), (Counter(), Counter())
    for c, ws in split:
        words[c].update(set(ws))
        pairs[c].update(set(zip(ws, ws[1:])))
    before = Counter(w for _, w in set(pairs[0]) | set(pairs[1]))
    size = len(set(words[0]) | set(words[1])) + len(set(pairs[0]) | set(pairs[1])) + 1

    def model(counts, shared):
        ratio, left = {}, []
        for c in (0, 1):
            times = [sum(n == k for n in counts[c].values()) for k in (1, 2, 3, 4)]
            y = times[0] / (times[0] + 2 * times[1]) if all(times) else 0
            off = [min(max(k - (k + 1) * y * times[k] / times[k - 1], 0.1), k) for k in (1, 2, 3)] if all(times) else [0.75] * 3
            total = sum(counts[c].values())
            taken = {x: off[min(n, 3) - 1] for x, n in counts[c].items()}
            left.append(sum(taken.values()) / total)
            for x in set(counts[0]) | set(counts[1]):
                ratio.setdefault(x, []).append((counts[c][x] - taken.get(x, 0)) / total + left[c] * shared(x))
        many = {x: math.log(p[1] / p[0]) for x, p in ratio.items() if counts[0][x] + counts[1][x] > 1}
        return many, math.log(left[1] / left[0])

    total = sum(pairs[0].values()) + sum(pairs[1].values())
    word, unknown = model(words, lambda w: (before[w] + 1) / size)
    pair, _ = model(pairs, lambda x: (pairs[0][x] + pairs[1][x]) / total)
    ws = re.findall(r"\w+", text.lower())
    places = [max(word.get(w, unknown) - unknown, pair.get((ws[k - 1], w), -math.inf) if k else -math.inf) for k, w in enumerate(ws)]
    return (sum(max(x, 0) ** 8 for x in places) / len(places)) ** (1 / 8) if places else 0.0


def test_toxicity_is_the_model_of_its_definition(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        ws = [f"w{int(k)}" for k in rng.zipf(1.4, 60) if k < 400]
        rows.append((int(i % 4 == 0), " ".join([*ws, *(["so", "vile"] if i % 4 == 0 else []), *(["so", "nice"] if i % 3 == 0 else [])])))
    model = toxicity._language_models(toxicity._counts(spark.createDataFrame(rows, "toxic int, text string")))
    texts = [*(t for _, t in rows[:30]), "", None, "unheard of", "so vile", "x " * 50 + "vile"]
    got = model.features_of(texts)
    assert got[2].tolist() == pytest.approx([_kneser_ney(rows, t or "") for t in texts], abs=1e-5)
    assert got[0].tolist() == [len(re.findall(r"\w+", t or "")) for t in texts]


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(documents(spark, [(1, "a"), (2, None)]), none).collect()} == {0.0}
    assert toxicity.toxicity(documents(spark, []), none).count() == 0


@pytest.mark.parametrize("part", [1, 4, 4000])
def test_fingerprints(spark, part):
    rows = sorted(corpus(8))
    got = {r["doc_id"]: r for r in spotsigs.compare_edited(documents(spark, rows), part).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        a, b, c = (set(spotsigs.signatures(x).tolist()) for x in (t, new, following))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha256(new.encode()).hexdigest())
        assert (r["near_edited"], r["near_next"]) == pytest.approx((len(a & b) / len(a | b), len(a & c) / len(a | c)))
        assert (r["fingerprint"] == r["edited_fingerprint"]) >= (t == new)


def _spots(text):
    """Signatures by the definition, as text."""
    ws = re.findall(r"\w+", text.lower())
    if not ws:
        return {text}
    out = set()
    for k in range(-1, len(ws)):
        if k < 0 or ws[k] in spotsigs.COMMON:
            out.add(" ".join(["" if k < 0 else ws[k], *[w for w in ws[k + 1 :] if w not in spotsigs.COMMON][:2]]))
    return out


def test_fingerprints_are_the_signature_sets(spark):
    rows = sorted([*corpus(9), (9000, "the cat and the dog sat"), (9001, "The cat, and the dog sat."), (9002, "?!"), (9003, "of the"), (9004, "cat")])
    got = {r["doc_id"]: r for r in spotsigs.compare_edited(documents(spark, rows)).collect()}
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        a, b, c = _spots(t), _spots(spotsigs.edited(t, following)), _spots(following)
        r = got[i]
        assert len(r["fingerprint"]) == 8 * len(a) and len(r["edited_fingerprint"]) == 8 * len(b)
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b)) == spotsigs.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == pytest.approx(len(a & c) / len(a | c))
    assert got[9000]["near_next"] == 1.0 and got[9000]["fingerprint"] == got[9001]["fingerprint"]


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_similar_documents_against_all_pairs(spark, threshold):
    rows = corpus(10, n=90, words=120) + [(7000, "the cat"), (7001, "the cat"), (7002, None), (7003, "")]
    rng = np.random.default_rng(5)
    base = [f"w{k} the" for k in range(60)]
    rows += [(8000 + k, " ".join(w for w in base if rng.random() > 0.06)) for k in range(25)]
    members, pairs = spotsigs.similar(documents(spark, rows), threshold)
    sets = {i: frozenset(_spots(t or "")) for i, t in rows}
    named = {s: min(i for i in sets if sets[i] == s) for s in set(sets.values())}
    assert {r["doc_id"]: r["class_id"] for r in members.collect()} == {i: named[s] for i, s in sets.items()}
    want = {(x, y): len(s & t) / len(s | t) for s, x in named.items() for t, y in named.items() if x < y and len(s & t) >= threshold * len(s | t)}
    got = {(r["a"], r["b"]): r["likeness"] for r in pairs.collect()}
    assert len(want) > 5 and got == pytest.approx(want) and pairs.count() == len(want)


def test_fingerprints_edges(spark):
    assert spotsigs.compare_edited(documents(spark, [])).count() == 0
    alone = spotsigs.compare_edited(documents(spark, [(4, "the one alone")])).first()
    assert alone["near_next"] == 1.0
    ties = spotsigs.compare_edited(documents(spark, [(1, "b"), (1, "a"), (2, None)]), 1).collect()
    assert len(ties) == 3
    assert spotsigs.jaccard(np.arange(10), np.arange(5, 15), 0.8) == 0.0 and spotsigs.jaccard(np.arange(10), np.arange(1, 11), 0.8) == pytest.approx(9 / 11)
    assert abs(spotsigs.length_part(10, 0.8) - spotsigs.length_part(8, 0.8)) <= 1


PAGE = """<html><head><title>No</title><style>p{}</style></head><body><header>Top</header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies</div><aside>Side</aside><article><h1>Head &amp; more</h1><p>First  <b>bold</b>ly
said.</p><form><input>Mail</form><p>Short.</p><script>var x="<p>no</p>"</script><div id="comments"><p>reader says a long thing here</p></div></article><footer>&copy; me</footer></body></html>"""


def test_html():
    assert html_extract.extract(PAGE) == "Head & more First boldly said. Short."
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<nav>x</nav>") == ""
    plain = "<body><div><a>a</a><a>b</a></div>" + "<p>" + "long sentence of the main text " * 8 + "</p><p>Brief.</p><p>" + "more of the main text follows " * 8 + "</p></body>"
    assert "Brief." in html_extract.extract(plain) and not html_extract.extract(plain).startswith("a")


def test_html_containers():
    page = '<body class="has-sidebar"><div class="no-sidebar wrap"><main class="with-sidebar"><article class="post header-style"><p>Kept text.</p></article><article class="comment"><p>Reader.</p></article></main></div></body>'
    assert html_extract.extract(page) == "Kept text."
    assert html_extract.extract('<main><p>In.</p><div class="ad">Out.<p>Out.</p></div><p>Also &lt;in&gt;.</p></main>') == "In. Also <in>."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<article><p class="notice">Note<p>Text</p><p>More</p></article>', "Text More"),
        ('<article><p class="notice">Note<b> bold<h2>Head</h2><p>More</article>', "Head More"),
        ('<article><p class="notice">Note<p class="ad">Advert<p>Text</article>', "Text"),
        ('<article><div><p class="notice">Note</div>Text</article>', "Text"),
        ('<article><ul><li class="promo">Buy<ul><li>inner<li>inner</ul>buy<li>Text<li>More</ul></article>', "Text More"),
        ('<article><ul><li>Text<li class="promo">Buy</ul><p>More</article>', "Text More"),
        ('<article><dl><dt class="ad">Buy<dd>Text</dl></article>', "Text"),
        ('<article><table><tr><td class="ad">Buy<table><tr><td>inner</table>buy<td>Text<tr class="ad"><td>Buy<td>buy<tr><td>More</table></article>', "Text More"),
        ('<article><div class="ad">Buy<p>buy<p>buy<ul><li>buy</ul></div>Text</article>', "Text"),
        ('<article><p class="notice">Note <button>a<p>b</button> c</p>Text</article>', "Text"),
        ('<article><option>One<option>Two</option>Text</article>', "Text"),
    ],
)
def test_html_ends_that_are_left_out(html, text):
    assert html_extract.extract(html) == text


LONG = "a long sentence of the main text that goes on " * 6


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><form><p>{LONG}</p><p>{LONG}</p></form><p>{LONG}</p></body>", " ".join([LONG.strip()] * 3)),
        (f"<body><form action=x><article><p>{LONG}</p><p>Short.</p></article></form></body>", f"{LONG}Short."),
        (f"<body><p>{LONG}</p><form><p>Send us your mail</p></form><p>{LONG}</p></body>", f"{LONG}{LONG.strip()}"),
        (f"<body><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul><article><p>{LONG}</p><p>End.</p></article></body>", f"{LONG}End."),
        (f"<body><nav><a href=x>Home</a><p>{LONG}</p><p>{LONG}</p>", f"{LONG}{LONG.strip()}"),
        (f'<body><article><div class="ad"><p>{LONG}</article><p>x', LONG.strip()),
        (f"<article><p>{LONG}</p><script>var x = 1;", LONG.strip()),
        ("<![foo[bar]]><p>x</p>", "x"),
        ("<![CDATA[<p>]]><p>x</p>", "]]> x"),
        ("<![x>y", "y"),
        (f"<article><h2>Two lines</h2><p>of an advert</p></article><div><p>{LONG}</p><p>{LONG}</p></div>", f"Two lines of an advert {LONG}{LONG.strip()}"),
        (f"<article><p>{LONG}</p><p>{LONG}</p></article><div><p>{LONG}</p></div>", f"{LONG}{LONG.strip()}"),
    ],
)
def test_html_forms_open_elements_and_teasers(html, text):
    assert html_extract.extract(html) == text


def test_html_ratio_decides_inside_an_article():
    links = "".join(f"<li><a href={k}>Another story number {k}</a></li>" for k in range(12))
    page = f"<body><article><p>{LONG}</p><p>Brief.</p><p><a href=z>A link of its own</a></p><p>{LONG}</p><ul>{links}</ul></article></body>"
    got = html_extract.extract(page)
    assert got.startswith(f"{LONG}Brief. A link of its own {LONG.strip()}") and "number 11" not in got


def test_html_smoothing_and_clusters_by_definition():
    rng = np.random.default_rng(2)
    for _ in range(50):
        ratios = rng.choice([0.0, 2.0, 30.0, 300.0], int(rng.integers(1, 30))).tolist()
        weight = lambda i, k: np.exp(-((i - k) ** 2) / 4.5) if abs(i - k) <= 4 else 0.0
        n = len(ratios)
        smoothed = [sum(weight(i, k) * ratios[k] for k in range(n)) / sum(weight(i, k) for k in range(n)) for i in range(n)]
        assert html_extract.smooth(ratios) == pytest.approx(smoothed)
        lines = [html_extract._Line(f"t{k}", r, 1, 0) for k, r in enumerate(ratios)]
        limit = min(np.mean(smoothed), np.std(smoothed))
        if np.std(smoothed) > 1e-6:
            assert html_extract.select(lines) == [f"t{k}" for k in range(n) if smoothed[k] >= 0.02 * limit]


@given(st.lists(st.sampled_from(["<p>", "</p>", "<nav>", "</nav>", "<article>", "</article>", "<form>", "</form>", "<li class=ad>", "<![", "]]>", "<!", "<?", "&#x110000;", "&amp", "<a", " href='", "text ", "<script>", "</script>", "<title>", "\x00", "<!--", "-->", ">", "</", "<svg/>", "<td>"]), max_size=40))
@settings(max_examples=300, deadline=None)
def test_html_of_any_kind_has_a_text(parts):
    assert isinstance(html_extract.extract("".join(parts)), str)


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y"), (3, "v", "<p>unclosed <b>text", "z")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_extract.extract_pages(df).collect()), key=str)
    assert [(r[0], r[3]) for r in got] == [(1, 37), (1, 37), (2, 0), (3, 13)]
    assert html_extract.extract_pages(df.where("false")).count() == 0


def test_licenses(spark):
    rows = [
        (1, "Some code.\nLicensed under the Apache License, Version 2.0.\nmore"),
        (2, "Permission is hereby granted, free of charge, to any individual obtaining a copy of this software and the associated documentation files (the Software), to deal in the Software without any restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to these following conditions:"),
        (3, "This is the text of a licensed driver under the bridge"),
        (4, None),
        (5, ""),
        (6, "Released under the MIT License. And then: released under the MIT license."),
    ]
    got = licenses.scan_licenses(documents(spark, rows)).toPandas()
    found = {i: g["license"].dropna().tolist() for i, g in got.groupby("doc_id")}
    assert found == {1: ["Apache-2.0"], 2: ["MIT"], 3: [], 4: [], 5: [], 6: ["MIT", "MIT"]}
    one = got[got["doc_id"] == 1].iloc[0]
    assert rows[0][1][int(one["span_start"]) : int(one["span_end"])] == "Licensed under the Apache License, Version 2.0" and one["coverage"] == 1.0
    assert 0.8 <= got[got["doc_id"] == 2].iloc[0]["coverage"] < 1
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Licensed under the ISC License.", "ISC"),
        ("Licensed under the WTFPL License.", None),
        ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"),
        ("Licensed under CC BY NC 4.0.", None),
        ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
        ("Licensed under CC BY 1.0.", None),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
        ("This work is licensed under the GNU Lesser General Public License, version 2.", None),
        ("This work is licensed under the GNU Library General Public License, version 2.", None),
        ("This work is licenced under the GNU General Public License, version 3.0.", "GPL-3.0"),
        ("This work is licensed under the GNU General Public License v2.", "GPL-2.0"),
        ("This work is licensed under a Creative Commons Attribution 4.0 License.", "CC-BY-4.0"),
        ("Licensed under the Apache License 2.0.", "Apache-2.0"),
        ("Licensed under the BSD 3-Clause Clear License.", None),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
    ],
)
def test_licenses_by_name_and_version(text, name):
    assert [m[0] for m in licenses.Scanner(licenses.TEMPLATES).scan(f"Code. {text} More text.")] == ([name] if name else [])


@pytest.mark.parametrize("before", ["İstanbul ", "İİİ x ", "ǅ ", "\u0345 ", "ΑΣ "])
@pytest.mark.parametrize("after", ["", " more words and İ"])
def test_licenses_spans_where_small_letters_are_longer(before, after):
    text = f"{before}Licensed under the MIT License.{after}"
    (found,) = licenses.Scanner(licenses.TEMPLATES).scan(text)
    assert found[0] == "MIT" and text[found[2] : found[3]] == "Licensed under the MIT License"


def test_licenses_find_edited_notices_in_any_text():
    """Round trip: templates with some words changed, left out or added come back with their coverage and span."""
    import random

    rng = random.Random(12)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    filler = [f"word{k}" for k in range(50)]
    done = 0
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            spans = [m.span() for m in re.finditer(r"[^\W_]+(?:[.\-][^\W_]+)*", text)]
            words = [text[a:b] for a, b in spans]
            free = [k for k, need in enumerate(licenses.required([w.lower() for w in words])) if not need and 4 < k < len(words) - 4]
            if len(words) < 30:
                continue
            for _ in range(3):
                hit = sorted(rng.sample(free, min(3, len(words) // 12)))
                new, lost = list(words), 0
                for k in reversed(hit):
                    kind = rng.randrange(3)
                    lost += kind < 2
                    new[k : k + 1] = [["changed"], [], [words[k], "added"]][kind]
                before, after = (" ".join(rng.choices(filler, k=rng.randrange(1, 40))) for _ in range(2))
                body = " ".join(new)
                whole = f"{before} {body} {after}"
                found = [m for m in scanner.scan(whole) if m[0] == name]
                assert found, (name, body)
                best = max(found, key=lambda m: m[3] - m[2])
                assert whole[best[2] : best[3]] == body and best[4] == pytest.approx(1 - lost / len(words))
                done += 1
    assert done > 20


def test_licenses_find_every_template_as_its_own():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            assert [(m[0], m[4]) for m in scanner.scan(f"Some words. {text} Other words.")] == [(name, 1.0)], text


def test_html_time_grows_with_the_page_however_it_is_nested():
    import time

    pages = [
        "<div class=menu>x" * 20_000,
        "<nav><ul><li><table>" + "<div>" * 10_000 + "<li>" * 10_000,
        "<div>" * 20_000 + "</section>" * 20_000,
        "<a " * 20_000,
        "<section><div class=menu>m</section>t " * 4000,
        "<nav>" * 20_000 + "</nav>" * 20_000,
        "<nav><button>" + "<div>" * 10_000 + "<p>" * 10_000,
    ]
    for page in pages:
        began = time.process_time()
        html_extract.extract(page)
        assert time.process_time() - began < 10


def test_html_menus_left_open_again_and_again_stay_out():
    text = "The article has a long line of text that is worth reading and that no menu would have."
    page = "<body>" + "".join(f"<section><div class=menu>menu {k}</section><p>{text}</p>" for k in range(12)) + "</body>"
    assert html_extract.extract(page) == " ".join([text] * 12)


@pytest.mark.parametrize(
    "line,name",
    [
        ("# SPDX-License-Identifier: MIT", "MIT"),
        ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"),
        ("SPDX-License-Identifier: Proprietary-Thing", None),
        ("Licensed under GPLv3", "GPL-3.0"),
        ("Licensed under the GNU General Public License v3.0", "GPL-3.0"),
        ("Licensed under the Apache-2.0 license", "Apache-2.0"),
        ("Released under the BSD license", "BSD"),
        ("Licensed under the BSD 3-Clause License", "BSD-3-Clause"),
        ("Distributed under the terms of the MIT license", "MIT"),
        ("Distributed under the terms of the treaty", None),
        (licenses._MORE["MIT"][1], "MIT"),
    ],
)
def test_licenses_in_usual_lines(line, name):
    assert [m[0] for m in licenses.Scanner(licenses.TEMPLATES).scan(f"Some code. {line}\nAnd more of it.")] == ([name] if name else [])


def _common(words, ids):
    """The most words that a full alignment, without a band, can match."""
    row = [0] * (len(ids) + 1)
    for w in words:
        new = [0]
        for j, v in enumerate(ids):
            new.append(max(row[j] + (v == w), row[j + 1], new[j]))
        row = new
    return row[-1]


def test_licenses_banded_alignment_against_the_full_one():
    import random

    rng = random.Random(12)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for _ in range(150):
        n = rng.randrange(8, 40)
        words = [rng.randrange(1, 60) for _ in range(n)]
        body, drift = [], 0
        for w in words:
            kind = rng.random()
            if kind < 0.05 and drift > -3:
                drift -= 1
                continue
            if kind < 0.1 and drift < 3:
                drift += 1
                body.append(99)
            body.append(98 if kind > 0.95 else w)
        before = rng.randrange(10)
        ids = [97] * before + body + [97] * rng.randrange(10)
        got = scanner.align(words, [False] * n, ids, before)
        matched = sum(1 for w in body if w < 90)
        most = _common(words, ids)
        if matched / n >= 0.85:
            assert got is not None
        if got:
            assert most - 3 <= round(got[2] * n) <= most and set(ids[got[0] : got[1]]) & set(words)
