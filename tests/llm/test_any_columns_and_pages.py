"""Columns of any name, odd pages, copies among labels, and plain versions of what is fitted."""

import random
import time
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F

from fragloom.llm import bpe, decontaminate, html_text, ordinal, quality, secret_scan, simhash
from fragloom.llm.rows import fresh

NAMES = """_text _row _k _ids _left _right _chunks _kept ids _n _most _spans _items hit_spans whole_row text_to_search found_n base tokens decoys digest
    secrets _clean clean_text row encoded_row f t k g _all _t _words _n_words stratum text_key rule_bins kept base_failed n_words _id worst best expected_grade
    tail_probability decoded n_tokens fingerprint a.b c`d""".split()


def clashing(spark, texts):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    return df.withColumns({n: F.concat(F.lit(f"mine {n} "), F.col("doc_id").cast("string")) for n in NAMES if n not in df.columns})


def kept_as_they_were(out, results):
    rows = out.collect()
    for name in set(NAMES) - set(results):
        if name in out.columns:
            assert all(r[name] == f"mine {name} {r['doc_id']}" for r in rows), name
    assert set(NAMES) <= set(out.columns)
    return rows


TEXTS = ["a password=abc123 " + "word " * 20, None, "", "plain words only", "x " * 3000 + "token: abcdefgh"] + [f"clean text {i} " + " ".join(f"w{i}x{j}" for j in range(40)) for i in range(5)]


def test_fresh_names_differ_from_all_columns():
    assert fresh(["a", "_A", "b"], "a", "c", "c") == ["__a", "c", "_c"]


@pytest.mark.parametrize("case", ["scan", "redact", "encode", "encode_long", "decontaminate", "clean", "keep_good", "grade", "keep_first"])
def test_columns_of_any_name_pass_through(spark, case):
    df = clashing(spark, TEXTS)
    if case == "scan":
        rows = kept_as_they_were(secret_scan.scan(df), ["secrets"])
        assert sum(len(r["secrets"]) for r in rows) == 2
    elif case == "redact":
        rows = kept_as_they_were(secret_scan.redact(df), [])
        assert {r["doc_id"] for r in rows if r["text"] and "[SECRET]" in r["text"]} == {0, 4} and len(rows) == len(TEXTS)
    elif case.startswith("encode"):
        options = {"chunk": 200, "overlap": 80} if case == "encode_long" else {}
        out = bpe.decode(bpe.encode(df, "text", public.path("byte_bpe_50k.tiktoken"), public.PATTERN, **options), public.path("byte_bpe_50k.tiktoken"))
        rows = kept_as_they_were(out, ["ids", "n_tokens", "decoded"])
        assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in rows) and len(rows) == len(TEXTS)
    elif case in ("decontaminate", "clean"):
        tests = spark.createDataFrame([(1, TEXTS[5])], "item_id bigint, text string")
        out = getattr(decontaminate, case)(df, tests)
        rows = kept_as_they_were(out, ["n_words", "hit_spans"])
        assert len(rows) == len(TEXTS) - (case == "clean")
    elif case == "keep_good":
        rows = kept_as_they_were(quality.keep_good(df, spark.createDataFrame([(5, 1), (5, 0), (5, 1)], "doc_id bigint, quality int")), [])
        assert {r["doc_id"] for r in rows} == {5, 6, 7, 8, 9}
    elif case == "grade":
        rows = kept_as_they_were(ordinal.grade(df, (np.zeros(ordinal.SIZE), np.array([0.0, 1.0])), 2), ["expected_grade", "tail_probability"])
        assert len(rows) == len(TEXTS)
    else:
        rows = kept_as_they_were(simhash.keep_first(df), [])
        assert {5, 6, 7, 8, 9} <= {r["doc_id"] for r in rows}


# ---- labels ----

def test_each_different_text_counts_once_for_the_cutoffs(spark):
    """Copies, rows of one id and labels of one id are no further trials; contradicting labels are none."""
    data = [(7, "same text", "en")] * 3 + [(8, "same text", "en"), (9, "other", "en"), (10, "other", "en"), (11, "third", "en"), (11, "fourth", "de"), (None, "fifth", "en")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(7, 1)] * 4 + [(9, 1), (10, 0), (11, 0), (None, 1), (12, 1), (8, None)], "doc_id bigint, quality int")
    rows, _ = quality.calibrated(df, labels, "doc_id", "lang", "text", "quality", [])
    got = sorted((r["stratum"], r["good"]) for r in quality.labelled(rows, labels, "doc_id", "quality").collect())
    assert got == [("de", False), ("en", False), ("en", True)]


def plain_fit(rows, grades, n_grades):
    """The same optimisation, row by row, with the gradient taken from differences of the likelihood's terms."""
    import math

    known = {}
    for r in rows:
        for f in r:
            known[f] = known.get(f, 0) + 1
    often = sorted(f for f, n in known.items() if n >= 2)
    place = {f: i for i, f in enumerate(often)}
    share = [min(0.99, max(0.01, sum(g <= k for g in grades) / len(rows))) for k in range(n_grades - 1)]
    cut = [math.log(s / (1 - s)) for s in share]
    x = [0.0] * len(often) + [cut[0]] + [math.log(max(b - a, 0.05)) for a, b in zip(cut, cut[1:])]
    m, v = [0.0] * len(x), [0.0] * len(x)
    for step in range(1, ordinal.STEPS + 1):
        theta, grad = x[len(often):], [ordinal.RIDGE * w for w in x[:len(often)]] + [0.0] * (n_grades - 1)
        cuts = [theta[0]]
        for t in theta[1:]:
            cuts.append(cuts[-1] + math.exp(t))
        for r, g in zip(rows, grades):
            used = [place[f] for f in r if f in place]
            eta = sum(x[i] for i in used)
            above = [1 / (1 + math.exp(-(c - eta))) for c in cuts]
            high, low = (1.0 if g == n_grades - 1 else above[g]), (0.0 if g == 0 else above[g - 1])
            p = max(high - low, 1e-12)
            for i in used:
                grad[i] += (high * (1 - high) - low * (1 - low)) / p / len(rows)
            for k, sign, s in ((g, -1, high), (g - 1, 1, low)):
                if 0 <= k < n_grades - 1:  # a cut is the first one and the exponentials up to it
                    for j in range(k + 1):
                        grad[len(often) + j] += sign * s * (1 - s) / p / len(rows) * (1 if j == 0 else math.exp(theta[j]))
        for i, d in enumerate(grad):
            m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.99 * v[i] + 0.01 * d * d
            x[i] -= ordinal.RATE * (m[i] / (1 - 0.9 ** step)) / (math.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-6)
    theta = x[len(often):]
    return dict(zip(often, x)), [theta[0] + sum(math.exp(t) for t in theta[1:k]) for k in range(1, n_grades)]


def test_the_ordinal_fit_equals_a_plain_loop_whatever_repeats(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e"] if g else ["a", "x", "y"]) for _ in range(rng.randint(1, 9))) for g in [0, 1, 1] * 14]
    data = {t: i % 3 for i, t in enumerate(texts)}
    repeated = [(1, t, g) for t, g in data.items()] * 2 + [(1, texts[0], data[texts[0]])] * 60 + [(2, "contradicted a b", 0), (2, "contradicted a b", 1), (3, "no grade", None), (4, "bad grade", 9)]
    df = spark.createDataFrame(repeated, "doc_id bigint, text string, grade int").withColumn("k", F.lit("mine"))
    weights, cuts = ordinal.fit(df, 3)
    want, want_cuts = plain_fit([ordinal.features(t, {}) for t in data], list(data.values()), 3)
    assert np.allclose([weights[f] for f in want], list(want.values()), atol=1e-6) and np.allclose(cuts, want_cuts, atol=1e-6)
    assert np.count_nonzero(weights) <= len(want)
    few = []
    keep, ordinal.fit_rows = ordinal.fit_rows, lambda rows, grades, n: few.append(len(rows))
    ordinal.fit_rows = keep
    small, _ = ordinal.fit(df, 3, sample=1)  # one text alone: every feature is seen once
    assert not small.any()


def test_cutoffs_of_secrets_equal_a_plain_count(spark):
    rng = random.Random(14)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = "some ordinary words make up these sentences and nothing here is secret at all".split()
    texts = [" ".join(rng.choice(words) for _ in range(90)) + " " + "".join(rng.choice(letters) for _ in range(rng.choice([24, 40, 70]))) for _ in range(150)]
    texts += [" ".join(rng.choice(words) for _ in range(60)) for _ in range(100)] + ["token=abcdef " + "z" * 40, "", None] + texts[:40] + ["deadbeef" * 4] * 7
    different = list(dict.fromkeys(t or "" for t in texts))
    cells = {}
    for text, decoys in zip(different, secret_scan.decoys(different)):
        spans = secret_scan.base_spans(text)
        for _, _, kind, at, score in secret_scan.candidates(text, spans):
            cells.setdefault((kind, at), ([], []))[0].append(score)
        for c in decoys:
            cell, score = divmod(c, secret_scan.GRID + 1)
            cells.setdefault(divmod(cell, len(secret_scan.BANDS)), ([], []))[1].append(score)
    cuts = {}
    for key, (targets, nulls) in cells.items():  # Benjamini-Hochberg on the decoys' p-values, the largest set that passes
        ranked = sorted(targets, reverse=True)
        passed = [s for i, s in enumerate(ranked) if (sum(d >= s for d in nulls) + 1) / (len(nulls) + 1) <= secret_scan.RATE * sum(t >= s for t in targets) / len(targets)]
        if passed:
            cuts[key] = min(passed)
    assert cuts
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    n_random = 0
    for r in secret_scan.scan(df).collect():
        text = r["text"] or ""
        base = secret_scan.base_spans(text)
        want = sorted([(s, k, e) for s, k, e in base] + [(s, 3, e) for s, e, kind, at, score in secret_scan.candidates(text, base)
                                                          if (kind, at) in cuts and score >= cuts[kind, at]])
        n_random += sum(k == 3 for _, k, _ in want)
        assert [tuple(x) for x in r["secrets"]] == [(s, [*secret_scan.KINDS, "random"][k], e) for s, k, e in want]
    assert n_random > 100


# ---- pages ----

LONG = " ".join(["The cat sat on the mat and it was as warm as the sun in the summer of that year, when all of us were there."] * 4)


@pytest.mark.parametrize("page, copies", [
    (f'<div class="content has-sidebar"><article><p>{LONG}</p></article></div>', 1),
    (f'<div id="no-comments"><main><p>{LONG}</p></main></div>', 1),
    (f'<div class="sidebar"><article><p>{LONG}</p></article></div>', 1),
    (f"<article><p>{LONG}</p><svg/><p>{LONG}</p><svg></svg><p>{LONG}</p></article>", 3),
    (f'<div class="page-banner"><p>{LONG}</p><p>{LONG}</p></div><div class="menu">x y z</div>', 2),
    (f'<article><p>{LONG}</p></article><div class="comments"><p>{LONG}</p><p>{LONG}</p></div>', 1),
    (f'<article><p>{LONG}</p><div class="comments"><p>{LONG}</p></div></article>', 1)])
def test_names_of_wrappers_are_evidence_only(page, copies):
    assert html_text.main_text(page) == "\n".join([LONG] * copies)


def test_long_text_of_other_scripts_stays():
    text = " ".join(["Кот сидел на ковре."] * 20)
    assert html_text.main_text(f"<p>{text}</p>") == text


@pytest.mark.parametrize("page", ["<button>" * 125_000, "<div>" * 100_000 + "</section>" * 50_000, '<div class="nav">' * 60_000, "<article>x" * 100_000,
                                  "<svg>" * 200_000, "<a x='" * 170_000, "<" * 1_000_000, "<!--" * 250_000, "<h1>a" * 150_000, "<p '" * 250_000 + "x"])
def test_odd_pages_take_time_in_proportion(page):
    start = time.time()
    html_text.main_text(page)
    assert time.time() - start < 4


class Article(HTMLParser):
    """The blocks of an article that is marked as such, without what is marked as something else."""

    def __init__(self, page):
        super().__init__()
        self.out, self.depth, self.away, self.words = [], 0, [], []
        self.feed(page)
        self.close()
        self.block()

    def block(self):
        text = " ".join("".join(self.words).split())
        if text:
            self.out.append(text)
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "input"):
            self.words.append(" ")
        if tag in html_text.BLOCKS:
            self.block()
        if self.away:
            self.away += [tag] if tag == self.away[0] else []
        elif self.depth and (tag in ("aside", "nav", "form", "footer", "script", "style") or tag == "div" and dict(attrs).get("class")):
            self.away = [tag]
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.block()
        if self.away and tag == self.away[0]:
            self.away.pop()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth and not self.away:
            self.words.append(data)


def test_all_pages_against_a_plain_reading_of_their_articles():
    pages = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    differ = [i for i, (page,) in enumerate(pages) if html_text.main_text(page) != "\n".join(Article(page or "").out)]
    assert len(pages) == 250 and not differ
