"""License scans against a plain Python reading of every word window."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fragloom.llm import license_scan as scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {a: a + 32 for a in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text):
    w, places, labels, best = words(text), [], set(), 0.0
    for label, phrase in scan.PHRASES:
        p = words(phrase)
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    if places:
        best = 1.0
    for label, notice in scan.NOTICES:
        p = words(notice)
        hits = sorted({(i - j, j) for i in range(len(w) - 2) for j in range(len(p) - 2) if w[i:i + 3] == p[j:j + 3]})
        while hits:
            copy = [hits.pop(0)]
            while hits and hits[0][0] - copy[-1][0] <= scan.NEIGHBOURS:
                copy.append(hits.pop(0))
            share = len({j + k for _, j in copy for k in range(3)}) / len(p)
            starts = [d + j for d, j in copy]
            best = max(best, share)
            if share >= scan.COVERED and max(starts) + 3 - min(starts) <= len(p) * scan.STRETCH:
                labels.add(label)
    base = {b for _, b in places}
    at = [i for i, _ in places]
    return (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), round(best, 9))


def texts():
    rng, out = random.Random(5), [None, "", " \n\t", "MIT", "under the mit", "cc by nc cc by nc", "Under THE\nmit; license!",
                                  "ünder the mit license", "apache license, version 2.0 apache license version 2"]
    filler = "of the software is provided as it stands under a license and the public may copy it".split()
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            notice = rng.choice(scan.NOTICES + scan.PHRASES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):  # a word lost, added or changed
                at = rng.randrange(len(notice))
                notice[at:at + rng.randint(0, 1)] = rng.choice([[], ["other"], ["word", "here"]])
            parts += [rng.choice(filler) for _ in range(rng.randint(0, 12))] + notice
        out.append(" ".join(parts))
    out.append(" ".join(filler * 4000) + " Released under the MIT License. " + "x " * 30000)
    return out


def answers(rows):
    return [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in rows]


def test_against_brute_force(spark):
    data = list(enumerate(texts()))
    got = scan.scan(spark.createDataFrame(data, "doc_id long, text string"), keep=["doc_id"]).orderBy("doc_id").collect()
    assert answers(got) == [brute(t) for _, t in data]
    assert any(r["labels"] != r["base_labels"] for r in got) and any(0 < r["score"] < scan.COVERED for r in got)
    spans = next(r for r in got if r["doc_id"] == 6)["license_spans"]
    assert [(s["label"], s["start"], s["end"], s["score"]) for s in spans] == [("mit", 0, 4, 1.0)]


def test_templates_in_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts()[:40])), "doc_id long, text string")
    whole = sorted(scan.scan(docs).collect(), key=lambda r: r["doc_id"])
    monkeypatch.setattr(scan, "BLOCK_CHARS", 120)
    assert sorted(scan.scan(docs).collect(), key=lambda r: r["doc_id"]) == whole


def test_nulls_repeats_copies_clashes_and_empty_tables(spark):
    one = "Licensed under CC BY-NC 4.0."
    data = [(1, one), (1, one), (1, "cc by nc, under the MIT license"), (None, one), (None, None)] + [(7, one)] * 300
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for name in ("w", "kept", "n_words", "labels", "text_key", "pos", "word", "h", "template", "tpos", "gram", "found", "a.b"):
        docs = docs.withColumn(name, F.lit("mine"))
    out = scan.scan(docs)
    assert out.count() == len(data) and set(out.columns) == set(docs.columns) | {
        "n_base", "first_word", "last_word", "base_labels", "score", "license_spans"}
    assert out.where("w = 'mine' AND kept = 'mine' AND template = 'mine' AND gram = 'mine' AND `a.b` = 'mine'").count() == len(data)
    assert out.where("labels = 'cc-by-nc' AND n_base = 1").count() == 303
    assert out.where("labels = 'cc-by-nc,mit' AND first_word = 0 AND last_word = 3").count() == 1
    assert out.where("doc_id IS NULL AND n_words = 0 AND labels = '' AND score = 0").count() == 1
    assert scan.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        scan.scan(docs, phrases=[("x", "two words")])
