"""Ranked search against a plain scoring of every document."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fragloom.llm import lexical_search as lex

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {a: a + 32 for a in range(65, 91)}


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=50):
    bags = [(key, Counter(terms(t))) for key, t in docs if terms(t)]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for key, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * bag[t] // (1000 * bag[t] + 20 * m))
                    for t in set(terms(text)) if t in bag)
            if s > 0:
                scored.append((-s, key is None, key or 0))
        out += [(item, r, None if none else key, -s) for r, (s, none, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **options):
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("mine")).withColumn("doc", F.lit(0))
    items = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("mine"))
    return sorted(map(tuple, lex.search(docs, items, **options).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "über", "x", "Y2"]
    weights = [1 / (i + 1) for i in range(len(words))]

    def text(n):
        return "".join(w + rng.choice([" ", "-", "\n", ", "]) for w in rng.choices(words, weights, k=n))

    docs = [(i, text(rng.choice([1, 5, 20, 80]))) for i in range(400)]
    docs += [(None, "w50 w51"), (None, None), (500, None), (501, ""), (502, "- !"), (7, docs[7][1]), (7, "w30 w31 w32"), (600, text(30000))]
    docs += [(1000 + i, docs[3][1]) for i in range(250)]  # copies: ties by id
    docs += [(2000 + i, " ".join(f"n{j}" for j in range(i + 1))) for i in range(120)]  # each path is the start of the next
    items = [(i, text(rng.choice([1, 4, 15]))) for i in range(25)]
    items += [(3, "W50 w51 w52"), (None, "w40 w41"), (90, None), (91, ""), (92, "unheard of"), (93, " ".join(f"n{j}" for j in range(120))), (94, docs[3][1])]
    return docs, items


def test_against_brute_force(spark, corpus):
    docs, items = corpus
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, trie_docs=90, leaf=2) == want
    assert found(spark, docs, items, leaf=1) == want
    assert found(spark, docs, items, k=3, trie_docs=64, leaf=5) == brute(docs, items, 3)


def test_items_in_blocks(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lex, "BLOCK_BYTES", 2000)
    assert found(spark, docs[:200], items) == brute(docs[:200], items)


def test_empty_tables(spark, corpus):
    docs, items = corpus
    assert found(spark, [], items) == [] and found(spark, docs[:5], []) == []
    assert found(spark, [(1, None), (2, "")], items) == [] and found(spark, docs[:5], [(1, None), (2, "?")]) == []


def test_a_search_leaves_parts_of_the_trie_out():
    import numpy as np

    rng = np.random.default_rng(1)
    sizes = rng.integers(3, 9, 4000)
    ranks = np.concatenate([np.sort(rng.choice(500, s, replace=False)) for s in sizes])
    trie = lex.Trie(np.arange(4000), np.zeros(4000, bool), rng.integers(50, 200, 4000), ranks, rng.integers(1, 5, len(ranks)), sizes, 8)
    seen, plain = [], lex.Best.add

    class Watched(lex.Best):
        def add(self, *rows):
            seen.append(len(rows[0]))
            plain(self, *rows)

    best = Watched(10)
    trie.search(np.array([3, 40, 77, 300]), np.array([100, 200, 300, 400]), best)
    assert len(best.docs) == 10 and sum(seen) < 200
