"""Operators on text against brute force, over nulls, empties, repeats, long texts and clashing names."""

import base64
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragloom.llm import bpe, decontaminate, html_text, ordinal, phrases, secret_scan, simhash

public = pytest.importorskip("public_tokenizers")
RANKS = public.path("byte_bpe_50k.tiktoken")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def rows(spark, texts, extra=True):
    """doc_id counts from 0; the extra columns carry names that the operators use themselves."""
    data = [(i, t, f"x{i}", i * 10) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, kept string, hash int")
    return df if extra else df.select("doc_id", "text")


# ---- byte-level BPE ----

def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = ["", None, " ", "\n\n  \n", "don't we'll I'm 's", "x" * 700, "a1 b22  c333   ", "äöü ñandú 東京タワー 🙂🙂", "<|endoftext|>",
        "word " * 200, "ab" * 300 + " " + "q" * 300, "  lead and trail  ", "  mixed space", "1234567890" * 40, "it's" * 90]


@pytest.mark.parametrize("chunk,overlap", [(65536, 1024), (64, 24), (40, 20)])
def test_encoding_equals_the_library_also_when_chunks_are_stitched(spark, chunk, overlap):
    encoding = tiktoken_encoding()
    df = rows(spark, HARD).withColumn("ids", F.lit("clash"))
    out = bpe.decode(bpe.encode(df, "text", RANKS, public.PATTERN, chunk, overlap), RANKS).collect()
    assert len(out) == len(HARD)
    for r in out:
        want = encoding.encode_ordinary(r["text"] or "")
        assert list(struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"])) == want, r["text"]
        assert r["n_tokens"] == len(want) and bytes(r["decoded"]).decode() == (r["text"] or "")
        assert r["kept"] == f"x{r['doc_id']}"


def test_random_texts_stitch(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab '1é.\n sあ") for _ in range(rng.randrange(400))) for _ in range(60)]
    encoding = tiktoken_encoding()
    for r in bpe.encode(rows(spark, texts), "text", RANKS, public.PATTERN, 50, 20).collect():
        assert bpe.unpack(r["ids"]).tolist() == encoding.encode_ordinary(r["text"])


def test_long_pieces_merge_alike():
    encoder = bpe.Encoder(RANKS, public.PATTERN)
    for raw in (b"a" * 333, b"abcabcabd" * 40, bytes(range(97, 123)) * 9):
        assert encoder._long(raw) == encoder._short(raw)


def test_known_pieces_are_bounded_and_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 5)
    text = " ".join(f"word{i % 13} unseen{i} Größe{i % 3}" for i in range(200))
    encoder = bpe.Encoder(RANKS, public.PATTERN)
    assert bpe.unpack(encoder.encode(text)).tolist() == tiktoken_encoding().encode_ordinary(text)
    assert max(len(encoder.pieces), len(encoder.pieces.last)) <= 5


def test_empty_table_encodes(spark):
    assert bpe.encode(rows(spark, []), "text", RANKS, public.PATTERN).count() == 0


# ---- SimHash ----

def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, near=3):
    group = list(range(len(prints)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= near:
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return [top(i) for i in range(len(prints))]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("Alpha beta gamma delta Épsilon zeta eta".split()) + str(rng.randrange(300)) for _ in range(300)) for _ in range(6)]
    texts = [None, "", " \t", "One", "one", "two words"]
    for b in base:
        texts += [b, b, b.upper()] + [" ".join(w if rng.random() > 0.01 else "changed" for w in b.split()) for _ in range(8)]
    prints = [brute_fingerprint(t) for t in texts]
    want = brute_components(prints)
    out = {r["doc_id"]: r for r in simhash.near_duplicates(rows(spark, texts)).collect()}
    assert len(out) == len(texts) and len(set(want)) < len(set(prints))
    for i, t in enumerate(texts):
        assert out[i]["fingerprint"] % (1 << 64) == prints[i], t
        assert out[i]["component_id"] == want[i]


def test_every_link_within_three_bits_is_found(spark):
    rng = random.Random(2)
    prints = []
    for _ in range(150):
        p = rng.getrandbits(64)
        prints.append(p)
        for _ in range(rng.randrange(4)):
            q = p
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                q ^= 1 << b
            prints.append(q)
    prints = list(dict.fromkeys(prints))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fingerprint bigint")
    group = {p: i for i, p in enumerate(prints)}
    found = list(range(len(prints)))

    def top(i):
        while found[i] != i:
            i = found[i]
        return i

    for u, v in simhash.links(df).collect():
        a, b = top(group[u % (1 << 64)]), top(group[v % (1 << 64)])
        found[max(a, b)] = min(a, b)
        assert bin((u ^ v) & ((1 << 64) - 1)).count("1") <= 3
    want = brute_components(prints)
    pairs = {}
    for i in range(len(prints)):
        pairs.setdefault(want[i], set()).add(top(i))
    assert all(len(v) == 1 for v in pairs.values()) and len(pairs) == len({top(i) for i in range(len(prints))})


def test_keep_first_keeps_one_row_of_each_group(spark):
    texts = ["a b c d e f", "a b c d e f", "other words stand here now", None, ""]
    df = rows(spark, texts).unionByName(rows(spark, texts[:1]))
    out = simhash.keep_first(df)
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 2, 3] and out.columns == df.columns
    nameless = df.withColumn("doc_id", F.lit(None).cast("bigint"))
    assert simhash.near_duplicates(nameless).where("component_id IS NULL").count() == 6
    assert simhash.near_duplicates(rows(spark, [])).count() == 0


def test_keep_first_keeps_one_row_of_each_component_whatever_the_ids(spark):
    rng = random.Random(12)
    a, b, c, d = [" ".join(f"{w}{rng.randrange(10_000)}" for _ in range(300)) for w in "abcd"]
    near = b.replace(b.split()[150], "changed")
    assert 0 < bin(brute_fingerprint(b) ^ brute_fingerprint(near)).count("1") <= 3
    rows = [(None, a), (None, b), (None, b), (None, c), (None, c), (5, d), (5, d), (5, "x y z"), (6, "x y z"), (None, d), (None, near)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_digest", F.lit(1))
    out = simhash.keep_first(df)
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == df.columns and len(kept) == 5 and set(kept) - {(None, b), (None, near)} == {(None, a), (None, c), (5, d), (5, "x y z")}
    one = spark.createDataFrame([(5, a), (5, b), (6, near)], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_first(one).collect()) == [(5, a), (5, b)]


# ---- decontamination ----

def lower_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(text, items, window=10):
    w, hit, names = lower_words(text), set(), set()
    for name, item in items:
        v = lower_words(item)
        n = min(window, len(v))
        for j in range(len(v) - n + 1) if n else []:
            for i in range(len(w) - n + 1):
                if w[i:i + n] == v[j:j + n]:
                    hit.update(range(i, i + n))
                    names |= {name} - {None}
    return len(w), hit, sorted(map(str, names))


@pytest.mark.parametrize("shard,block", [(250_000, 8 << 20), (25, 8 << 20), (30, 60)])
def test_decontamination_equals_brute_force(spark, shard, block):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("red green blue Ünder sky4") for _ in range(n))) for i, n in enumerate([30, 12, 10, 3, 1, 25])]
    items += [(7, None), (8, ""), (9, "!!"), (10, items[0][1]), (None, "only here once more"), (11, " ".join(str(k) for k in range(40)))]
    texts = [None, "", "...", "red", "RED green", items[0][1], "pre " + items[0][1].upper() + ", post", items[1][1] + " x " + items[1][1],
             "only here once more", " ".join(str(k) for k in range(5, 33)), "0 1 2 3 4 5 6 7 8"]
    texts += [" ".join(rng.choice("red green blue Ünder sky4") for _ in range(80)) for _ in range(4)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = rows(spark, texts).withColumn("n_words", F.lit("clash"))
    out = decontaminate.decontaminate(df, bench, shard_words=shard, block_bytes=block).collect()
    assert len(out) == len(texts)
    for r in out:
        n, hit, names = brute_hits(r["text"], items)
        got = {i for a, b in zip(r["hit_spans"][::2], r["hit_spans"][1::2]) for i in range(a, b)}
        assert (r["n_words"], got, r["hit_items"]) == (n, hit, names)
    one = next(r for r in out if r["text"] and r["text"].startswith("5 6 7"))
    assert one["longest_match"] == 28


def test_longest_match_goes_over_the_borders_of_pieces(spark):
    item = " ".join(f"w{i}" for i in range(60))
    bench = spark.createDataFrame([(1, item), (2, "lone")], "item_id bigint, text string")
    texts = ["x " * n + item + " y lone" for n in (0, 3, 20, 40, 55, 130)] + ["x " * 40 + item[:-20]]
    out = {r["doc_id"]: r["longest_match"] for r in decontaminate.decontaminate(rows(spark, texts), bench, shard_words=20).collect()}
    assert [out[i] for i in range(7)] == [60] * 6 + [55]


def test_clean_drops_only_hit_rows(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    df = rows(spark, ["say one two three now", "one two", None])
    out = decontaminate.clean(df, bench)
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2] and out.columns == df.columns
    assert decontaminate.clean(df, bench.limit(0)).count() == 3 and decontaminate.clean(df.limit(0), bench).count() == 0


# ---- repeated phrases ----

def brute_removed(texts, window):
    first, words = {}, [SPLIT.findall(t or "") for t in texts]
    for i, w in enumerate(words):
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p:p + window]), i)
    out = []
    for i, w in enumerate(words):
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < i:
                gone |= set(range(p, p + window))
        out.append(" ".join(x for p, x in enumerate(w) if p not in gone))
    return out


@pytest.mark.parametrize("window", [50, 7, 2])
def test_repeated_phrases_equal_brute_force(spark, window):
    rng = random.Random(window)
    passage = [" ".join(f"w{rng.randrange(40)}" for _ in range(n)) for n in (window, window + 1, 3 * window + 5, window - 1)]
    texts = [None, "", " ", "w1 w2"] + ["the " * (2 * window)] * 2
    for _ in range(25):
        parts = [" ".join(f"w{rng.randrange(9999)}" for _ in range(rng.randrange(60))) for _ in range(3)]
        texts.append(f" {parts[0]}\t{rng.choice(passage)} {parts[1]}\n{rng.choice(passage)} {parts[2]}")
    texts += [texts[8], texts[9] + " tail"]
    want = brute_removed(texts, window)
    digests = {r["doc_id"]: r for r in phrases.without_repeats(rows(spark, texts), window=window).collect()}
    assert len(digests) == len(texts)
    for i, w in enumerate(want):
        assert digests[i]["kept_sha256"] == hashlib.sha256(w.encode()).hexdigest()
        assert digests[i]["n_removed"] == len(SPLIT.findall(texts[i] or "")) - len(w.split())


def test_repeats_of_one_id_and_rows_without_id_stay(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id bigint, text string")
    out = phrases.without_repeats(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in out) == [(0, 0), (1, 0), (1, 0), (2, 60)]
    assert phrases.without_repeats(df.limit(0)).count() == 0


# ---- secrets ----

def test_base_spans_and_overlaps(spark):
    texts = [None, "", "password=abc12", "PASSWORD = \"abc123\" token:zzzzzzz", "secret=token:abcdef", "AKIA" + "A" * 16 + " AKIA" + "B" * 15,
             "x " + "0123456789abcdef" * 2, "api_key='" + "a1b2c3d4" * 4 + "'"]
    out = {r["doc_id"]: [tuple(s) for s in r["secrets"]] for r in secret_scan.scan(rows(spark, texts), keep=["doc_id"]).collect()}
    assert out[0] == out[1] == out[2] == []
    assert out[3] == [(0, "assign", 18), (20, "assign", 33)]
    assert out[4] == [] and out[5] == [(0, "access", 20)]
    assert out[6] == [(2, "hex", 34)]
    assert out[7] == [(0, "assign", 41), (9, "hex", 41)]
    assert secret_scan.scan(rows(spark, []), keep=["doc_id"]).count() == 0


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = "some ordinary words make up these sentences and nothing here is secret at all".split()
    texts = []
    for i in range(900):
        prose = " ".join(rng.choice(words) for _ in range(120)) + " antidisestablishmentarianism"
        texts.append(prose + (" " + "".join(rng.choice(letters) for _ in range(40)) if i % 3 == 0 else ""))
    out = secret_scan.scan(rows(spark, texts, False), keep=["doc_id", "text"]).collect()
    planted = [r for r in out if r["doc_id"] % 3 == 0]
    caught = sum(any(s["kind"] == "random" and s["end"] == len(r["text"]) for s in r["secrets"]) for r in planted)
    assert caught >= 0.9 * len(planted)
    assert not any(r["secrets"] for r in out if r["doc_id"] % 3)


def test_redaction_replaces_spans_only(spark):
    df = rows(spark, ["a password=abc123 b", None, "", "plain", "api_key='" + "a1b2c3d4" * 4 + "'"])
    out = secret_scan.redact(df)
    assert out.columns == df.columns
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == ["a [SECRET] b", None, "", "plain", "[SECRET]'"]


def test_decoys_come_from_the_whole_text_and_score_as_candidates():
    rng = random.Random(13)
    for size in (16, 32, 64):
        for n in secret_scan.BANDS:
            codes = [[rng.randrange(rng.choice([1, 2, size])) for _ in range(n)] for _ in range(20)] + [[0] * n, [0, size - 1] * (n // 2)]
            for got, c in zip(secret_scan.batteries(np.array(codes, dtype=np.uint8), size), codes):
                assert abs(got - secret_scan.score(secret_scan.battery(c, size))) <= 1
    texts = [None, "", "too short", "plain words " * 2, "some plain words " * 1000, "x" * 5000]
    out = secret_scan.decoys(texts)
    per_band = [sorted(c // (secret_scan.GRID + 1) for c in bins) for bins in out]
    assert per_band[:3] == [[], [], []] and per_band[5] == [] and per_band[3] == [0, 1, 7, 8, 14, 15]
    letters = 14 * 1000
    want = [(k * 7 + at, 1 + (letters - b) // secret_scan.STEP) for k in range(3) for at, b in enumerate(secret_scan.BANDS)]
    assert [(c, per_band[4].count(c)) for c, _ in want] == want and len(per_band[4]) == sum(n for _, n in want)


def test_copies_do_not_take_over_the_null_distribution(spark):
    rng = random.Random(14)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = "some ordinary words make up these sentences and nothing here is secret at all".split()
    texts = [" ".join(rng.choice(words) for _ in range(120)) + " " + "".join(rng.choice(letters) for _ in range(40)) for _ in range(300)]
    # short words whose letters look like random symbols: decoys of these score like secrets
    while True:
        odd = " ".join("".join(rng.choice(letters[:52]) for _ in range(8)) for _ in range(200))
        seed = zlib.crc32(odd.encode())
        place = seed % len(odd)
        if (seed // 7 + 2) % 7 == secret_scan.band(40) and 0 < place < len(odd) - 50 and odd[place - 1] == " ":
            if secret_scan.token_score(odd[place:].replace(" ", "")[:40], 2) >= 197:
                break  # one stretch a text, its place and band drawn by the checksum, would be this decoy
    plain = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(600)]

    def spans(texts):
        out = secret_scan.scan(rows(spark, texts, False), keep=["doc_id", "text"]).collect()
        return {r["text"]: [tuple(s) for s in r["secrets"]] for r in out}

    once, often = spans(texts + plain), spans(texts + plain + [odd] * 450)
    assert sum(bool(once[t]) for t in texts) >= 270 and sum(bool(often[t]) for t in texts) >= 270
    assert spans(texts + plain + [odd]) == often


# ---- HTML ----

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><div class="ad">Buy it.</div>
<article><h1>A title</h1><p>%s</p><p>Short &amp; sweet.<p>Open <b>bold<br>text</p><aside>Side</aside>
<div class="comments"><p>%s</p></div></article><div id="cookie-notice"><p>%s</p></div><form><p>Mail</p><input></form><footer>&copy; x</footer></body></html>"""
PROSE = "This is the text of a page and it has all of the words that are to be in such a text, with more of them than it would need. " * 3


def test_main_text_leaves_furniture_out(spark):
    long = " ".join(PROSE.split())
    page = PAGE % (PROSE, PROSE, PROSE)
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "no tags, only words"), (5, "u", "<p>cut off &am")],
                               "page_id bigint, url string, html string")
    out = {r["page_id"]: r["text"] for r in html_text.extract(df, keep=["page_id"]).collect()}
    assert out[1] == "\n".join(["A title", long, "Short & sweet.", "Open bold text"])
    assert out[2] == out[3] == "" and out[4] == "no tags, only words" and out[5] == "cut off &am"
    assert html_text.extract(df.limit(0)).count() == 0


def test_pages_without_article_use_density():
    links = "".join(f"<li><a href='/{i}'>A link to read {i}</a></li>" for i in range(9))
    page = f"<body><ul>{links}</ul><div><h2>Head</h2><div>{PROSE}</div><div>And so on.</div><div>{PROSE}</div></div><ul>{links}</ul></body>"
    long = " ".join(PROSE.split())
    assert html_text.main_text(page) == "\n".join(["Head", long, "And so on.", long])
    for odd in ("<", "<<<>>>", "<p", "<a href='x", "<!--", "<script>", "</p></div>", "&#0; &bogus; &#x110000;"):
        html_text.main_text(odd)


# ---- ordinal classifier ----

def test_ordinal_model_ranks_held_out_rows(spark):
    rng = random.Random(6)
    fair, bad = [f"word{i}" for i in range(200)], ["vile", "awful", "nasty"]

    def text(grade):
        w = [rng.choice(fair) for _ in range(60)]
        if grade == 1:
            w[::15] = [rng.choice(bad) for _ in w[::15]]
        return " ".join(x.upper() + "!!" for x in w) if grade == 0 else " ".join(w)

    data = [(i, text(i % 3), i % 3) for i in range(600)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, grade int")
    model = ordinal.fit(df.where("doc_id < 400"), 3)
    assert (model[1][1:] > model[1][:-1]).all()
    held = df.where("doc_id >= 400").unionByName(spark.createDataFrame([(900, None, 0), (901, "", None)], df.schema))
    out = ordinal.grade(held, model, 2).collect()
    assert len(out) == 202 and all(0 <= r["expected_grade"] <= 2 and 0 <= r["tail_probability"] <= 1 for r in out)
    right = [round(r["expected_grade"]) == r["grade"] for r in out if r["doc_id"] < 900]
    assert sum(right) / len(right) > 0.9


def test_ordinal_model_without_labels(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, grade int")
    weights, cuts = ordinal.fit(df, 3)
    assert not weights.any() and len(cuts) == 2


def test_windows_of_equal_hash_are_told_apart_by_their_words(monkeypatch):
    draw = random.Random(3)
    texts = {i: [draw.choice([b"a", b"b"]) for _ in range(40)] for i in range(12)}
    monkeypatch.setattr(phrases.Phrases, "_hashes", lambda self, numbers: np.zeros(max(len(numbers) - self.window + 1, 0), dtype=np.uint64))
    found = phrases.Phrases(6)
    for owner in (9, 0, 4, 2):
        found.add(owner, b" ".join(texts[owner]).decode())
    found.close()
    for id, words in texts.items():
        known = {tuple(texts[o][k:k + 6]) for o in (0, 2, 4, 9) if o < id for k in range(35)}
        want = [any(tuple(words[k:k + 6]) in known for k in range(max(0, i - 5), min(i, 34) + 1)) for i in range(40)]
        assert found.covered(id, words).tolist() == want
