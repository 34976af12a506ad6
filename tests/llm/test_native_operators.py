"""Sharding, quality rules and WARC, over nulls, empties, repeats and clashing names."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fragloom.llm import quality, sharding, warc

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


# ---- sharding ----

def test_one_more_shard_takes_rows_only_into_itself(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id").unionByName(spark.createDataFrame([(None,), (5,)], "doc_id bigint"))
    weights = {"a": 1.0, "b": 1.0, "c": 2.0}
    out = sharding.assign(sharding.assign(df, weights), {**weights, "d": 1.0}, name="grown")
    assert out.count() == 4002 and out.where("grown != shard AND grown != 'd'").count() == 0
    share = {r["shard"]: r["count"] / 4002 for r in out.groupBy("shard").count().collect()}
    assert abs(share["c"] - 0.5) < 0.04 and abs(share["a"] - 0.25) < 0.04
    assert abs(out.where("grown = 'd'").count() / 4002 - 0.2) < 0.04
    assert out.where("doc_id = 5").select("shard").distinct().count() == 1
    with pytest.raises(ValueError):
        sharding.assign(df, {"a": 0.0})


def test_slots_have_no_gaps_and_copies_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    data = [(i, f"text {i % 11}") for i in range(300)] + [(None, None)] * 40 + [(3, "same")] * 50 + [(9, "")]
    rows = sharding.sized(spark.createDataFrame(data, "doc_id bigint, text string").withColumn("size", F.lit("clash")))
    out = sharding.slots(sharding.assign(rows, dict.fromkeys(range(3), 1.0)), ["doc_id", "size", "text_crc32"]).collect()
    assert len(out) == len(data)
    for shard in range(3):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))
    one = next(r for r in out if r["doc_id"] == 14)
    assert one["size"] == len("text 3") + 8 and one["text_crc32"] == zlib.crc32(b"text 3")
    assert {(r["size"], r["text_crc32"]) for r in out if r["doc_id"] is None} == {(8, 0)}
    empty = sharding.sized(spark.createDataFrame([], "doc_id bigint, text string"))
    assert sharding.slots(sharding.assign(empty, {0: 1.0}), ["doc_id"]).count() == 0


# ---- quality rules ----

def brute_counts(text):
    w = SPLIT.findall(text or "")
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i:i + 5]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if SPLIT.search(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force(spark):
    rng = random.Random(7)
    texts = [None, "", " \n\t", "a b c d e", "a b c d e a b c d e", "x " * 40, "é ü ñ　z #*$", "l1\nl1\n\n \nl2\r\nl2\r\n", "A|B <c> && %"]
    texts += [" ".join(rng.choice("ab cd e\n #".split(" ")) for _ in range(rng.randrange(80))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("n_words", F.lit("clash"))
    for r in quality.measured(df).collect():
        assert tuple(r[c] for c in quality.COUNTS) == brute_counts(r["text"]), repr(r["text"])
        assert len(r["rule_bins"]) == len(quality.RULES) and all(0 <= b <= quality.GRID for b in r["rule_bins"])


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (3, 10), (5, 2000), (0, 5000), (40, 3000)]
    df = spark.createDataFrame(cases, "k bigint, n bigint")
    for r in df.select("k", "n", quality.log_binomial_tail(F.col("k"), F.col("n"), 0.01).alias("l")).collect():
        exact = sum(math.comb(r["n"], i) * Fraction(1, 100) ** i * Fraction(99, 100) ** (r["n"] - i) for i in range(r["k"] + 1))
        assert math.isclose(math.exp(r["l"]), exact, rel_tol=1e-9)


def brute_cuts(rows):
    """rows (stratum, good, bins): the mildest certified cutoff that rejects the most bad rows."""
    rules, out = len(quality.RULES), {}
    strata = {s for s, g, _ in rows if g}
    share, level = quality.RISK / rules, quality.DELTA / (rules * max(1, len(strata)))
    for s in strata:
        for j in range(rules):
            good = [b[j] for t, g, b in rows if t == s and g]
            bad = [b[j] for t, g, b in rows if t == s and not g]
            best = None
            for cut in sorted({b for b in good + bad}, reverse=True):
                k, n = sum(b >= cut for b in good), len(good)
                p = 1.0 if k > share * n else math.fsum(math.exp(
                    math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(share) + (n - i) * math.log1p(-share))
                    for i in range(k + 1))
                if cut == 0 or p > level:
                    break
                caught = sum(b >= cut for b in bad)
                if caught and (best is None or caught > best[0]):
                    best = (caught, cut)
            if best:
                out[s, j] = best[1]
    return out


def test_cutoffs_equal_brute_force_and_hold_the_risk(spark):
    rng = random.Random(8)
    rows = []
    for s, n in (("en", 3000), ("de", 2500), ("xx", 40)):
        for _ in range(n):
            good = rng.random() < 0.9
            bins = [min(100, int(rng.expovariate(1 / (2 if good else 30)))) if j < 3 else (0 if good else rng.choice([0, 60])) for j in range(5)]
            rows.append((s, good, bins))
    rows.append(("en", None, [0] * 5))
    want = brute_cuts([r for r in rows if r[1] is not None])
    got = quality.thresholds(spark.createDataFrame(rows, "stratum string, good boolean, rule_bins array<int>")).collect()
    found = {(r["stratum"], j): r[f"cut_{j}"] for r in got for j in range(5) if r[f"cut_{j}"] is not None}
    assert found == want and any(s == "en" for s, _ in found) and not any(s == "xx" for s, _ in found)
    for s in ("en", "de"):
        good = [b for t, g, b in rows if t == s and g]
        assert sum(any(b[j] >= found.get((s, j), 999) for j in range(5)) for b in good) <= quality.RISK * len(good)


def test_rules_without_labels_keep_what_the_base_keeps(spark):
    texts = ["word " * 5, " ".join(f"w{i}" for i in range(30)), None, "a b c d e " * 4]
    df = spark.createDataFrame([(i, t, None if i else "en", "x") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, stratum string")
    labels = spark.createDataFrame([(1, None), (77, 1)], "doc_id bigint, quality int")
    out = {r["doc_id"]: r["kept"] for r in quality.rated(df, labels).collect()}
    assert out == {0: False, 1: True, 2: False, 3: False}
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [1]
    assert quality.rated(df.limit(0), labels.limit(0)).count() == 0


# ---- WARC ----

@pytest.fixture(scope="module")
def pages(spark):
    data = [(3, "http://b", "<p>same ü</p>"), (1, "http://a", "<p>same ü</p>"), (7, None, None), (8, "http://c\r\nX: y", ""),
            (9, "http://d", "x" * 300_000 + "\r\n\r\nWARC/1.1\r\n"), (1, "http://a", "<p>same ü</p>"), (None, "http://n", "lone")]
    return spark.createDataFrame([(*r, "extra", 5) for r in data], "page_id bigint, url string, html string, payload string, record_type int")


def test_round_trip_and_revisits(spark, pages, tmp_path):
    path = f"file:{tmp_path}/w"
    warc.archive(pages, path)
    out = warc.read(spark, path).collect()
    assert len(out) == 7
    for r in out:
        html = next((h or "" for i, _, h, _, _ in pages.collect() if f"urn:page:{'' if i is None else i}" == r["record_id"]))
        raw = html.encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        assert r["payload"] is None or bytes(r["payload"]) == raw
    kinds = sorted((r["record_id"], r["record_type"], r["refers_to"]) for r in out)
    assert kinds == [("urn:page:", "response", None), ("urn:page:1", "response", None), ("urn:page:1", "response", None),
                     ("urn:page:3", "revisit", "urn:page:1"), ("urn:page:7", "response", None), ("urn:page:8", "revisit", "urn:page:7"),
                     ("urn:page:9", "response", None)]
    assert next(r for r in out if r["record_id"] == "urn:page:8")["target_uri"] == "http://c%0D%0AX: y"


def test_small_payloads_are_not_revisited(spark, pages, tmp_path):
    warc.archive(pages, str(tmp_path / "w"), least=5)
    out = warc.read(spark, str(tmp_path / "w"), ["record_id", "record_type"]).where("record_type = 'revisit'").collect()
    assert [r["record_id"] for r in out] == ["urn:page:3"]


def test_filters_are_pushed_and_payloads_left_alone(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.archive(pages, path)
    df = warc.read(spark, path, ["record_id", "record_type"]).where("record_type = 'revisit' AND record_id IN ('urn:page:8', 'urn:page:9')")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan or "Filter (" not in plan
    assert [r["record_id"] for r in df.collect()] == ["urn:page:8"]
    reader = warc.WarcReader({"path": path}, spark.createDataFrame([], "record_id string, record_type string").schema)
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.In(("payload_bytes",), (1,))])) == [warc.In(("payload_bytes",), (1,))]
    assert sum(len(list(reader.read(p))) for p in reader.partitions()) == 2


def test_members_of_other_writers_are_read(tmp_path):
    parts = [warc.record({"record_id": f"urn:page:{i}", "record_type": "response", "payload": b"z" * i}) for i in (0, 10, 100_000)]
    (tmp_path / "plain.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts) + warc.member(parts[1]))
    (tmp_path / "_pending-1").mkdir()
    (tmp_path / "_pending-1" / "part.warc.gz").write_bytes(b"broken")
    for names in (["record_id", "payload"], ["record_id"]):
        schema = type("S", (), {"fields": [type("N", (), {"name": n}) for n in names]})
        reader = warc.WarcReader({"path": str(tmp_path)}, schema)
        out = [r for p in reader.partitions() for r in reader.read(p)]
        assert [r[0] for r in out] == ["urn:page:0", "urn:page:10", "urn:page:100000", "urn:page:10"]
        assert len(names) == 1 or [len(r[1]) for r in out] == [0, 10, 100_000, 10]


def test_empty_archive(spark, pages, tmp_path):
    warc.archive(pages.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_files_roll_over_and_partitions_follow_size(spark, pages, tmp_path):
    rows = pages.coalesce(1).select(warc.record_urn(F.col("page_id")).alias("record_id"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    warc.write(rows, str(tmp_path / "w"), roll=1)
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) == 7
    assert warc.read(spark, str(tmp_path / "w"), partition=1).rdd.getNumPartitions() == 7


def test_files_of_a_job_without_its_mark_are_not_read(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.archive(pages, path)
    once = warc.read(spark, path).count()
    mark, = (tmp_path / "w").glob("_committed-*")
    warc.archive(pages, "file:" + path)  # added to what is there; the scheme may be written
    assert warc.read(spark, path).count() == 2 * once
    mark.unlink()
    assert warc.read(spark, path).count() == once


def test_payloads_that_most_pages_share(spark, tmp_path):
    same = [(i, "u", "same" if i % 3 else f"own {i}") for i in range(300)]
    warc.archive(spark.createDataFrame(same, "page_id bigint, url string, html string").repartition(4), str(tmp_path / "w"))
    out = warc.read(spark, str(tmp_path / "w"), ["record_id", "record_type", "refers_to"]).collect()
    assert len(out) == 300
    assert {r["record_id"] for r in out if r["record_type"] == "revisit"} == {f"urn:page:{i}" for i in range(300) if i % 3 and i != 1}
    assert {r["refers_to"] for r in out if r["record_type"] == "revisit"} == {"urn:page:1"}
