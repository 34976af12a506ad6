"""Repeated texts, hot keys and jobs that read their input once: what grows with the rows and what does not."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fragloom.functions import tokens
from fragloom.operators import dataset, lineage, randomize, ranking, tokenmodel, vocab
from fragloom.plans import jobs
from fragloom.sources import readers, writers


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_a_text_do_not_meet_in_one_task(spark):
    rows = spark.range(0, 4000, 1, 8).selectExpr("id", "IF(id < 3900, '[*]CC', concat('[*]', repeat('N', int(id % 7)))) AS smi", "map('a', id) AS m")
    words = vocab.build(rows, {"s": "smi"})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ids = vocab.encode(rows, words, {"s": "smi"})
        back = vocab.decode(ids, words, {"s": "s_ids"})
        for df in (ids, back):  # the same text in rows of several tasks after the join
            hot = df.where("id < 3900").groupBy(F.spark_partition_id()).count().collect()
            assert len(hot) > 1 and max(r["count"] for r in hot) < 3900 * 0.9
        assert back.where("s_text <=> smi").count() == 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranked_rows_are_shuffled_once_and_written_without_what_only_orders_them(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ranking, "materialise", lambda df: written.append(df) or lineage.materialise(df))
    rows = spark.range(1000).selectExpr("cast(id as string) AS key")
    placed = dataset.batches(rows, "key", 2, 10, 7)
    assert written[0].columns == ["key", "epoch", "_place"]
    assert "Exchange hashpartitioning" not in _plan(placed) and placed.count() == 2000
    got = {(r["key"], r["epoch"]): r["batch"] for r in placed.collect()}
    import hashlib
    for epoch in (1, 2):
        order = sorted(map(str, range(1000)), key=lambda k: (hashlib.md5(f"7|{k}|{epoch}".encode()).hexdigest(), k))
        assert all(got[k, epoch] == i // 10 for i, k in enumerate(order))


def _in_order(keys, epoch, size):
    """Keys of every whole batch, by the digests."""
    def place(k):
        return hashlib.md5("|".join(["7", "\\N" if k is None else k, str(epoch)]).encode()).digest(), k is not None, k or ""

    order = sorted(keys, key=place)
    return [Counter(order[i:i + size]) for i in range(0, len(order) // size * size, size)]


def test_padded_batches_shuffle_their_rows_once_and_write_none(spark, monkeypatch):
    data = [(None if i % 400 == 0 else f"k{i // 2 if i < 300 else i}", "C" * (i % 7) + "[*]", "[*]" + "NOC"[i % 3] * (i % 11)) for i in range(2005)]
    data += [("odd", "C[*]", "F"), ("none", "C[*]", None)]
    pairs = spark.createDataFrame(data, "key string, scaffold string, decoration string").repartition(3)
    monkeypatch.setattr(dataset, "TASK_ROWS", 0)
    words = vocab.build(pairs, {"scaffold": "scaffold", "decoration": "decoration"}).where("token != 'F'")
    kinds = [dataset.narrowed(spark.createDataFrame([], "a array<bigint>"), ["a"], w).dtypes[0][1] for w in (127, 128, 1 << 15, 1 << 31)]
    assert kinds == ["array<tinyint>", "array<smallint>", "array<int>", "array<bigint>"]
    for far in (0, 40_000):
        wide = lineage.materialise(words.withColumn("id", F.when(F.col("token") == "N", F.col("id") + far).otherwise(F.col("id"))))
        number = {(r["side"], r["token"]): r["id"] for r in wide.collect()}
        with monkeypatch.context() as m:
            m.setattr(ranking, "materialise", lambda df: 1 / 0)
            made = jobs.epoch_batches(pairs, wide, 2, 5, "key", 7)
        assert dict(made.dtypes)["decoration_ids"] == "array<bigint>" and "_task" not in made.columns
        # no row of the encoded table is shuffled but by its task, neither to be numbered nor to be padded
        assert re.findall(r"Exchange (\w+)", _plan(made)) == ["shufflepartitionidpassthrough"]
        rows = made.collect()
        assert len(rows) == 2 * 2005
        got = {}
        for r in rows:
            got.setdefault((r["epoch"], r["batch"]), []).append(r)
        texts = Counter((k, d) for k, _, d in data[:2005])
        for epoch in (1, 2):
            want = _in_order([k for k, _, _ in data[:2005]], epoch, 5)
            assert [Counter(r["key"] for r in got[epoch, i]) for i in range(len(want))] == want
            names = {n: t for (side, t), n in number.items() if side == "decoration"}
            back = Counter((r["key"], "".join(names[i] for i in r["decoration_ids"][1:r["decoration_ids_len"] - 1])) for r in rows if r["epoch"] == epoch)
            assert back == texts
        for batch in got.values():
            for side in ("scaffold", "decoration"):
                longest = max(r[f"{side}_ids_len"] for r in batch)
                assert all(len(r[f"{side}_ids"]) == longest and set(r[f"{side}_ids"][r[f"{side}_ids_len"]:]) <= {0} for r in batch)


def test_whole_batches_keep_the_rest_and_leave_hot_keys_to_the_ranks(spark, monkeypatch):
    monkeypatch.setattr(dataset, "TASK_ROWS", 0)
    even = lineage.materialise(spark.range(1003).selectExpr("cast(id as string) AS key", "id % 4 AS v"))
    for drop in (True, False):
        placed = dataset.batches(even, "key", 3, 5, 7, drop, rows=1003)
        assert "_task" in placed.columns
        assert placed.groupBy("epoch", "batch").agg(F.countDistinct("_task").alias("t")).agg(F.max("t")).first()[0] == 1
        here = sorted(map(tuple, placed.drop("_task").collect()))
        assert here == sorted(map(tuple, dataset.batches(even, "key", 3, 5, 7, drop).select(*placed.drop("_task").columns).collect()))
        assert len(here) == 3 * (1000 if drop else 1003)
    hot = lineage.materialise(spark.range(3000).selectExpr("IF(id < 2900, NULL, cast(id as string)) AS key", "id AS v"))
    placed = dataset.batches(hot, "key", 2, 5, 7, rows=3000)
    assert "_task" not in placed.columns
    assert {r["count"] for r in placed.groupBy("epoch", "batch").count().collect()} == {5} and placed.select("epoch", "v").distinct().count() == 6000
    assert dataset.batches(even.limit(0), "key", 2, 5, 7, rows=0).count() == 0


def _counting(spark, rows):
    """The rows, and a counter of how often they were read."""
    seen = spark.sparkContext.accumulator(0)

    def passing(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return rows.mapInArrow(passing, StructType(rows.schema.fields)), seen


def test_a_model_is_fitted_once_whoever_uses_it(spark):
    data = [(f"{'C' * (i % 5)}[*]", "[*]" + "CNO"[i % 3] * (i % 4)) for i in range(60)]
    rows = spark.createDataFrame(data, "scaffold string, decoration string")
    for use in (lambda m: tokenmodel.sample(rows.withColumn("i", F.monotonically_increasing_id()), m, max_len=5, key=["i"]).count(),
                lambda m: tokenmodel.score(rows, m).count()):
        pairs, seen = _counting(spark, rows)
        assert use(tokenmodel.fit(pairs)) == 60
        assert seen.value <= 60 * 2  # by the counts and, in another stage, by the number of tokens


def test_rejects_read_each_different_slicing_once_and_keep_nulls_and_copies(spark):
    data = [("[*:0]CC[*:1]", ["[*]C", "[*]C("])] * 300 + [("[*:0]CC", ["[*]C"])] * 50 + [(None, ["[*]C"]), ("C", None), (None, None), ("[*:0]C", []), ("C1[*:0]", ["[*]C"])] * 2
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id int, scaffold string, decorations array<string>")
    got = {r["id"]: r["reason"] for r in randomize.rejects(rows).collect()}
    for i, (scaffold, _) in enumerate(data[:350]):
        assert got.get(i) == ("unreadable_decoration" if i < 300 else None)
    for i in range(350, 355):
        assert got.get(i) == got.get(i + 5) is not None
    assert got[354] == "unreadable_scaffold" and got[353] == "point_without_decoration" and got[351] == "no_numbered_point"
    plan = _plan(randomize.rejects(rows))
    assert "ArrowEvalPython" not in plan  # the rows themselves meet no Python: they look up what was written


def test_files_of_one_epoch_are_one_set(spark, tmp_path):
    rows = spark.range(0, 60, 1, 6).selectExpr("int(id % 2) + 1 AS epoch", "concat('C', id % 3, '[*]') AS scaffold", "'[*]C' AS decoration")
    writers.write_training_sets(rows, str(tmp_path / "sets"))
    assert len(list((tmp_path / "sets" / "epoch=1").glob("part-*"))) > 1
    back = readers.read_training_sets(spark, str(tmp_path / "sets"))
    assert {r["set_no"]: r["count"] for r in back.groupBy("set_no").count().collect()} == {0: 30, 1: 30}
    assert "Exchange hashpartitioning" not in _plan(back)


def test_untokenize_makes_the_tokens_once(spark):
    df = spark.createDataFrame([("CC[N+]Br$",), ("^C",), ("",), (None,)], "t string").repartition(2)
    df = df.select("t", tokens.untokenize(tokens.tokenize(F.col("t"))).alias("u"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("regexp_extract_all", plan)) == 1
    assert {r["t"]: r["u"] for r in df.collect()} == {"CC[N+]Br$": "CC[N+]Br", "^C": "C", "": "", None: None}
