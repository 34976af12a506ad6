"""Operators on small tables: golden values, properties, brute force."""
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fragloom import kernel
from fragloom.functions import attach, conditions, descriptors, rules, tokens
from fragloom.operators import dataset, graph, lookup, merge, randomize, ranking, slicing, stats, tokenmodel, vocab
from fragloom.operators.lineage import materialise
from fragloom.plans import decorate, jobs, quality
from fragloom.plans.slice import slice_table
from fragloom.sources import readers, writers


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_attachment_text(spark):
    s = F.lit("*C[*]N([*:5])C")
    assert _one(spark, attach.number_all(s)) == "[*:0]C[*:1]N([*:2])C"
    assert _one(spark, attach.number_first(s, 9)) == "[*:9]C[*]N([*:5])C"
    assert _one(spark, attach.add_brackets(s)) == "[*]C[*]N([*:5])C"
    assert _one(spark, attach.remove_numbers(s)) == "*C[*]N([*])C"
    assert _one(spark, attach.points(s)) == [5]
    assert _one(spark, attach.first_point(F.lit("CC"))) is None
    assert _one(spark, attach.count_points(s)) == 3
    assert _one(spark, attach.number_packed(F.lit("*C|[*]O"))) == ["[*:0]C", "[*:1]O"]


def test_tokens(spark):
    text = "BrC[nH]%12Cl(C)[*:0]"
    want = ["Br", "C", "[nH]", "%12", "Cl", "(", "C", ")", "[*:0]"]
    assert _one(spark, tokens.tokenize(F.lit(text), marks=False)) == want
    assert _one(spark, tokens.untokenize(tokens.tokenize(F.lit(text)))) == text
    assert _one(spark, tokens.point_neighbour(F.lit("CC[*]"))) == "C"
    assert _one(spark, tokens.point_neighbour(F.lit("[*:0](Cl)C"))) == "("
    assert _one(spark, tokens.point_neighbour(F.lit("CC"))) == ""


@pytest.mark.parametrize("rule, hit, miss", [
    ("amide", "CC(=O)NC", "CCNC"), ("ester", "CC(=O)OC", "CCOC"), ("amine", "CCN(C)C", "c1ccccc1N"),
    ("ether", "CCOC", "CCSC"), ("olefin", "CC=C(C)C", "CC=NC"), ("quaternary_nitrogen", "C[N+](C)(C)C", "CN(C)C"),
    ("aromatic_nitrogen", "Cn1cccc1", "Cc1ccccc1"), ("lactam_nitrogen", "CN1CCCC1=O", "CN1CCCC1"),
    ("biaryl", "c1ccccc1c1ccccc1", "c1ccccc1C"), ("sulphonamide", "CS(=O)(=O)NC", "CSNC"),
])
def test_each_cut_rule(spark, texts, rule, hit, miss):
    only = {rule: rules.RECAP[rule]}
    sites = graph.with_cut_sites(graph.parse_molecules(texts(hit, miss)), only)
    found = {r["smiles"]: r["n"] for r in sites.select("smiles", F.size("sites").alias("n")).collect()}
    assert found[hit] >= 1 and found[miss] == 0


def test_unknown_rule_set_and_descriptor():
    with pytest.raises(ValueError):
        rules.resolve("other")
    with pytest.raises(ValueError):
        conditions.names({"other": 1})


def test_descriptors(spark, texts):
    parsed = graph.parse_molecules(texts("CC(=O)Nc1ccc(OC)cc1"))
    a, b = F.col("graph.atoms"), F.col("graph.bonds")
    row = parsed.select(*[descriptors.span(n, a, b).alias(n) for n in descriptors.NAMES if n != "clogp"]).first()
    assert (row["hac"], row["hbd"], row["hba"], row["rotatable_bonds"], row["num_rings"]) == (12, 1, 3, 2, 1)
    assert math.isclose(row["mol_weight"], 165.19, abs_tol=0.02)
    with pytest.raises(ValueError):
        descriptors.span("clogp", a, b)


def test_conditions_agree_with_descriptors_of_the_parts(spark, texts):
    """Pushed-down sums equal the descriptors of the written fragments."""
    mols = texts("CC(=O)Nc1ccc(OC)cc1", "O=C(c1ccccc1)N1CCN(Cc2ccccc2)CC1", "CC(C)(C)OC(=O)NCC")
    scaffold, decoration = {"num_rings": {"min": 1}, "mol_weight": {"max": 160}}, {"hac": {"max": 8}, "rotatable_bonds": {"max": 1}, "hba": 1}
    kept = {(r[0], tuple(r[1])) for r in slice_table(mols, "hr", 3, scaffold, decoration).select("scaffold", "decorations").collect()}
    every = [(r[0], tuple(r[1])) for r in slice_table(mols, "hr", 3).select("scaffold", "decorations").collect()]
    parts = graph.parse_molecules(texts(*{s for s, _ in every} | {d for _, ds in every for d in ds}))
    a, b = F.col("graph.atoms"), F.col("graph.bonds")
    values = {r["smiles"]: r for r in parts.select(
        "smiles", *[descriptors.span(n, a, b).alias(n) for n in ("num_rings", "mol_weight", "hac", "rotatable_bonds", "hba")]).collect()}

    def passes(text, wanted):
        return all(values[text][n] == c if not isinstance(c, dict) else
                   c.get("min", -1e9) <= values[text][n] <= c.get("max", 1e9) for n, c in wanted.items())

    want = {(s, ds) for s, ds in every if passes(s, scaffold) and all(passes(d, decoration) for d in ds)}
    assert kept == want and 0 < len(want) < len(every)


def test_work_units_do_not_change_the_result(spark, texts, monkeypatch):
    mols = texts("CC(C)(C)OC(=O)NCCOCCN", "CCCC", "CCCC")
    want = sorted(map(str, slice_table(mols, "hr", 4).collect()))
    for pairs in (1, 7, 30):
        monkeypatch.setattr(slicing, "PAIRS_PER_UNIT", pairs)
        cuts = slicing.with_cuts(graph.parse_molecules(slicing.distinct_texts(mols)), "hr")
        units = slicing.work_units(cuts, 4)
        assert units.count() > 2
        assert units.groupBy("smiles", F.size("cuts").alias("n")).count().where("count > n * n").count() == 0
        assert sorted(map(str, slice_table(mols, "hr", 4).collect())) == want
    assert slice_table(mols, "hr", 1).count() == sum("cuts=1" in r for r in want)


def test_very_long_lines_are_parsed_once(spark, texts):
    chain, line = "C" * 2000, "word and " * 7000
    rows = slicing.rejects(texts(line, chain, "C" * 60_000 + "(")).collect()
    assert sorted(len(r["smiles"]) for r in rows) == [60_001, 63_000] and all(r["reason"] for r in rows)
    assert slicing.slice_molecules(texts(line, "C" * 300), "hr", 1).count() == 2 * 299


def test_falling_minima_prune_but_do_not_change_the_result(spark, texts, monkeypatch):
    mols = texts("CC(C)(C)OC(=O)NCCOCCN")
    wanted = {"hac": {"min": 4}, "mol_weight": {"min": 50, "max": 200}}
    want = sorted(map(str, slice_table(mols, "hr", 4, scaffold_conditions=wanted).collect()))
    monkeypatch.setattr(slicing, "FALLING", ())
    assert want and sorted(map(str, slice_table(mols, "hr", 4, scaffold_conditions=wanted).collect())) == want


def test_rejects(spark, texts):
    rows = slicing.rejects(texts("CC.C", "[*]C", "C1", "CC")).collect()
    assert {r["smiles"]: r["reason"] for r in rows} == {"CC.C": "multi_component", "[*]C": "attachment_point", "C1": "open_ring"}


def test_graph_number_operators(spark, texts):
    atoms = F.col("graph.atoms")
    rows = graph.parse_molecules(texts("[*:4]CC([*])[*:2]"))
    row = rows.select(graph.graph_points(atoms).alias("p"), graph.count_graph_points(atoms).alias("n"),
                      graph.graph_points(graph.number_atoms(atoms)).alias("q"),
                      graph.graph_points(graph.clear_numbers(atoms)).alias("z"),
                      graph.points_are_terminal(atoms).alias("t")).first()
    assert (row["p"], row["n"], row["q"], row["z"], row["t"]) == ([4, 2], 3, [0, 1, 2], [], True)


def test_slice_and_graft_round_trip(spark, texts):
    mols = texts("CC(=O)Nc1ccc(OC)cc1", "N(CC)(CCC)CCO")
    rows = slicing.slice_molecules(mols, "hr", 4)
    numbered = F.transform("decorations", lambda d, i: attach.number_first(d, i))
    back = rows.withColumn("again", graph.graft_numbered(F.col("scaffold"), numbered))
    assert back.count() > 40 and back.where(~F.col("again").eqNullSafe(F.col("smiles"))).count() == 0


def test_ranked_positions(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).alias("g"))
    got = ranking.ranked(df, ["g"], ["id"], "pos").collect()
    want = {}
    for r in sorted(got, key=lambda r: r["id"]):
        want[r["g"]] = want.get(r["g"], 0) + 1
        assert r["pos"] == want[r["g"]]


def test_ranks_of_hot_groups_equal_keys_and_nulls(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ranking, "materialise", lambda df: written.append(materialise(df)) or written[-1])
    data = [(i % 7 if i % 3 else None, None if i % 11 == 0 else min(i, 500)) for i in range(3000)] + [(None, 5)] * 1500
    df = spark.createDataFrame(data, "g int, k int")
    got = ranking.ranked(df, ["g"], ["k"], "pos").collect()
    for g in {g for g, _ in data}:
        rows = sorted((r["pos"], r["k"]) for r in got if r["g"] == g)
        keys = sorted((k for h, k in data if h == g), key=lambda k: (k is not None, k))
        assert [p for p, _ in rows] == list(range(1, len(keys) + 1)) and [k for _, k in sorted(rows, key=lambda r: r[0])] == keys
    whole = ranking.ranked(df, [], ["k"], "pos")
    assert sorted(r["pos"] for r in whole.collect()) == list(range(1, 4501))
    assert ranking.ranked(df.limit(0), ["g"], ["k"], "pos").count() == 0
    # equal keys are spread too (few rows would be merged again into one task)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert ranking.ranked(df, [], ["k"], "pos").count() == 4500
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = written[-1].groupBy(F.shiftright("_place", 33)).count()
    assert parts.agg(F.max("count")).first()[0] < 4500 / 2


def test_numbered_rows_read_their_input_once(spark, tmp_path):
    spark.range(500).withColumn("grp", F.col("id") % 3).withColumn("nll", F.col("id") * 1.0).write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    for made in (stats.truncated(rows, ["id"]), stats.jsd_raw(stats.truncated(rows, ["id"])), dataset.batches(rows, "id", 2, 10)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(str(tmp_path)) == 0  # only the numbered rows are read from here on
        assert made.count() > 0


def test_vocabulary_tables(spark):
    df = spark.createDataFrame([("C[*]", "CCl"), ("N[*]", "O")], "scaffold string, decoration string")
    sides = {"scaffold": "scaffold", "decoration": "decoration"}
    v = vocab.build(df, sides)
    ids = {(r["side"], r["token"]): r["id"] for r in v.collect()}
    assert [ids["scaffold", t] for t in ("<pad>", "$", "^", "C", "N", "[*]")] == [0, 1, 2, 3, 4, 5]
    new = spark.createDataFrame([("scaffold", "A"), ("scaffold", "C")], "side string, token string")
    assert vocab.extend(v, new).where("token = 'A'").first()["id"] == 6
    assert vocab.difference(v, v).count() == 0
    again = spark.createDataFrame([("scaffold", "S", 3)], "side string, token string, id bigint")
    with pytest.raises(Exception, match="already present"):
        vocab.add_rows(v, again).collect()


def test_encoding_is_one_path_for_any_vocabulary(spark):
    texts = ["C[*]", "CCl", "N[*]", "", None, "F", "C[*]", "CC" * 300]
    big = [("s", f"[{i}]", i + 10) for i in range(6000)] + [("s", t, i) for i, t in enumerate(["<pad>", "$", "^", "C", "[*]", "Cl", "N"])]
    rows = spark.createDataFrame([(1, t) for t in texts], "key int, smi string").withColumn("s_ids", F.lit("clash"))
    words = spark.createDataFrame(big, "side string, token string, id bigint")
    number = {t: i for _, t, i in big}
    want = sorted(str((t, None if t in (None, "F") else [number[x] for x in ["^", *re.findall(r"\[\*\]|Cl|.", t), "$"]])) for t in texts)
    for limit in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        encoded = vocab.encode(rows, words, {"s": "smi"})
        assert sorted(str((r["smi"], r["s_ids"])) for r in encoded.collect()) == want
        back = vocab.decode(encoded, words, {"s": "s_ids"}).collect()
        assert all(r["s_text"] == (None if r["smi"] in (None, "F") else r["smi"]) for r in back) and len(back) == len(texts)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    ids = spark.createDataFrame([([],), (None,), ([None],), ([3, 77777],)], "ids array<bigint>")
    assert [r["s_text"] for r in vocab.decode(ids, words, {"s": "ids"}).collect() if r["ids"] == []] == [""]
    assert vocab.decode(ids, words, {"s": "ids"}).where("s_text IS NULL").count() == 3
    assert vocab.encode(rows.limit(0), words, {"s": "smi"}).count() == 0


def test_batches_drop_the_last_and_pad(spark):
    rows = spark.createDataFrame([(i, list(range(i % 4 + 1))) for i in range(23)], "key int, ids array<bigint>")
    kept = dataset.pad(dataset.batches(rows, "key", 2, 5), ["ids"]).collect()
    assert len(kept) == 2 * 20
    widths = {}
    for r in kept:
        widths.setdefault((r["epoch"], r["batch"]), set()).add(len(r["ids"]))
        assert r["ids_len"] == r["key"] % 4 + 1
    assert all(len(w) == 1 for w in widths.values())
    assert dataset.batches(rows, "key", 1, 5, drop_last=False).count() == 23


@pytest.fixture(scope="module")
def model(spark):
    pairs = [("[*]c1ccccc1", "[*]C")] * 5 + [("[*]c1ccccc1", "[*]CC")] * 3 + [("[*]c1ccccc1", "[*]O")] * 2 + [("N[*]", "[*]CN")]
    return materialise(tokenmodel.fit(spark.createDataFrame(pairs, "scaffold string, decoration string"), alpha=0.01))


def test_model_probabilities_sum_to_one(model):
    seen = model.groupBy("context").agg(
        (F.sum(F.exp("logp")) + (F.max("n_tokens") - F.count("token")) * F.max("alpha")
         / (F.max("n_context") + F.max("alpha") * F.max("n_tokens"))).alias("p"))
    assert all(math.isclose(r["p"], 1) for r in seen.collect())


def test_score_by_hand_and_oov(spark, model):
    rows = spark.createDataFrame([("[*]c1ccccc1", "[*]C"), ("[*]c1ccccc1", "[*]Br"), ("[*]c1ccccc1", "[*]C")], "scaffold string, decoration string")
    got = tokenmodel.score(rows, model).collect()
    v, a = 5, 0.01
    want = -sum(math.log((n + a) / (t + a * v)) for n, t in ((10, 10), (8, 10), (5, 8)))
    assert [r["oov"] for r in got].count(True) == 1 and len(got) == 3
    for r in got:
        assert r["nll"] is None if r["oov"] else math.isclose(r["nll"], want)


def replay(model, near, state, max_len, order=2):
    """One draw by a walk over the whole alphabet: (decoration, nll, finished)."""
    counts = {}
    for r in model:
        counts.setdefault(tuple(r["context"]), {})[r["token"]] = r["n"]
    alphabet, alpha = sorted({r["token"] for r in model}), model[0]["alpha"]
    text, nll, history = "", 0.0, ["^"] * order
    for _ in range(max_len - 1):
        state = state * 48271 % 2147483647
        seen = counts.get((*history, near), {})
        total, run = sum(seen.values()) + alpha * len(alphabet), 0
        for i, token in enumerate(alphabet, 1):
            run += seen.get(token, 0)
            if (run + alpha * i) / total > state / 2147483647:
                break
        nll -= math.log((seen.get(token, 0) + alpha) / total)
        if token == "$":
            return text, nll, True
        text, history = text + token, [*history, token][1:] if order else []
    return text, nll, False


@pytest.mark.parametrize("order", [0, 1, 2])
def test_draws_equal_a_walk_over_the_alphabet(spark, order):
    pairs = [("[*]c1ccccc1", "[*]C")] * 5 + [("[*]c1ccccc1", "[*]CC(C)=O")] * 3 + [("[*]c1ccccc1", "[*]O")] * 2 + [("N[*]", "[*]CN"), ("N[*]", "[*]BrZ")]
    for alpha in (0.01, 1e-12):
        fitted = materialise(tokenmodel.fit(spark.createDataFrame(pairs, "scaffold string, decoration string"), order, alpha))
        rows = [(i, s) for i, s in enumerate(["[*]c1ccccc1", "N[*]", "CC", "[*]F", "[*]c1ccccc1"] * 4)]
        # columns named like the operator's own stay as they are
        frame = spark.createDataFrame(rows, "key int, scaffold string").withColumns({n: F.lit("mine") for n in ("context", "total", "token", "lo", "first", "bin")})
        known = fitted.collect()
        start = {(r["key"], r["draw"]): (r["near"], r["_state"]) for r in tokenmodel.draw_rows(frame, 2, 4, ["key"]).collect()}
        for max_len in (1, 12):
            got = tokenmodel.sample(frame, fitted, 2, order, max_len, 4, key=["key"]).collect()
            assert len(got) == 40 and all(r["token"] == "mine" and r["total"] == "mine" for r in got)
            for r in got:
                text, nll, finished = replay(known, *start[r["key"], r["draw"]], max_len, order)
                assert (r["decoration"], r["finished"]) == (text, finished) and math.isclose(r["nll"], nll, abs_tol=1e-9)


def test_a_model_of_two_million_rows(spark):
    """400,000 contexts of five tokens each, from an alphabet of 20,000."""
    token = "IF(t = 4 AND c % 3 = 0, '$', concat('[', (c * 7919 + t * 3571) % 20000, ']'))"
    near = "concat('[', c, ']')"
    grams = spark.range(400_000).selectExpr("id AS c", "explode(sequence(0, 4)) AS t").selectExpr(f"array('^', {near}) AS context", f"{token} AS token", "t + 1 AS n")
    model = grams.groupBy("context", "token").agg(F.sum("n").alias("n")).withColumns({"n_context": F.lit(15).cast("bigint"), "alpha": F.lit(0.0005)})
    model = materialise(model.withColumn("n_tokens", F.lit(20001).cast("bigint")))
    assert model.count() == 2_000_000
    rows = spark.range(300).selectExpr("id", "concat('[*][', id * 1331 % 500000, ']') AS scaffold")
    got = tokenmodel.sample(rows, model, 1, 1, 3, 9, key=["id"]).collect()
    assert len(got) == 300 and sum(r["finished"] for r in got) > 5
    local = {r["token"] for r in model.select("token").distinct().collect()}
    assert len(local) == 20001
    wanted = spark.createDataFrame([(r["scaffold"], r["decoration"], r["nll"]) for r in got if r["finished"]], "scaffold string, decoration string, drawn double")
    for r in tokenmodel.score(wanted, model, 1).collect():
        assert math.isclose(r["nll"], r["drawn"], rel_tol=1e-9)


def test_scores_with_frequent_keys_set_apart(spark, model, monkeypatch):
    texts = [("[*]c1ccccc1", "[*]C")] * 400 + [("[*]c1ccccc1", "[*]" + "C" * (i % 9 + 1) + "N" * (i % 5)) for i in range(200)] + [("N[*]", "[*]Br"), (None, "[*]C"), ("N[*]", None)]
    rows = spark.createDataFrame(texts, "scaffold string, decoration string").withColumn("_uses", F.lit("mine")).withColumn("_heavy_", F.lit(1))
    want = None
    for size in (0, lookup.BROADCAST_BYTES):
        monkeypatch.setattr(lookup, "BROADCAST_BYTES", size)
        for limit in ("-1", "10m"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            got = sorted(map(str, tokenmodel.score(rows, model).withColumn("nll", F.round("nll", 9)).collect()))
            want = want or got
            assert got == want and len(got) == len(texts)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    grams = spark.createDataFrame([("a", 900, 1.0), ("b", 5, 2.0), ("c", 5, 3.0)], "k string, u long, x double")
    assert [r["k"] for r in lookup.frequent(grams, "u").collect()] == ["a"]
    left = spark.createDataFrame([("a",)] * 50 + [("b",), ("z",), (None,)], "k string")
    got = Counter((r["k"], r["x"]) for r in lookup.lookup(left, grams, ["k"], "u").collect())
    assert got == {("a", 1.0): 50, ("b", 2.0): 1, ("z", None): 1, (None, None): 1}


def test_draws_tell_whether_they_ended_and_variants_how_many_there_are(spark, model):
    rows = spark.createDataFrame([("[*]c1ccccc1", i) for i in range(60)], "scaffold string, copy int")
    whole = {(r["copy"]): r["decoration"] for r in tokenmodel.sample(rows, model, 1, key=["copy"]).collect() if r["finished"]}
    for max_len in (1, 4, 9):
        cut = tokenmodel.sample(rows, model, 1, max_len=max_len, key=["copy"]).collect()
        assert len(whole) == len(cut) == 60
        for r in cut:
            steps = len(re.findall(r"\[[^\]]*\]|Br|Cl|.", whole[r["copy"]])) + 1
            assert r["finished"] == (steps <= max_len - 1) and (r["decoration"] == whole[r["copy"]]) >= r["finished"]
    with pytest.raises(TypeError):
        tokenmodel.sample(rows, model)
    spelled = randomize.randomized(spark.createDataFrame([("CC",), ("CCO",)], "smiles string"), "smiles", 3, attempts=500)
    assert sorted((r["smiles"], r["variant_no"], r["n_found"]) for r in spelled.collect()) == [("CC", 0, 1), *[("CCO", i, 3) for i in range(3)]]


def test_long_contexts_are_joined(spark):
    pairs = spark.createDataFrame([("[*]c1ccccc1", "[*]CCNCCO"), ("N[*]", "[*]CN")] * 3, "scaffold string, decoration string")
    deep = tokenmodel.fit(pairs, order=40, alpha=0.01)
    assert tokenmodel.sample(pairs.select("scaffold").distinct(), deep, 1, order=40, max_len=3, key=["scaffold"]).count() == 2


def test_vocabulary_limits_scores(spark, model):
    rows = spark.createDataFrame([("[*]c1ccccc1", "[*]C"), ("[*]S", "[*]C")], "scaffold string, decoration string")
    v = vocab.build(rows.limit(1), {"scaffold": "scaffold", "decoration": "decoration"})
    got = {r["scaffold"]: r["oov"] for r in tokenmodel.score(rows, model, vocabulary=v).collect()}
    assert got == {"[*]c1ccccc1": False, "[*]S": True}


def test_sampled_frequencies_follow_the_model(spark, model):
    rows = spark.createDataFrame([(1, "[*]c1ccccc1")], "key int, scaffold string")
    drawn = Counter(r["decoration"] for r in tokenmodel.sample(rows, model, 4000, key=["key"]).collect())
    assert abs(drawn["[*]C"] / 4000 - 0.5) < 0.03 and abs(drawn["[*]CC"] / 4000 - 0.3) < 0.03


def test_own_network_scores(spark):
    rows = spark.createDataFrame([(1.0,), (2.5,)], "x double")
    got = tokenmodel.score_with(rows, lambda: lambda x: x * 2, ["x"]).collect()
    assert sorted(r["nll"] for r in got) == [2.0, 5.0]


def test_training_pairs(spark, texts):
    sliced = slice_table(texts("CC(=O)Nc1ccc(OC)cc1"), "hr", 2)
    table = {(attach_free(r["scaffold"]), tuple(r["decorations"])) for r in sliced.collect()}
    multi = randomize.training_pairs(sliced, 3, "multi", 1).collect()
    assert len(multi) == 3 * sliced.count()
    assert {kernel.canonical_text(r["scaffold"]) for r in multi} == {s for s, _ in table}
    every = {d for _, ds in table for d in ds}
    assert all(kernel.canonical_text(r["decoration"]) in every for r in multi)
    single = randomize.training_pairs(sliced, 1, "single", 1).collect()
    for r in single:
        made = kernel.graft_all(number(r["scaffold"]), [d.replace("[*]", f"[*:{i}]") for i, d in enumerate(r["decoration"].split("|"))])
        assert made == kernel.canonical_text("CC(=O)Nc1ccc(OC)cc1")
    again = randomize.training_pairs(sliced.repartition(7), 3, "multi", 1).collect()
    assert sorted(map(str, again)) == sorted(map(str, multi))
    with pytest.raises(ValueError):
        randomize.training_pairs(sliced, 1, "other")


def attach_free(text):
    import re
    return re.sub(r"\[\*:\d+\]", "[*]", text)


def number(text):
    parts = text.split("[*]")
    return parts[0] + "".join(f"[*:{i}]{p}" for i, p in enumerate(parts[1:]))


def test_merge_keeps_counts_and_the_earliest_representative(spark):
    def rows(*r):
        return spark.createDataFrame(r, "smiles string, scaffold string, decorations map<int,string>, count bigint")
    got = {r["smiles"]: r for r in merge.merge([rows(("C", "z", {0: "a"}, 2)), rows(("C", "a", {}, 3), ("N", "b", {1: "x"}, 1))]).collect()}
    assert (got["C"]["scaffold"], got["C"]["count"], got["N"]["decorations"]) == ("z", 5, {1: "x"})


@pytest.mark.parametrize("kind", ["multi", "single"])
def test_decoration_loop_against_driver_side_replay(spark, texts, kind):
    """The same draws replayed molecule by molecule give the same results and counts."""
    shown_scaffolds = ["[*]c1ccccc1", "c1ccccc1[*]", "C([*])C", "[*]CC", "CO[*]", "c1(ccccc1)[*]"]
    drawn = ["[*]C", "[*]CN", "[*]C("] if kind == "multi" else ["[*]C|[*]N", "[*]CN", "[*]O|[*]F"]
    train = [(s, d) for s in shown_scaffolds for d in drawn]
    fitted = tokenmodel.fit(spark.createDataFrame(train, "scaffold string, decoration string"), alpha=0.01)
    start = ["[*:0]c1ccc([*:1])cc1", "[*:1]CCO", "[*:0]c1ccc([*:1])cc1", "CC", "*N"]
    args = dict(r=3, n=8, max_randomized=40, max_len=20, seed=3)
    got = {r["smiles"]: (r["count"], r["scaffold"], r["decorations"]) for r in decorate.decorate(texts(*start), fitted, kind, **args).collect()}

    draw = tokenmodel.Sampler(fitted, 2, 20)
    counts, shown = Counter(start), {s: (s, {}) for s in start}
    seen, open_rows = set(start), {s: (s, {}) for s in start}
    for i in range(2 if kind == "multi" else 1):
        frame = spark.createDataFrame([(s, o, d) for s, (o, d) in open_rows.items()], "smiles string, scaffold string, decorations map<int,string>")
        fresh = Counter()
        options = {}
        for r in draw(tokenmodel.draw_rows(decorate._variants(frame, 3, 40, False, 3 + i), 8, 3 + i, ["smiles", "variant_no"])).collect():
            texts_ = r["decoration"].split("|") if kind == "single" else [r["decoration"]]
            points = r["points"] if kind == "single" else r["points"][:1]
            if len(texts_) != len(points) or kind == "single" and r["scaffold"].count("*") != len(points):
                continue
            try:
                made = kernel.graft_all(r["smiles"], [t.replace("[*]", f"[*:{p}]", 1) for t, p in sorted(zip(texts_, points), key=lambda x: x[1])])
            except kernel.Invalid:
                continue
            if made is not None:
                fresh[made] += 1
                entries = {**r["decorations"], **{p: kernel.canonical_text(t) for t, p in zip(texts_, points)}}
                options.setdefault(made, []).append((r["origin"], sorted(entries.items())))
        best = {m: min(o) for m, o in options.items()}
        open_rows = {m: (best[m][0], dict(best[m][1])) for m in fresh if "*" in m and m not in seen}
        counts.update(fresh)
        for m in fresh:
            shown.setdefault(m, (best[m][0], dict(best[m][1])))
        seen |= set(fresh)
    assert {s: (counts[s], *shown[s]) for s in counts} == got and len(got) > 5


def test_loop_rejects_unknown_kind(spark, texts, model):
    with pytest.raises(ValueError):
        decorate.decorate(texts("[*:0]C"), model, "other")


def test_sample_rows_needs_enough(spark):
    df = spark.range(5)
    assert stats.sample_rows(df, 5, ["id"]).count() == 5
    with pytest.raises(ValueError):
        stats.sample_rows(df, 6, ["id"])


def test_histogram_edges(spark):
    values = [0.0, 0.1, 0.3, 0.7, 100.0, 99.95, 100.01, -1.0, 0.6, 0.6999999]
    df = spark.createDataFrame([("g", v) for v in values], "grp string, nll double")
    filled = {r["bin"] for r in df.where("nll between 0 and 100").select(stats.bin_index(F.col("nll")).alias("bin")).collect()}
    import numpy as np
    want = set(np.nonzero(np.histogram(values, bins=1000, range=(0, 100))[0])[0].tolist())
    assert filled == want
    assert math.isclose(stats.histogram(df).agg(F.sum("p")).first()[0], 1)


def test_divergence_of_equal_groups_is_zero(spark):
    df = spark.createDataFrame([(g, i, float(i + 1)) for g in "ab" for i in range(9)], "grp string, id int, nll double")
    rows = stats.truncated(df, ["id"])
    assert abs(stats.jsd_raw(rows).first()[0]) < 1e-12 and abs(stats.jsd_binned(rows).first()[0]) < 1e-12


def test_quality_metrics(spark, model):
    pairs = spark.createDataFrame([(i, "[*]c1ccccc1", "[*]C" if i % 2 else "[*]CC") for i in range(40)], "key int, scaffold string, decoration string")
    metrics, hist = quality.collect(pairs, pairs, model, 20, 3, other_values={"lr": 0.5})
    got = {r["metric"]: r["value"] for r in metrics.collect()}
    assert len(got) == 13 and got["lr"] == 0.5 and got["valid_training"] > 50
    assert hist.groupBy("metric").count().count() == 4


def test_files(spark, texts, tmp_path):
    raw = tmp_path / "in.smi"
    raw.write_text("CC(=O)NC\tname\t\n\nCCO\n")
    assert [r["smiles"] for r in readers.read_smiles(spark, str(raw)).collect()] == ["CC(=O)NC", "CCO"]
    assert readers.read_rows(spark, str(raw), ignore_invalid=False).count() == 3
    assert readers.read_rows(spark, str(raw), num=1, num_fields=1).first()["fields"] == ["CC(=O)NC"]
    sliced = slice_table(readers.read_smiles(spark, str(raw)), "recap", 2)
    writers.write_sliced(sliced, str(tmp_path / "p"), str(tmp_path / "t"))
    back = readers.read_sliced(spark, str(tmp_path / "t"))
    assert sorted(map(str, back.collect())) == sorted(map(str, sliced.select(*back.columns).collect()))
    assert spark.read.parquet(str(tmp_path / "p")).count() == sliced.count()
    jobs.training_sets(spark, str(tmp_path / "t"), str(tmp_path / "sets"), 2)
    assert spark.read.text(str(tmp_path / "sets")).groupBy("epoch").count().count() == 2
    sets = tmp_path / "numbered"
    sets.mkdir()
    for i in range(2):
        (sets / f"00{i}.smi").write_text(f"[*]C\t[*]{'CN'[i]}\n")
    assert {(r["set_no"], r["decoration"]) for r in readers.read_training_sets(spark, str(sets)).collect()} == {(0, "[*]C"), (1, "[*]N")}
    rules_file = tmp_path / "conditions.json"
    rules_file.write_text('{"scaffold": {"num_rings": {"min": 1}},\n "decoration": {"hac": 3}}')
    assert readers.read_conditions(spark, str(rules_file)) == ({"num_rings": {"min": 1}}, {"hac": 3})


def test_scored_and_sampled_files(spark, model, tmp_path):
    pairs = tmp_path / "pairs.smi"
    pairs.write_text("[*]c1ccccc1\t[*]C\tx\ty\n[*]c1ccccc1\t[*]Br\n")
    jobs.nlls(spark, str(pairs), model, str(tmp_path / "scored"), gzip=True)
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "scored")).collect())
    assert lines[0] == "[*]c1ccccc1\t[*]Br\t" and lines[1].startswith("[*]c1ccccc1\t[*]C\tx\ty\t0.")
    scaffolds = tmp_path / "scaffolds.smi"
    scaffolds.write_text("[*]c1ccccc1\nN[*]\nN[*]\n")
    jobs.samples(spark, str(scaffolds), model, str(tmp_path / "drawn"), with_nll=True)
    assert spark.read.text(str(tmp_path / "drawn")).count() == 3
    rows = decorate.initial_results(spark.createDataFrame([("[*:0]C",)], "smiles string"))
    writers.write_results(rows, str(tmp_path / "r"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first()["decorations"] == "{}"
    for epoch in (1, 2, 2):
        writers.write_metrics(spark.range(3).withColumn("epoch", F.lit(epoch)), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 6
    with pytest.raises(ValueError):
        writers.write_results(rows, str(tmp_path / "q"), "other")
