"""Queries that write views of the given tables with the writers and read them back with the readers; single rules."""

from pyspark.sql import functions as F

from ..functions import attach, rules
from ..operators import graph, randomize, slicing, stats, tokenmodel, vocab
from ..operators.lineage import new_path
from ..operators.spread import spread
from ..sources import readers, writers
from . import fixtures as fx
from .registry import query
from .vocabulary import PAIR_WORDS, VOCAB, _pair_words, _vocab


@query("smiles_file", "WITH " + fx.sql("fx_molecule") + " SELECT smiles, count(*) AS n FROM fx_molecule GROUP BY smiles")
def smiles_file(spark, sf):
    """Compressed lines of molecule, key and a blank line now and then; the first field is read back."""
    path = new_path(spark, "text")
    mols = fx.view(spark, sf, "fx_molecule")
    line = F.when(F.col("p_size") % 2 == 0, F.concat_ws("\t", "smiles", F.col("mol_id").cast("string"))).otherwise(F.concat(F.col("smiles"), F.lit("  \n \t")))
    mols.select(line.alias("value")).write.option("compression", "gzip").text(path)
    return readers.read_smiles(spark, path).groupBy("smiles").agg(F.count(F.lit(1)).alias("n"))


@query("pairs_file", "WITH " + fx.sql("fx_pair") + """
    SELECT scaffold, decoration, CASE WHEN pair_id LIKE '1%' THEN concat(pair_id, chr(9), 'x') ELSE '' END AS rest FROM fx_pair""")
def pairs_file(spark, sf):
    path = new_path(spark, "text")
    extra = F.when(F.col("pair_id").startswith("1"), F.concat(F.lit("\t"), F.col("pair_id"), F.lit("\tx"))).otherwise(F.lit(""))
    fx.view(spark, sf, "fx_pair").select(F.concat(F.concat_ws("\t", "scaffold", "decoration"), extra).alias("value")).write.text(path)
    return readers.read_pairs(spark, path)


@query("sliced_file", "WITH " + fx.sql("fx_round") + """
    SELECT scaffold, concat(decoration, '|', '[*]C') AS packed, smiles FROM fx_round""")
def sliced_file(spark, sf):
    """Slicings written as a table and as text; the text of the table's rows is read back."""
    folder = new_path(spark, "sliced")
    rows = fx.view(spark, sf, "fx_round").select("scaffold", F.array("decoration", F.lit("[*]C")).alias("decorations"), "smiles")
    writers.write_sliced(rows, parquet_path=f"{folder}/table")
    writers.write_sliced(spark.read.parquet(f"{folder}/table"), text_path=f"{folder}/text")
    return readers.read_sliced(spark, f"{folder}/text").select("scaffold", attach.pack_single(F.col("decorations")).alias("packed"), "smiles")


@query("training_set_files", "WITH " + fx.sql("fx_train") + """
    SELECT CAST(e - 1 AS INT) AS set_no, scaffold, decoration, count(*) AS n FROM fx_train, range(1, 4) x(e) WHERE length(pair_id) % 3 <> e % 3 GROUP BY ALL""")
def training_set_files(spark, sf):
    """Epochs of different rows, a folder each, written by all tasks and read back as numbered sets."""
    path = new_path(spark, "sets")
    rows = fx.view(spark, sf, "fx_train").withColumn("epoch", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    rows = rows.where(F.length("pair_id") % 3 != F.col("epoch") % 3)
    writers.write_training_sets(rows.select("epoch", "scaffold", "decoration"), path)
    return readers.read_training_sets(spark, path).groupBy("set_no", "scaffold", "decoration").agg(F.count(F.lit(1)).alias("n"))


@query("conditions_file", "WITH " + fx.sql("fx_word") + """ SELECT smiles, CAST(6 AS BIGINT) AS n FROM (SELECT DISTINCT smiles FROM fx_word)""")
def conditions_file(spark, sf):
    """Conditions kept as JSON: of a chain of eight atoms one to three leave, and five at least stay."""
    path = new_path(spark, "conditions")
    spark.range(1).select(F.lit('{"scaffold": {"hac": {"min": 5}}, "decoration": {"hac": {"max": 3}}}').alias("value")).write.text(path)
    scaffold, decoration = readers.read_conditions(spark, path)
    parsed = graph.parse_molecules(slicing.distinct_texts(fx.view(spark, sf, "fx_word")))
    cuts = slicing.work_units(slicing.with_cuts(parsed, "hr", scaffold, decoration), 1)
    return slicing.enumerate_cuts(cuts, 1, scaffold).groupBy("smiles").agg(F.count(F.lit(1)).alias("n"))


# --- fixed values: a molecule for each rule, and how many of its bonds the rule cuts ---
GROUPS = [("amide", "CC(=O)NC", 1), ("ester", "CC(=O)OC", 1), ("amine", "CNC", 2), ("ether", "COC", 2), ("olefin", "CC=CC", 1),
          ("quaternary_nitrogen", "C[N+](C)(C)C", 4), ("aromatic_nitrogen", "Cn1cccc1", 1), ("lactam_nitrogen", "CN1CCCC1=O", 1),
          ("biaryl", "c1ccccc1-c1ccccc1", 1), ("sulphonamide", "CS(=O)(=O)NC", 1)]
# --- end of fixed values ---


@query("rule_sites", "SELECT p_partkey AS mol_id, CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{r}'" for i, (r, _, _) in enumerate(GROUPS))
       + " END AS rule, CAST(CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN {n}" for i, (_, _, n) in enumerate(GROUPS)) + " END AS BIGINT) AS n_sites FROM part")
def rule_sites(spark, sf):
    """Every named rule alone, on a molecule that has its group."""
    kind = F.col("p_partkey") % 10
    names = F.array(*[F.lit(r) for r, _, _ in GROUPS])
    smiles = F.array(*[F.lit(s) for _, s, _ in GROUPS])
    mols = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("mol_id"), F.get(names, kind).alias("rule"), F.get(smiles, kind).alias("smiles"))
    parsed = graph.parse_molecules(spread(mols.select("smiles").distinct(), "smiles"))
    found = None
    for name, rule in rules.RECAP.items():
        sites = graph.with_cut_sites(parsed, {name: rule}).select("smiles", F.lit(name).alias("rule"), F.size("sites").cast("bigint").alias("n_sites"))
        found = sites if found is None else found.unionByName(sites)
    return mols.join(found, ["smiles", "rule"]).select("mol_id", "rule", "n_sites")


@query("user_rule_sites", "WITH " + fx.sql("fx_assembly") + """, d AS (SELECT mol_id, CAST(floor(mol_id / pow(10, i)) AS BIGINT) % 10 AS g FROM fx_assembly, range(0, 5) x(i))
    SELECT mol_id, count(*) FILTER (g = 9) AS n_sites FROM d GROUP BY mol_id""")
def user_rule_sites(spark, sf):
    """A rule of the user's own: single bonds between carbon and fluorine."""
    own = {"fluoride": lambda bond, a, b: (bond["ord"] == "-") & (a["elem"] == "C") & (b["elem"] == "F")}
    mols = fx.view(spark, sf, "fx_assembly")
    parsed = graph.parse_molecules(slicing.distinct_texts(mols))
    sites = graph.with_cut_sites(parsed, own).select("smiles", F.size("sites").cast("bigint").alias("n_sites"))
    return mols.join(sites, "smiles").select("mol_id", "n_sites")


@query("graph_points", "WITH " + fx.sql("fx_scaffold") + r"""
    SELECT scaffold_id, array_to_string(regexp_extract_all(scaffold, '\[\*:(\d+)\]', 1), ',') AS points,
           CAST(len(regexp_extract_all(scaffold, '\*')) AS BIGINT) AS n_points,
           array_to_string(range(len(regexp_extract_all(scaffold, '\*'))), ',') AS numbered, '' AS cleared, true AS terminal FROM fx_scaffold""")
def graph_points(spark, sf):
    """Attachment points read, numbered and cleared on the graph, and all of them terminal."""
    rows = fx.view(spark, sf, "fx_scaffold")
    atoms = F.col("graph.atoms")

    def listed(points):
        return F.array_join(points.cast("array<string>"), ",")

    parsed = graph.parse_molecules(spread(rows.select(F.col("scaffold").alias("smiles")).distinct(), "smiles"))
    found = parsed.select(F.col("smiles").alias("scaffold"), listed(graph.graph_points(atoms)).alias("points"),
                          graph.count_graph_points(atoms).cast("bigint").alias("n_points"),
                          listed(graph.graph_points(graph.number_atoms(atoms))).alias("numbered"),
                          listed(graph.graph_points(graph.clear_numbers(atoms))).alias("cleared"), graph.points_are_terminal(atoms).alias("terminal"))
    return rows.join(found, "scaffold").drop("scaffold")


@query("vocab_add_rows", "WITH " + VOCAB + PAIR_WORDS + """
    SELECT side, token, CAST(id AS BIGINT) AS id FROM vocab
    UNION ALL SELECT side, token, CAST(100000 + row_number() OVER (PARTITION BY side ORDER BY token) AS BIGINT)
    FROM (SELECT f.side, f.token FROM fresh f ANTI JOIN vocab v ON f.side = v.side AND f.token = v.token)""")
def vocab_add_rows(spark, sf):
    """New tokens with ids of their own, far above the ones in use."""
    words = _vocab(spark, sf)
    fresh = _pair_words(spark, sf).join(words, ["side", "token"], "left_anti")
    listed = fresh.groupBy("side").agg(F.array_sort(F.collect_set("token")).alias("l"))
    rows = listed.select("side", F.posexplode("l").alias("_p", "token")).select("side", "token", (F.col("_p") + 100001).cast("bigint").alias("id"))
    return vocab.add_rows(words, rows)


@query("appended_metrics", "WITH " + fx.sql("fx_nll") + """
    SELECT CAST(r AS INT) AS run, grp, round(avg(nll), 6) AS mean_nll, round(var_pop(nll), 6) AS var_nll FROM fx_nll, range(1, 3) x(r) GROUP BY ALL""")
def appended_metrics(spark, sf):
    """The metrics of two runs, added to one folder; the first run was written by a job that failed later, and runs again."""
    path = new_path(spark, "metrics")
    for run in (1, 2, 1):
        writers.write_metrics(stats.moments(fx.view(spark, sf, "fx_nll")).withColumn("run", F.lit(run)), path, "run")
    return spark.read.parquet(path).select("run", "grp", F.round("mean_nll", 6).alias("mean_nll"), F.round("var_nll", 6).alias("var_nll"))


def _by_length():
    """Stands for a loaded network: a batch function over its inputs."""
    def predict(scaffold, decoration):
        import numpy as np

        return np.array([len(s) + 2.0 * len(d) for s, d in zip(scaffold, decoration)])
    return predict


@query("scored_with_function", "WITH " + fx.sql("fx_pair") + " SELECT pair_id, CAST(length(scaffold) + 2 * length(decoration) AS DOUBLE) AS nll FROM fx_pair")
def scored_with_function(spark, sf):
    rows = fx.view(spark, sf, "fx_pair")
    return tokenmodel.score_with(rows, _by_length, ["scaffold", "decoration"]).select("pair_id", "nll")


@query("training_rejects", "WITH " + fx.sql("fx_pair") + """
    SELECT * FROM (SELECT pair_id, CASE WHEN scaffold NOT LIKE '%[*:%' THEN 'no_numbered_point' WHEN scaffold LIKE '%[*:2]%' THEN 'point_without_decoration'
        WHEN decoration = '[*]C(' THEN 'unreadable_decoration' END AS reason FROM fx_pair) WHERE reason IS NOT NULL""")
def training_rejects(spark, sf):
    """Slicings of two decorations; some scaffolds have three points or none, some decorations do not parse."""
    rows = fx.view(spark, sf, "fx_pair").select("pair_id", "scaffold", F.array("decoration", F.lit("[*]C")).alias("decorations"))
    return randomize.rejects(rows).select("pair_id", "reason")
