"""Queries of the molecule operators: cuts, rules, descriptors, joins, decoration."""

from pyspark.sql import functions as F

from ..functions import attach, descriptors
from ..operators import graph, randomize, slicing, tokenmodel
from ..plans import decorate as loop
from ..operators.spread import spread
from ..plans.slice import slice_table
from ..sources import writers
from . import fixtures as fx
from .registry import query


def _distinct(df, column="smiles"):
    """Distinct texts of a view: the molecule work is done once per text."""
    return spread(df.select(column).distinct(), column)


# sites and arms of fx_molecule under the single-bond rule
MOL = "WITH " + fx.sql("fx_molecule") + """, arms AS (SELECT mol_id, smiles, mol_id % 7 AS kind, p_size % 6 + 1 AS path,
    p_size % 3 + 1 AS a, p_size % 4 + 1 AS b, p_size % 5 + 1 AS c FROM fx_molecule),
    m AS (SELECT *, CASE kind WHEN 0 THEN path WHEN 1 THEN path WHEN 2 THEN a + b + c WHEN 3 THEN 5 WHEN 4 THEN 4 END AS m FROM arms) """


@query("parse_rejects", "WITH " + fx.sql("fx_molecule") + """SELECT mol_id, smiles, CASE mol_id % 7 WHEN 5 THEN 'multi_component' ELSE 'branches' END AS reason
    FROM fx_molecule WHERE mol_id % 7 IN (5, 6)""")
def parse_rejects(spark, sf):
    mols = fx.view(spark, sf, "fx_molecule")
    return mols.join(slicing.rejects(_distinct(mols)), "smiles").select("mol_id", "smiles", "reason")


@query("slice_documents_rejects", "SELECT doc_id, length(text) AS n_chars, true AS rejected FROM documents WHERE text IS NOT NULL")
def slice_documents_rejects(spark, sf):
    """Prose of any length is told from molecules by one parse of each different text."""
    docs = fx.table(spark, sf, "documents").where(F.col("text").isNotNull())
    found = slicing.rejects(slicing.distinct_texts(docs, "text")).select(F.col("smiles").alias("text"), "reason")
    return docs.join(found, "text", "left").select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.col("reason").isNotNull().alias("rejected"))


@query("condition_rejects", """SELECT p_partkey AS mol_id, CASE p_partkey % 4 WHEN 0 THEN 'CC[Xx]CC' WHEN 1 THEN 'CCO' ELSE 'CC=C' END AS smiles,
    CASE p_partkey % 4 WHEN 0 THEN 'unknown_element' ELSE 'unknown_atom_type' END AS reason FROM part WHERE p_partkey % 4 != 2""")
def condition_rejects(spark, sf):
    """Molecules outside the tables of masses and contributions are named; palladium has a mass."""
    mols = fx.table(spark, sf, "part").selectExpr("p_partkey AS mol_id", """CASE p_partkey % 4 WHEN 0 THEN 'CC[Xx]CC' WHEN 1 THEN 'CCO'
        WHEN 2 THEN 'CC[Pd]CC' ELSE 'CC=C' END AS smiles""")
    table = {"CH3": 0.1, "CH2": 0.2, "PdH0": 0.0}
    return mols.join(slicing.rejects(_distinct(mols), contributions=table), "smiles").select("mol_id", "smiles", "reason")


@query("cut_sites", MOL + "SELECT mol_id, CAST(m AS BIGINT) AS n_sites FROM m WHERE m IS NOT NULL")
def cut_sites(spark, sf):
    mols = fx.view(spark, sf, "fx_molecule")
    parsed = graph.parse_molecules(_distinct(mols)).where(slicing.reject_reason().isNull())
    sites = graph.with_cut_sites(parsed, "hr").select("smiles", F.size("sites").cast("bigint").alias("n_sites"))
    return mols.join(sites, "smiles").select("mol_id", "n_sites")


def _picks(df, rules, max_cuts, scaffold=None, decoration=None):
    parsed = graph.parse_molecules(slicing.distinct_texts(df)).where(slicing.reject_reason().isNull())
    cuts = slicing.with_cuts(parsed, rules, scaffold, decoration)
    return slicing.enumerate_cuts(slicing.work_units(cuts, max_cuts), max_cuts, scaffold)


@query("slices_by_cuts", MOL + """, k AS (
    SELECT mol_id, 1 AS cuts, 2 * m AS n FROM m WHERE m IS NOT NULL
    UNION ALL SELECT mol_id, 2, m * (m - 1) / 2 FROM m WHERE m IS NOT NULL
    UNION ALL SELECT mol_id, 3, a * b * c FROM m WHERE kind = 2)
    SELECT mol_id, cuts, CAST(n AS BIGINT) AS n FROM k WHERE n > 0""")
def slices_by_cuts(spark, sf):
    mols = fx.view(spark, sf, "fx_molecule")
    counts = _picks(mols, "hr", 4).groupBy("smiles", F.size("picks").alias("cuts")).agg(F.count(F.lit(1)).alias("n"))
    return mols.join(counts, "smiles").select("mol_id", "cuts", "n")


# fx_assembly: pieces by digit, their inner single bonds, and the bonds between pieces
DIGITS = "WITH " + fx.sql("fx_assembly") + """, d AS (SELECT mol_id, smiles, unnest(range(0, 5)) AS i FROM fx_assembly),
    e AS (SELECT mol_id, smiles, CAST(floor(mol_id / pow(10, i)) AS BIGINT) % 10 AS g FROM d) """


@query("assembly_sites", DIGITS + """SELECT mol_id, CAST(6 + sum(CASE WHEN g IN (3, 7, 8, 9) THEN 1 ELSE 0 END) AS BIGINT) AS n_sites,
    CAST(2 + sum(CASE g WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 6 WHEN 7 THEN 2 WHEN 8 THEN 2 WHEN 9 THEN 2 ELSE 1 END) AS BIGINT) AS hac,
    CAST(sum(CASE WHEN g = 5 THEN 1 ELSE 0 END) AS BIGINT) AS num_rings,
    CAST(sum(CASE WHEN g IN (1, 2, 4, 8) THEN 1 ELSE 0 END) AS BIGINT) AS hba,
    CAST(sum(CASE WHEN g = 2 THEN 1 ELSE 0 END) AS BIGINT) AS hbd,
    round(2 * 12.011 + 6 * 1.008 + sum(CASE g WHEN 0 THEN 12.011 + 2 * 1.008 WHEN 1 THEN 15.999 WHEN 2 THEN 14.007 + 1.008
        WHEN 3 THEN 2 * 12.011 + 4 * 1.008 WHEN 4 THEN 12.011 + 15.999 WHEN 5 THEN 6 * 12.011 + 4 * 1.008 WHEN 6 THEN 32.06
        WHEN 7 THEN 2 * 12.011 + 4 * 1.008 WHEN 8 THEN 14.007 + 12.011 + 3 * 1.008 ELSE 12.011 + 18.998 + 1.008 END)::DOUBLE, 3) AS mol_weight
    FROM e GROUP BY mol_id""")
def assembly_sites(spark, sf):
    mols = fx.view(spark, sf, "fx_assembly")
    rows = graph.with_cut_sites(graph.parse_molecules(spread(mols, "mol_id")), "hr")
    atoms, bonds = F.col("graph.atoms"), F.col("graph.bonds")
    whole = [descriptors.span(n, atoms, bonds).cast("bigint").alias(n) for n in ("hac", "num_rings", "hba", "hbd")]
    return rows.select("mol_id", F.size("sites").cast("bigint").alias("n_sites"), *whole,
                       F.round(descriptors.span("mol_weight", atoms, bonds), 3).alias("mol_weight"))


@query("assembly_slices", DIGITS + """, m AS (SELECT mol_id, 6 + sum(CASE WHEN g IN (3, 7, 8, 9) THEN 1 ELSE 0 END) AS m FROM e GROUP BY mol_id)
    SELECT s.smiles, CAST(any_value(2 * m) AS BIGINT) AS one_cut, CAST(any_value(m * (m - 1) / 2) AS BIGINT) AS two_cuts
    FROM fx_assembly s JOIN m USING (mol_id) GROUP BY s.smiles""")
def assembly_slices(spark, sf):
    picks = _picks(fx.view(spark, sf, "fx_assembly"), "hr", 2)
    return picks.groupBy("smiles").agg(F.count_if(F.size("picks") == 1).alias("one_cut"),
                                       F.count_if(F.size("picks") == 2).alias("two_cuts"))


@query("slice_conditions", DIGITS + """, p AS (SELECT mol_id, smiles, i, CAST(floor(mol_id / pow(10, i)) AS BIGINT) % 10 AS g FROM d
          WHERE mol_id IN (SELECT min(mol_id) FROM fx_assembly GROUP BY smiles)),
    w AS (SELECT *, CASE g WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 6 WHEN 7 THEN 2 WHEN 8 THEN 2 WHEN 9 THEN 2 ELSE 1 END AS h,
                 CASE WHEN g = 5 THEN 1 ELSE 0 END AS r FROM p),
    t AS (SELECT smiles, sum(h) + 2 AS h, sum(r) AS r FROM (SELECT DISTINCT smiles, i, h, r FROM w) GROUP BY smiles),
    -- chain cuts before piece i: atoms and rings to the left; the piece's own cut: inside CC or at a side atom
    x AS (SELECT DISTINCT smiles, i, g, h, r, 1 + coalesce(sum(h) OVER (PARTITION BY mol_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lh,
                 coalesce(sum(r) OVER (PARTITION BY mol_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lr FROM w),
    c AS (SELECT smiles, lh AS far_h, lr AS far_r FROM x
          UNION ALL SELECT smiles, h - 1, r FROM t
          UNION ALL SELECT smiles, lh + 1, lr FROM x WHERE g = 3
          UNION ALL SELECT smiles, 1, 0 FROM x WHERE g IN (7, 8, 9)),
    s AS (SELECT c.smiles, far_h AS dec_h, t.r - far_r AS scaf_r FROM c JOIN t USING (smiles)
          UNION ALL SELECT c.smiles, t.h - far_h, far_r FROM c JOIN t USING (smiles))
    SELECT smiles, count(*) AS n FROM s WHERE dec_h <= 4 AND scaf_r >= 1 GROUP BY smiles""")
def slice_conditions(spark, sf):
    picks = _picks(fx.view(spark, sf, "fx_assembly"), "hr", 1, {"num_rings": {"min": 1}}, {"hac": {"max": 4}})
    return picks.groupBy("smiles").agg(F.count(F.lit(1)).alias("n"))


# every cut of an eight-atom chain: two ends at one cut, a middle and two ends at two cuts
WORD_SLICINGS = "WITH " + fx.sql("fx_word") + """, w AS (SELECT DISTINCT smiles AS w FROM fx_word),
    one AS (SELECT reverse(w[1:i]) AS l, w[i + 1:8] AS r FROM w, range(1, 8) x(i)),
    two AS (SELECT w[i + 1:j] AS mid, reverse(w[1:i]) AS l, w[j + 1:8] AS r FROM w, range(1, 8) x(i), range(1, 8) y(j) WHERE i < j),
    s AS (SELECT DISTINCT 1 AS cuts, concat_ws('|', l, r) AS slicing FROM one UNION SELECT DISTINCT 1, concat_ws('|', r, l) FROM one
    UNION SELECT DISTINCT 2, least(concat_ws('|', mid, l, r), concat_ws('|', reverse(mid), r, l)) FROM two) """


@query("slice_distinct", WORD_SLICINGS + "SELECT cuts, slicing FROM s")
def slice_distinct(spark, sf):
    rows = slice_table(fx.view(spark, sf, "fx_word"), "hr", 2)
    core = F.regexp_replace(F.col("scaffold"), r"\[\*:\d\]", "")
    ends = F.transform("decorations", lambda d: F.substring(d, 4, 100))
    there = F.concat_ws("|", core, ends)
    back = F.concat_ws("|", F.reverse(core), F.reverse(ends))
    return rows.select("cuts", F.when(F.col("cuts") == 1, there).otherwise(F.least(there, back)).alias("slicing"))


@query("normalize_sliced", WORD_SLICINGS + "SELECT CAST(cuts AS BIGINT) AS cuts, count(*) AS n, count(*) AS n_same FROM s GROUP BY cuts")
def normalize_sliced(spark, sf):
    """Respelled scaffolds with their numbers turned round come back to the sliced form."""
    sliced = slice_table(fx.view(spark, sf, "fx_word"), "hr", 2)
    last = F.size("decorations") - 1
    turned = F.regexp_replace(F.regexp_replace(F.col("scaffold"), r"\[\*:0\]", "[*:x]"), r"\[\*:1\]", "[*:0]")
    turned = F.regexp_replace(turned, F.lit(r"\[\*:x\]"), F.concat(F.lit("[*:"), last.cast("string"), F.lit("]")))
    rows = sliced.select(F.col("scaffold").alias("was"), F.col("decorations").alias("had"), "cuts", F.get(
        graph.respell(F.array(turned), F.xxhash64("scaffold", "decorations")), F.lit(0)).alias("scaffold"),
        F.reverse("decorations").alias("decorations"))
    back = graph.normalize_sliced(rows)
    same = (F.col("scaffold") == F.col("was")) & (F.col("decorations") == F.col("had"))
    return back.groupBy(F.col("cuts").cast("bigint").alias("cuts")).agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_same"))


@query("slice_texts", """SELECT * FROM (VALUES
    ('C(C)(Nc1ccc(cc1)OC)=O', 'amide', '[*:0]C(C)=O', '[*]Nc1ccc(cc1)OC'), ('C(C)(Nc1ccc(cc1)OC)=O', 'amide', '[*:0]Nc1ccc(cc1)OC', '[*]C(C)=O'),
    ('C(C)(Nc1ccc(cc1)OC)=O', 'ether', '[*:0]C', '[*]Oc1ccc(cc1)NC(C)=O'), ('C(C)(Nc1ccc(cc1)OC)=O', 'ether', '[*:0]Oc1ccc(cc1)NC(C)=O', '[*]C'),
    ('C(C)(Nc1ccc(cc1)OC)=O', 'both', '[*:0]Nc1ccc(cc1)O[*:1]', '[*]C(C)=O;[*]C'),
    ('C(c1ccccc1)(N1CCN(Cc2ccccc2)CC1)=O', 'amide', '[*:0]C(c1ccccc1)=O', '[*]N1CCN(Cc2ccccc2)CC1'),
    ('C(c1ccccc1)(N1CCN(Cc2ccccc2)CC1)=O', 'amide', '[*:0]N1CCN(Cc2ccccc2)CC1', '[*]C(c1ccccc1)=O'),
    ('C(c1ccccc1)(N1CCN(Cc2ccccc2)CC1)=O', 'amine', '[*:0]Cc1ccccc1', '[*]N1CCN(C(c2ccccc2)=O)CC1'),
    ('C(c1ccccc1)(N1CCN(Cc2ccccc2)CC1)=O', 'amine', '[*:0]N1CCN(C(c2ccccc2)=O)CC1', '[*]Cc1ccccc1'),
    ('C(c1ccccc1)(N1CCN(Cc2ccccc2)CC1)=O', 'both', '[*:0]N1CCN([*:1])CC1', '[*]C(c1ccccc1)=O;[*]Cc1ccccc1')
    ) v(smiles, cut, scaffold, decorations) WHERE (SELECT count(*) FROM part) >= 7""")
def slice_texts(spark, sf):
    """Retrosynthetic slicings of the two drug-like templates."""
    mols = fx.view(spark, sf, "fx_molecule").where(F.col("smiles").contains("N") & F.col("smiles").contains("c"))
    rows = slice_table(mols, "recap", 4)
    dec = F.array_join("decorations", ";")
    cut = (F.when(F.col("cuts") == 2, "both").when(F.col("scaffold").isin("[*:0]C", "[*:0]Oc1ccc(cc1)NC(C)=O"), "ether")
           .when(F.col("scaffold").contains("C(c2ccccc2)=O") | dec.contains("C(c2ccccc2)=O"), "amine").otherwise("amide"))
    return rows.select("smiles", cut.alias("cut"), "scaffold", dec.alias("decorations"))


@query("recap_sites", MOL + """SELECT mol_id, CAST(CASE kind WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 2 END AS BIGINT) AS n_sites FROM m WHERE m IS NOT NULL""")
def recap_sites(spark, sf):
    mols = fx.view(spark, sf, "fx_molecule")
    parsed = graph.parse_molecules(_distinct(mols)).where(slicing.reject_reason().isNull())
    sites = graph.with_cut_sites(parsed, "recap").select("smiles", F.size("sites").cast("bigint").alias("n_sites"))
    return mols.join(sites, "smiles").select("mol_id", "n_sites")


@query("descriptors", MOL + """SELECT mol_id, CAST(CASE kind WHEN 0 THEN 6 + path WHEN 1 THEN 1 + path WHEN 2 THEN 1 + a + b + c WHEN 3 THEN 12 ELSE 21 END AS BIGINT) AS hac,
    CAST(CASE kind WHEN 0 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 3 ELSE 0 END AS BIGINT) AS num_rings,
    CAST(CASE kind WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 3 ELSE 0 END AS BIGINT) AS hba,
    CAST(CASE kind WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS hbd,
    CAST(CASE kind WHEN 0 THEN path - 1 WHEN 1 THEN greatest(path - 2, 0) WHEN 2 THEN a + b + c - 3 WHEN 3 THEN 2 ELSE 3 END AS BIGINT) AS rotatable_bonds,
    round(CASE kind WHEN 0 THEN (6 + path) * 12.011 + (6 + 2 * path) * 1.008 WHEN 1 THEN (1 + path) * 12.011 + (4 + 2 * path) * 1.008
        WHEN 2 THEN 14.007 + (a + b + c) * 12.011 + (2 * (a + b + c) + 3) * 1.008
        WHEN 3 THEN 9 * 12.011 + 11 * 1.008 + 14.007 + 2 * 15.999 ELSE 18 * 12.011 + 20 * 1.008 + 2 * 14.007 + 15.999 END::DOUBLE, 3) AS mol_weight
    FROM m WHERE m IS NOT NULL""")
def descriptors_query(spark, sf):
    mols = fx.view(spark, sf, "fx_molecule")
    parsed = graph.parse_molecules(_distinct(mols)).where(slicing.reject_reason().isNull())
    atoms, bonds = F.col("graph.atoms"), F.col("graph.bonds")
    names = ("hac", "num_rings", "hba", "hbd", "rotatable_bonds")
    values = parsed.select("smiles", *[descriptors.span(n, atoms, bonds).cast("bigint").alias(n) for n in names],
                           F.round(descriptors.span("mol_weight", atoms, bonds), 3).alias("mol_weight"))
    return mols.join(values, "smiles").select("mol_id", *names, "mol_weight")


@query("clogp_sum", MOL + """SELECT mol_id, round(CASE kind WHEN 0 THEN 5 * 0.3 + 0.2 + (path - 1) * 0.5 + 0.6 WHEN 1 THEN 2 * 0.6 + (path - 1) * 0.5
    WHEN 2 THEN 3 * 0.6 + (a + b + c - 3) * 0.5 - 1.0 WHEN 3 THEN 2 * 0.6 + 0.1 - 0.8 + 4 * 0.3 + 2 * 0.2 - 2 * 0.7
    ELSE 10 * 0.3 + 2 * 0.2 + 0.1 - 0.7 - 2 * 1.0 + 5 * 0.5 END::DOUBLE, 6) AS clogp FROM m WHERE m IS NOT NULL""")
def clogp_sum(spark, sf):
    """A made-up contribution table: the real one is the caller's data."""
    table = {"cH1": 0.3, "cH0": 0.2, "CH3": 0.6, "CH2": 0.5, "CH0": 0.1, "NH0": -1.0, "NH1": -0.8, "OH0": -0.7}
    mols = fx.view(spark, sf, "fx_molecule")
    parsed = graph.parse_molecules(_distinct(mols)).where(slicing.reject_reason().isNull())
    value = descriptors.span("clogp", F.col("graph.atoms"), F.col("graph.bonds"), table=table)
    return mols.join(parsed.select("smiles", F.round(value, 6).alias("clogp")), "smiles").select("mol_id", "clogp")


@query("canonical_spellings", "WITH " + fx.sql("fx_assembly") + " SELECT smiles, CAST(1 AS BIGINT) AS n_forms FROM fx_assembly GROUP BY smiles")
def canonical_spellings(spark, sf):
    """Random spellings of a molecule all have the same canonical text."""
    spelled = randomize.randomized(_distinct(fx.view(spark, sf, "fx_assembly")), "smiles", 4, repeats=True, seed=1)
    keyed = spelled.withColumn("form", graph.canonical(F.col("randomized")))
    return keyed.groupBy("smiles").agg(F.countDistinct("form").alias("n_forms"))


@query("random_variants", "WITH " + fx.sql("fx_assembly") + """ SELECT smiles, CAST(4 AS BIGINT) AS n_variants, CAST(4 AS BIGINT) AS n_texts, true AS same FROM fx_assembly GROUP BY smiles""")
def random_variants(spark, sf):
    """Four distinct random spellings of every molecule, all of them that molecule."""
    mols = _distinct(fx.view(spark, sf, "fx_assembly"))
    rows = randomize.randomized(mols, "smiles", 4, attempts=200, seed=1)
    same = rows.withColumn("_a", graph.canonical(F.col("smiles"))).withColumn("_b", graph.canonical(F.col("randomized")))
    return same.groupBy("smiles").agg(F.count(F.lit(1)).alias("n_variants"), F.countDistinct("randomized").alias("n_texts"),
                                      F.bool_and(F.col("_a") == F.col("_b")).alias("same"))


# --- joins ---
# the decorations that fit anywhere
JOINED = """(VALUES ('[*]C', 1), ('[*]CC', 1), ('[*]c1ccccc1', 1), ('[*]OC', 1), ('[*]N(C)C', 1), ('[*]C(=O)O', 1), ('*Cl', 1)) v(decoration, core)"""


@query("graft_first", "WITH " + fx.sql("fx_pair") + f"""SELECT pair_id, core IS NOT NULL AND scaffold <> 'c1ccncc1' AS joined,
    CASE WHEN core IS NOT NULL AND scaffold <> 'c1ccncc1' THEN CASE WHEN scaffold LIKE '*%' THEN 0 WHEN scaffold LIKE '%*:2%' THEN 2 ELSE 1 END END AS open_points
    FROM fx_pair LEFT JOIN {JOINED} USING (decoration)""")
def graft_first(spark, sf):
    pairs = fx.view(spark, sf, "fx_pair")
    # equal pairs are joined once
    made = pairs.select("scaffold", "decoration").distinct().withColumn(
        "smiles", graph.graft_first(attach.remove_numbers(F.col("scaffold")), F.col("decoration")))
    return pairs.join(made, ["scaffold", "decoration"]).select(
        "pair_id", F.col("smiles").isNotNull().alias("joined"), attach.count_points(F.col("smiles")).alias("open_points"))


# --- fixed values: joined texts, checked by hand ---
GRAFTED = """(VALUES
    ('[*:0]c1ccccc1[*:1]', '[*]C', '[*]c1c(C)cccc1'),
    ('[*:0]c1ccccc1[*:1]', '[*]CC', '[*]c1c(CC)cccc1'),
    ('[*:0]c1ccccc1[*:1]', '[*]c1ccccc1', '[*]c1c(-c2ccccc2)cccc1'),
    ('[*:0]c1ccccc1[*:1]', '[*]OC', '[*]c1c(cccc1)OC'),
    ('[*:0]c1ccccc1[*:1]', '[*]N(C)C', '[*]c1c(cccc1)N(C)C'),
    ('[*:0]c1ccccc1[*:1]', '[*]C(=O)O', '[*]c1c(C(=O)O)cccc1'),
    ('[*:0]c1ccccc1[*:1]', '*Cl', '[*]c1c(cccc1)Cl'),
    ('[*:1]CCN1CCN([*:0])CC1', '[*]C', '[*]N1CCN(CCC)CC1'),
    ('[*:1]CCN1CCN([*:0])CC1', '[*]CC', '[*]N1CCN(CCCC)CC1'),
    ('[*:1]CCN1CCN([*:0])CC1', '[*]c1ccccc1', '[*]N1CCN(CCc2ccccc2)CC1'),
    ('[*:1]CCN1CCN([*:0])CC1', '[*]OC', '[*]N1CCN(CCOC)CC1'),
    ('[*:1]CCN1CCN([*:0])CC1', '[*]N(C)C', '[*]N1CCN(CCN(C)C)CC1'),
    ('[*:1]CCN1CCN([*:0])CC1', '[*]C(=O)O', '[*]N1CCN(CCC(=O)O)CC1'),
    ('[*:1]CCN1CCN([*:0])CC1', '*Cl', '[*]N1CCN(CCCl)CC1'),
    ('[*:0]C(=O)Nc1ccc([*:1])cc1[*:2]', '[*]C', '[*]c1c(ccc([*])c1)NC(C)=O'),
    ('[*:0]C(=O)Nc1ccc([*:1])cc1[*:2]', '[*]CC', '[*]c1c(ccc([*])c1)NC(CC)=O'),
    ('[*:0]C(=O)Nc1ccc([*:1])cc1[*:2]', '[*]c1ccccc1', '[*]c1c(ccc([*])c1)NC(c1ccccc1)=O'),
    ('[*:0]C(=O)Nc1ccc([*:1])cc1[*:2]', '[*]OC', '[*]c1c(ccc([*])c1)NC(=O)OC'),
    ('[*:0]C(=O)Nc1ccc([*:1])cc1[*:2]', '[*]N(C)C', '[*]c1c(ccc([*])c1)NC(N(C)C)=O'),
    ('[*:0]C(=O)Nc1ccc([*:1])cc1[*:2]', '[*]C(=O)O', '[*]c1c(ccc([*])c1)NC(C(=O)O)=O'),
    ('[*:0]C(=O)Nc1ccc([*:1])cc1[*:2]', '*Cl', '[*]c1c(ccc([*])c1)NC(Cl)=O'),
    ('[*:0]CCSC1CCN(Cc2ccoc2[*:1])C1', '[*]C', '[*]c1c(CN2CC(CC2)SCCC)cco1'),
    ('[*:0]CCSC1CCN(Cc2ccoc2[*:1])C1', '[*]CC', '[*]c1c(CN2CC(CC2)SCCCC)cco1'),
    ('[*:0]CCSC1CCN(Cc2ccoc2[*:1])C1', '[*]c1ccccc1', '[*]c1c(CN2CC(CC2)SCCc2ccccc2)cco1'),
    ('[*:0]CCSC1CCN(Cc2ccoc2[*:1])C1', '[*]OC', '[*]c1c(CN2CC(CC2)SCCOC)cco1'),
    ('[*:0]CCSC1CCN(Cc2ccoc2[*:1])C1', '[*]N(C)C', '[*]c1c(CN2CC(CC2)SCCN(C)C)cco1'),
    ('[*:0]CCSC1CCN(Cc2ccoc2[*:1])C1', '[*]C(=O)O', '[*]c1c(CN2CC(CC2)SCCC(=O)O)cco1'),
    ('[*:0]CCSC1CCN(Cc2ccoc2[*:1])C1', '*Cl', '[*]c1c(CN2CC(CC2)SCCCl)cco1'),
    ('*c1ccc(Br)cc1', '[*]C', 'Brc1ccc(C)cc1'),
    ('*c1ccc(Br)cc1', '[*]CC', 'Brc1ccc(CC)cc1'),
    ('*c1ccc(Br)cc1', '[*]c1ccccc1', 'Brc1ccc(-c2ccccc2)cc1'),
    ('*c1ccc(Br)cc1', '[*]OC', 'Brc1ccc(cc1)OC'),
    ('*c1ccc(Br)cc1', '[*]N(C)C', 'Brc1ccc(cc1)N(C)C'),
    ('*c1ccc(Br)cc1', '[*]C(=O)O', 'Brc1ccc(C(=O)O)cc1'),
    ('*c1ccc(Br)cc1', '*Cl', 'Brc1ccc(cc1)Cl')
    ) g(scaffold, decoration, smiles)"""


@query("graft_texts", "WITH " + fx.sql("fx_pair") + f"""
    SELECT scaffold, decoration, smiles, count(*) AS n FROM fx_pair LEFT JOIN {GRAFTED} USING (scaffold, decoration) GROUP BY ALL""")
def graft_texts(spark, sf):
    counted = fx.view(spark, sf, "fx_pair").groupBy("scaffold", "decoration").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("smiles", graph.graft_first(attach.remove_numbers(F.col("scaffold")), F.col("decoration")))


@query("graft_all", "WITH " + fx.sql("fx_pair") + f"""SELECT pair_id, core IS NOT NULL AND scaffold NOT LIKE '%*:2%' AND scaffold LIKE '%*:1%' AS joined
    FROM fx_pair LEFT JOIN {JOINED} USING (decoration)""")
def graft_all(spark, sf):
    pairs = fx.view(spark, sf, "fx_pair")
    packed = attach.pack_single(F.array("decoration", F.lit("[*]OC")))
    made = pairs.select("scaffold", "decoration").distinct().withColumn("smiles", graph.graft_packed(F.col("scaffold"), packed))
    rows = pairs.join(made, ["scaffold", "decoration"])
    return rows.select("pair_id", (F.col("smiles").isNotNull() & ~F.contains("smiles", F.lit("*"))).alias("joined"))


@query("graft_invalid", "WITH " + fx.sql("fx_pair") + f"""SELECT scaffold, decoration, count(*) AS n FROM fx_pair
    ANTI JOIN {JOINED} ON v.decoration = fx_pair.decoration GROUP BY scaffold, decoration""")
def graft_invalid(spark, sf):
    pairs = fx.view(spark, sf, "fx_pair").where(F.col("scaffold") != "")
    counted = pairs.groupBy("scaffold", "decoration").agg(F.count(F.lit(1)).alias("n"))
    probe = graph.graft_first(F.lit("[*]C"), F.col("decoration"))
    return counted.withColumn("_s", probe).where(F.col("_s").isNull()).drop("_s")


@query("graft_back", "WITH " + fx.sql("fx_assembly") + " SELECT DISTINCT true AS same FROM fx_assembly")
def graft_back(spark, sf):
    """Slicing and joining again gives the molecule back, for every slicing."""
    rows = slicing.slice_molecules(fx.view(spark, sf, "fx_assembly"), "recap", 2)
    numbered = F.transform("decorations", lambda d, i: attach.number_first(d, i))
    rows = rows.withColumn("again", graph.graft_numbered(F.col("scaffold"), numbered))
    return rows.select(F.col("again").eqNullSafe(F.col("smiles")).alias("same")).distinct()


# --- jobs ---

@query("training_pairs_multi", WORD_SLICINGS + """
    SELECT CAST(e AS INT) AS epoch, count(*) AS n_pairs, true AS one_point FROM s, range(0, 2) x(e) GROUP BY ALL""")
def training_pairs_multi(spark, sf):
    pairs = randomize.training_pairs(slice_table(fx.view(spark, sf, "fx_word"), "hr", 2), 2, "multi", 4)
    return pairs.groupBy("epoch").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.bool_and(attach.count_points(F.col("decoration")) == 1).alias("one_point"))


@query("training_pairs_single", WORD_SLICINGS + """
    SELECT CAST(cuts AS BIGINT) AS cuts, CAST(0 AS INT) AS epoch, count(*) AS n_pairs, count(*) AS n_whole FROM s GROUP BY cuts""")
def training_pairs_single(spark, sf):
    """Every packed pair joins to a molecule without open points."""
    pairs = randomize.training_pairs(slice_table(fx.view(spark, sf, "fx_word"), "hr", 2), 1, "single", 4)
    joined = pairs.withColumn("whole", graph.graft_packed(F.col("scaffold"), F.col("decoration")))
    return joined.groupBy("epoch", attach.count_points(F.col("scaffold")).cast("bigint").alias("cuts")).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("whole").isNotNull() & ~F.contains("whole", F.lit("*"))).alias("n_whole"))


@query("sliced_lines", """SELECT v.line FROM (VALUES (concat('[*:0]N1CCN([*:1])CC1', chr(9), '[*]C(c1ccccc1)=O;[*]Cc1ccccc1', chr(9), 'C(c1ccccc1)(N1CCN(Cc2ccccc2)CC1)=O'))) v(line)
    WHERE (SELECT count(*) FROM part) >= 7""")
def sliced_lines(spark, sf):
    """File lines of the two-cut slicings with a ring scaffold and ring decorations."""
    ring = {"num_rings": {"min": 1}}
    rows = slice_table(fx.view(spark, sf, "fx_molecule"), "recap", 4, ring, ring).where(F.col("cuts") == 2)
    return rows.select(writers.sliced_line().alias("line"))


def _grown(spark, sf, kind):
    """Decorate one two-point scaffold per part with a model fitted on fx_train."""
    train = fx.view(spark, sf, "fx_train").select("scaffold", "decoration")
    if kind == "single":
        train = train.withColumn("decoration", F.concat_ws("|", "decoration", F.lit("[*]C")))
    scaffolds = fx.view(spark, sf, "fx_open").select("smiles")
    rows = loop.decorate(scaffolds, tokenmodel.fit(train, alpha=0.001), kind, r=2, n=2, seed=11)
    return writers.results_csv(rows)


@query("decorate_multi")
def decorate_multi(spark, sf):
    return _grown(spark, sf, "multi")


@query("decorate_single")
def decorate_single(spark, sf):
    return _grown(spark, sf, "single")


# A model that has only ever seen a methyl closes one open end after the other.  A chain of ten atoms, its two
# points among them, has 18 spellings (one from each end, two from each atom between), half of which
# show either point first; as all of them are drawn, every count is known.  A chain is compared by its
# atoms from end to end, a point by its number, in the direction that sorts first.
_WORDS = "WITH " + fx.sql("fx_word") + """, s AS (SELECT smiles AS w, concat('[*:0]', smiles, '[*:1]') AS scaffold, count(*) AS n FROM fx_word GROUP BY smiles),
    rounds AS ({rounds}),
    least AS (SELECT least(chain, reverse(chain)) AS chain, scaffold, decorations, n, i FROM rounds)
    SELECT chain, min(struct_pack(i := i, s := scaffold, d := decorations)).s AS scaffold, min(struct_pack(i := i, s := scaffold, d := decorations)).d AS decorations,
           CAST(sum(n) AS BIGINT) AS "count" FROM least GROUP BY chain"""
_START = "SELECT concat('0', w, '1') AS chain, scaffold, '{}' AS decorations, n, 0 AS i FROM s"
_ONE = """ UNION ALL SELECT concat('C', w, '1'), scaffold, '{"0":"[*]C"}', 9, 1 FROM s UNION ALL SELECT concat('0', w, 'C'), scaffold, '{"1":"[*]C"}', 9, 1 FROM s"""
_BOTH = """ UNION ALL SELECT concat('C', w, 'C'), scaffold, '{"0":"[*]C","1":"[*]C"}', %d, 2 FROM s"""
ALL_SPELLINGS = 18


def _methyls(spark, sf, kind):
    """(results, counts of the rounds) of all open chains with methyls."""
    beside = spark.createDataFrame([("[*]" + a,) for a in "CNOS"] + [("C([*])C",)], "scaffold string")
    train = beside.withColumn("decoration", F.lit("[*]C" if kind == "multi" else "[*]C|[*]C"))
    chains = fx.view(spark, sf, "fx_word").select(F.concat(F.lit("[*:0]"), "smiles", F.lit("[*:1]")).alias("smiles"))
    return loop.decorate_counted(chains, tokenmodel.fit(train, 3, 1e-12), kind, r=ALL_SPELLINGS, n=1, order=3, seed=2)


def _end_to_end(smiles):
    """A chain written from its end; its text may start at an atom between, one side in brackets."""
    short = F.regexp_replace(smiles, r"\[\*:(\d)\]", "$1")
    side, first, rest = (F.regexp_extract(short, r"^(.)\((.*)\)(.*)$", i) for i in (2, 1, 3))
    whole = F.when(F.contains(short, F.lit("(")), F.concat(F.reverse(side), first, rest)).otherwise(short)
    return F.least(whole, F.reverse(whole))


def _chains(rows):
    flat = rows.withColumn("decorations", F.map_from_entries(F.array_sort(F.map_entries("decorations"))))
    return writers.results_csv(flat).select(_end_to_end(F.col("smiles")).alias("chain"), "scaffold", "decorations", "count")


@query("decorate_multi_chains", _WORDS.replace("{rounds}", _START + _ONE + _BOTH % 36))
def decorate_multi_chains(spark, sf):
    """Every row of the loop over several rounds, open molecules too."""
    return _chains(_methyls(spark, sf, "multi")[0])


@query("decorate_single_chains", _WORDS.replace("{rounds}", _START + _BOTH % 18))
def decorate_single_chains(spark, sf):
    """Every row of the loop that closes all points at once."""
    return _chains(_methyls(spark, sf, "single")[0])


@query("decorate_rounds", "WITH " + fx.sql("fx_word") + """, s AS (SELECT DISTINCT smiles AS w FROM fx_word),
    c AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT least(w, reverse(w)) FROM s)) AS n_both FROM s)
    SELECT 'multi' AS kind, 1 AS round, n AS n_open, 18 * n AS n_sampled, 18 * n AS n_joined, 2 * n AS n_molecules FROM c
    UNION ALL SELECT 'multi', 2, 2 * n, 36 * n, 36 * n, n_both FROM c
    UNION ALL SELECT 'single', 1, n, 18 * n, 18 * n, n_both FROM c""")
def decorate_rounds(spark, sf):
    """Rows that each round took, drew, joined and kept, counted by the jobs that wrote them."""
    rows = [(kind, i, c["n_open"], c["n_sampled"], c["n_joined"], c["n_molecules"])
            for kind in ("multi", "single") for i, c in enumerate(_methyls(spark, sf, kind)[1], 1)]
    return spark.createDataFrame(rows, "kind string, round int, n_open bigint, n_sampled bigint, n_joined bigint, n_molecules bigint")


# The earlier queries over the closed molecules alone.
METHYLS = "WITH " + fx.sql("fx_word") + """
    SELECT concat('[*:0]', min(smiles), '[*:1]') AS scaffold, '{"0":"[*]C","1":"[*]C"}' AS decorations
    FROM fx_word GROUP BY least(smiles, reverse(smiles))"""


@query("decorate_multi_closed", METHYLS)
def decorate_multi_closed(spark, sf):
    return decorate_multi_chains(spark, sf).where(~F.col("chain").rlike(r"\d")).select("scaffold", "decorations")


@query("decorate_single_closed", METHYLS)
def decorate_single_closed(spark, sf):
    return decorate_single_chains(spark, sf).where(~F.col("chain").rlike(r"\d")).select("scaffold", "decorations")


@query("decorate_scaffolds", "WITH " + fx.sql("fx_scaffold") + """SELECT scaffold AS smiles, scaffold, '{}' AS decorations, count(*) AS "count" FROM fx_scaffold GROUP BY scaffold""")
def decorate_scaffolds(spark, sf):
    """The starting scaffolds stay in the results with their own count."""
    rows = loop.initial_results(fx.view(spark, sf, "fx_scaffold").select(F.col("scaffold").alias("smiles")))
    return writers.results_csv(rows).select("smiles", "scaffold", "decorations", "count")
