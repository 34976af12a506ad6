"""Cut enumeration: molecules -> (scaffold, decorations).

A cut bond is a bridge, so it has two sides.  A k-slicing is a choice of k oriented
cuts on distinct bonds whose removed sides are pairwise disjoint; the scaffold is what
stays.  Atoms are numbered depth-first, so the far side of a bridge is the interval
v..last and every disjointness test is a comparison of two intervals.

Choices grow one cut per level inside generator steps, without a join.  Texts are parsed and
rejects dropped before anything is multiplied; a molecule with many cuts is then split into
work units that share out its first two cuts, so that no task has to enumerate it alone.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import attach, conditions, descriptors
from . import graph
from .spread import spread

#: Pairs of first and second cuts that one work unit tries.
PAIRS_PER_UNIT = 2000


def distinct_texts(df: DataFrame, column: str = "smiles", partitions: int = None) -> DataFrame:
    """Distinct texts, spread over the tasks; copies are merged before they are shuffled."""
    text = df.select(F.col(column).alias("smiles")).where(F.col("smiles").isNotNull())
    return spread(text.distinct(), "smiles", partitions=partitions)


def work_units(df: DataFrame, max_cuts: int, pairs: int = None, partitions: int = None) -> DataFrame:
    """Rows with `cuts` -> the same rows for each range of first cuts, and for each part of the second cuts
    where one first cut has too many; so a row has fewer copies than pairs of cuts.

    Adds first_lo, first_n, second_of, second_k.  Rows without cuts are left out.
    """
    pairs = pairs or PAIRS_PER_UNIT
    df = df.where(F.size("cuts") > 0)
    n = F.size("cuts").cast("bigint")
    if max_cuts == 1:
        return df.withColumns({"first_lo": F.lit(0), "first_n": n.cast("int"), "second_of": F.lit(1), "second_k": F.lit(0)})
    width = F.greatest(F.floor(F.lit(pairs) / n), F.lit(1)).cast("bigint")
    parts = F.ceil(n / F.lit(pairs)).cast("bigint")
    units = df.withColumn("_unit", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(n / width) * parts - 1)))
    units = units.withColumns({"first_lo": (F.floor(F.col("_unit") / parts) * width).cast("int"), "first_n": width.cast("int"),
                               "second_of": parts.cast("int"), "second_k": (F.col("_unit") % parts).cast("int")})
    return spread(units.drop("_unit"), "smiles", "first_lo", "second_k", partitions=partitions)


def reject_reason(contributions=None) -> Column:
    """Why a parsed row cannot be sliced, NULL when it can; contributions: the table of a clogp condition."""
    return (F.when(F.col("reason").isNotNull(), F.col("reason"))
            .when(F.col("graph.components") > 1, F.lit("multi_component"))
            .when(F.exists(F.col("graph.atoms"), lambda a: a["elem"] == "*"), F.lit("attachment_point"))
            .otherwise(descriptors.unknown_reason(F.col("graph.atoms"), contributions)))


def rejects(df: DataFrame, column: str = "smiles", contributions=None) -> DataFrame:
    """Rows that slicing leaves out, each with its reason."""
    return (graph.parse_molecules(df, column).withColumn("reason", reject_reason(contributions))
            .where(F.col("reason").isNotNull()).drop("graph"))


def with_cuts(df: DataFrame, rule_set, scaffold_conditions=None, decoration_conditions=None, table=None) -> DataFrame:
    """Parsed rows -> `cuts`: oriented cuts that pass the decoration conditions.

    The conditions act here, before any combination exists; `whole` keeps the molecule's
    own descriptors for the scaffold conditions.
    """
    names = sorted({*conditions.names(scaffold_conditions), *conditions.names(decoration_conditions)})
    df = graph.with_cut_sites(df, rule_set).where(F.size("sites") > 0)
    atoms, bonds = F.col("graph.atoms"), F.col("graph.bonds")
    if names:
        def far_side(site):
            part = [descriptors.span(n, atoms, bonds, site["v"], site["last"], table).alias(n) for n in names]
            return F.struct(F.struct(*part).alias("far"), F.struct(
                *[descriptors.cut_bond(n, atoms, site).alias(n) for n in names]).alias("lost"))

        df = (df.withColumn("whole", F.struct(*[descriptors.span(n, atoms, bonds, table=table).alias(n) for n in names]))
              .withColumn("parts", F.transform("sites", far_side)))

    def oriented(site, i):
        def side(near):
            fields = [site["idx"].alias("bond"), site["v"].alias("v"), site["last"].alias("last"), F.lit(near).alias("near")]
            if names:
                part = F.get(F.col("parts"), i)
                rest = F.struct(*[(F.col("whole")[n] - part["far"][n] - part["lost"][n]).alias(n) for n in names])
                fields += [(rest if near else part["far"]).alias("part"), part["lost"].alias("lost")]
            return F.struct(*fields)

        return F.array(side(False), side(True))

    cuts = F.flatten(F.transform("sites", oriented))
    if decoration_conditions:
        cuts = F.filter(cuts, lambda c: conditions.predicate(decoration_conditions, lambda n: c["part"][n]))
    return df.select("smiles", cuts.alias("cuts"), *(["whole"] if names else []))


def disjoint(p, d) -> Column:
    """Do two oriented cuts remove disjoint atom sets?"""
    return (F.when(~p["near"] & ~d["near"], (p["last"] < d["v"]) | (d["last"] < p["v"]))
            .when(~p["near"] & d["near"], (d["v"] <= p["v"]) & (p["last"] <= d["last"]))
            .when(p["near"] & ~d["near"], (p["v"] <= d["v"]) & (d["last"] <= p["last"]))
            .otherwise(F.lit(False)))


#: Descriptors that only fall with every further cut, so that a scaffold below its least can be left at once.
FALLING = ("hac", "mol_weight")


def enumerate_cuts(df: DataFrame, max_cuts: int, scaffold_conditions=None) -> DataFrame:
    """All choices of 1..max_cuts disjoint cuts of the work units, one row each in `picks`.

    Every level either stops a choice (an option without a cut) or extends it by a cut on
    a later bond.  Outer generators keep the optimizer from evaluating the options a
    second time in an inferred filter; the rows they add for empty options are dropped.
    """
    cut_type = df.schema["cuts"].dataType.elementType
    stop = F.array(F.struct(F.lit(None).cast(cut_type).alias("cut")))
    none = F.slice(stop, 1, 0)

    def left(name):
        gone = F.aggregate("picks", F.lit(0.0), lambda s, p: s + p["part"][name] + p["lost"][name])
        return F.col("whole")[name] - gone

    early = {n: {"min": w["min"] if isinstance(w, dict) else w} for n, w in (scaffold_conditions or {}).items()
             if n in FALLING and (not isinstance(w, dict) or "min" in w)}
    rows = (df.withColumn("_first", F.explode_outer(F.slice("cuts", F.col("first_lo") + 1, F.col("first_n"))))
            .where(F.col("_first").isNotNull()).withColumn("picks", F.array("_first")))
    if early:
        rows = rows.where(conditions.predicate(early, left))
    stop_here = F.col("second_k") == 0
    for level in range(2, max_cuts + 1):
        def extends(d, i):
            later = d["bond"] > F.element_at("picks", -1)["bond"]
            mine = (i % F.col("second_of") == F.col("second_k")) if level == 2 else F.lit(True)
            return mine & later & F.forall("picks", lambda p: disjoint(p, d))

        open_row = F.size("picks") == level - 1
        grown = F.transform(F.filter("cuts", extends), lambda c: F.struct(c.alias("cut")))
        options = F.concat(
            F.when(stop_here, stop).otherwise(none) if level == 2 else stop,
            F.when(open_row, grown).otherwise(none))
        rows = (rows.withColumn("_next", F.explode_outer(options)).where(F.col("_next").isNotNull())
                .withColumn("picks", F.when(F.col("_next.cut").isNull(), F.col("picks"))
                            .otherwise(F.concat("picks", F.array("_next.cut")))).drop("_next"))
        if early:
            rows = rows.where(conditions.predicate(early, left))
    if scaffold_conditions:
        rows = rows.where(conditions.predicate(scaffold_conditions, left))
    return rows.select("smiles", "picks")


def slice_molecules(df: DataFrame, rule_set="hr", max_cuts: int = 4, scaffold_conditions=None,
                    decoration_conditions=None, contributions=None, column: str = "smiles",
                    partitions: int = None) -> DataFrame:
    """All slicings before dedup: (smiles canonical, scaffold, decorations, cuts)."""
    parsed = graph.parse_molecules(distinct_texts(df, column, partitions)).where(reject_reason(contributions).isNull())
    cuts = with_cuts(parsed, rule_set, scaffold_conditions, decoration_conditions, contributions)
    picks = enumerate_cuts(work_units(cuts, max_cuts, partitions=partitions), max_cuts, scaffold_conditions)

    def field(name):
        return F.transform("picks", lambda p: p[name])

    return (picks.withColumn("_s", graph.scaffold_of(F.col("smiles"), field("bond"), field("near")))
            .select(attach.number_all(F.col("_s.scaffold")).alias("scaffold"), "_s.decorations",
                    F.size("_s.decorations").alias("cuts"), "_s.smiles"))


def distinct_slicings(slicings: DataFrame) -> DataFrame:
    """One row per (scaffold, decorations) with the smallest source text."""
    return (slicings.groupBy("scaffold", "decorations").agg(F.min("smiles").alias("smiles"))
            .select("scaffold", "decorations", F.size("decorations").alias("cuts"), "smiles"))
