"""Counted dedup of decorated molecules."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank(*first) -> Column:
    """Total order of representatives: iteration if given, scaffold, decorations by point."""
    return F.struct(*first, F.col("scaffold"), F.array_sort(F.map_entries("decorations")).alias("_d"))


def dedup(df: DataFrame, count: Column = None) -> DataFrame:
    """One row per molecule with its occurrences and the lowest-ranked representative."""
    n = F.count(F.lit(1)) if count is None else F.sum(count)
    best = F.min_by(F.struct("scaffold", "decorations"), rank())
    return df.groupBy("smiles").agg(best.alias("_b"), n.alias("count")).select(
        "smiles", "_b.scaffold", "_b.decorations", "count")


def merge(rounds: list) -> DataFrame:
    """Bag union of counted rounds; the earliest round gives the representative."""
    return merge_marked(reduce(lambda a, b: a.unionByName(b), [df.withColumn("_i", F.lit(i)) for i, df in enumerate(rounds)]))


def merge_marked(rows: DataFrame) -> DataFrame:
    """As `merge`, of the rounds in one table, `_i` being the number of a row's round."""
    best = F.min_by(F.struct("scaffold", "decorations"), rank(F.col("_i")))
    return rows.groupBy("smiles").agg(best.alias("_b"), F.sum("count").alias("count")).select(
        "smiles", "_b.scaffold", "_b.decorations", "count")


def frontier(fresh: DataFrame, seen: DataFrame) -> DataFrame:
    """Molecules not seen before that still have an open attachment point."""
    return (fresh.where(F.contains("smiles", F.lit("*")))
            .join(seen.select("smiles"), "smiles", "left_anti").select("smiles", "scaffold", "decorations"))
