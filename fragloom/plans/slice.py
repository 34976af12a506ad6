"""Molecule table -> distinct slicings."""

from pyspark.sql import DataFrame

from ..operators import slicing


def slice_table(molecules: DataFrame, rule_set="hr", max_cuts: int = 4, scaffold_conditions=None,
                decoration_conditions=None, contributions=None, column: str = "smiles",
                partitions: int = None) -> DataFrame:
    """(scaffold, decorations, cuts, smiles): every slicing with 1..max_cuts cuts, once."""
    rows = slicing.slice_molecules(
        molecules, rule_set, max_cuts, scaffold_conditions, decoration_conditions, contributions, column, partitions)
    return slicing.distinct_slicings(rows)
