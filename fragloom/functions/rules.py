"""Cut rules as Column predicates over a bond and the atoms at its two ends.

A rule is a function (bond, a, b) -> Column.  It is tried in both orientations and
only on non-ring bonds.  Pass your own dict of rules to use other cuts.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _single(bond):
    return bond["ord"] == "-"


def _is(atom, elem, aromatic=False):
    return (atom["elem"] == elem) & (atom["aromatic"] == F.lit(aromatic))


def _acyl(atom):
    return _is(atom, "C") & (atom["dbl_o"] > 0)


def _three_connected_carbon(atom):
    return _is(atom, "C") & (atom["degree"] + atom["n_h"] == 3)


HR = {"single": lambda bond, a, b: _single(bond)}

# The ether rule's usual exclusion can never match an oxygen, so it cuts every C-O bond.
RECAP = {
    "amide": lambda bond, a, b: _single(bond) & _acyl(a) & _is(b, "N"),
    "ester": lambda bond, a, b: _single(bond) & _acyl(a) & _is(b, "O"),
    "amine": lambda bond, a, b: _single(bond) & _is(a, "C") & _is(b, "N") & ~b["next_acyl"],
    "ether": lambda bond, a, b: _single(bond) & _is(a, "C") & _is(b, "O"),
    "olefin": lambda bond, a, b: (bond["ord"] == "=") & _three_connected_carbon(a) & _three_connected_carbon(b),
    "quaternary_nitrogen": lambda bond, a, b: _single(bond)
    & _is(a, "N") & (a["charge"] == 1) & (a["degree"] + a["n_h"] == 4) & _is(b, "C"),
    "aromatic_nitrogen": lambda bond, a, b: _single(bond) & _is(a, "N", True) & _is(b, "C"),
    "lactam_nitrogen": lambda bond, a, b: _single(bond)
    & _is(a, "N") & a["in_ring"] & a["next_ring_acyl"] & _is(b, "C"),
    "biaryl": lambda bond, a, b: _single(bond) & _is(a, "C", True) & _is(b, "C", True),
    "sulphonamide": lambda bond, a, b: _single(bond) & _is(a, "N") & _is(b, "S") & (b["dbl_o"] >= 2),
}

RULE_SETS = {"hr": HR, "recap": RECAP}


def resolve(rules) -> dict:
    """A rule set by name, or the dict of rules itself."""
    if isinstance(rules, str):
        if rules not in RULE_SETS:
            raise ValueError(f"unknown rule set '{rules}'")
        return RULE_SETS[rules]
    return rules


def matches(rules: dict, bond, a, b) -> Column:
    """OR over the rules, either orientation."""
    hit = F.lit(False)
    for rule in rules.values():
        hit = hit | rule(bond, a, b) | rule(bond, b, a)
    return hit
