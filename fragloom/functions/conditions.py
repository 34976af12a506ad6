"""Descriptor conditions compiled to predicates: inclusive min/max, or an exact value."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import descriptors


def names(conditions) -> list:
    """Descriptor names used, checked."""
    used = sorted(conditions or {})
    for name in used:
        if name not in descriptors.NAMES:
            raise ValueError(f"unknown descriptor '{name}'")
    return used


def predicate(conditions, value) -> Column:
    """AND of all conditions; `value(name)` gives the descriptor column. None accepts all."""
    parts = [F.lit(True)]
    for name, wanted in (conditions or {}).items():
        if isinstance(wanted, dict):
            if "min" in wanted:
                parts.append(value(name) >= F.lit(float(wanted["min"])))
            if "max" in wanted:
                parts.append(value(name) <= F.lit(float(wanted["max"])))
        else:
            parts.append(value(name) == F.lit(float(wanted)))
    return reduce(lambda a, b: a & b, parts)
