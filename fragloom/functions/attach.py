"""Attachment-point algebra on text columns (built-in string functions only)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: text patterns of attachment points and the packing separators ---
NUMBERED = r"\[\*:(\d+)\]"
POINT = r"(?:\*|\[\*[^\]]*\])"
BARE = r"(?<!\[)\*"
FIRST_POINT = r"(?s)^(.*?)(?:\*|\[\*[^\]]*\])"
SINGLE_SEPARATOR = "|"
SINGLE_SPLIT = "[|]"
LIST_SEPARATOR = ";"


def remove_numbers(smi: Column) -> Column:
    """`[*:3]` becomes `[*]`."""
    return F.regexp_replace(smi, NUMBERED, "[*]")


def number_all(smi: Column) -> Column:
    """Number every point from 0 in order of appearance, whatever its form."""
    parts = F.split(smi, POINT, -1)
    numbered = F.transform(
        parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("[*:"), (i - 1).cast("string"), F.lit("]"), p))
    )
    return F.array_join(numbered, "")


def add_brackets(smi: Column) -> Column:
    """A bare `*` becomes `[*]`."""
    return F.regexp_replace(smi, BARE, "[*]")


def number_first(smi: Column, number) -> Column:
    """Set the number of the first point only."""
    number = number if isinstance(number, Column) else F.lit(number)
    return F.regexp_replace(smi, F.lit(FIRST_POINT), F.concat(F.lit("$1[*:"), number.cast("string"), F.lit("]")))


def points(smi: Column) -> Column:
    """Point numbers by appearance."""
    return F.regexp_extract_all(smi, F.lit(NUMBERED), F.lit(1)).cast("array<int>")


def first_point(smi: Column) -> Column:
    """Number of the first numbered point, NULL when there is none."""
    return F.get(points(smi), F.lit(0))


def count_points(smi: Column) -> Column:
    return F.regexp_count(smi, F.lit(POINT))


def pack_list(decorations: Column) -> Column:
    return F.array_join(decorations, LIST_SEPARATOR)


def unpack_list(text: Column) -> Column:
    return F.split(text, LIST_SEPARATOR, -1)


def pack_single(decorations: Column) -> Column:
    return F.array_join(decorations, SINGLE_SEPARATOR)


def unpack_single(text: Column) -> Column:
    return F.split(text, SINGLE_SPLIT, -1)


def arity_matches(scaffold: Column, packed: Column) -> Column:
    """As many packed decorations as points in the scaffold."""
    return F.size(unpack_single(packed)) == count_points(scaffold)


def number_packed(packed: Column) -> Column:
    """Packed decorations to an array whose i-th text carries number i on its first point."""
    return F.transform(unpack_single(packed), lambda d, i: number_first(d, i))


def zip_map(keys: Column, values: Column) -> Column:
    """Map from two arrays, stopping at the shorter one."""
    n = F.least(F.size(keys), F.size(values))
    return F.map_from_arrays(F.slice(keys, 1, n), F.slice(values, 1, n))


def map_by_number(decorations: Column) -> Column:
    """Map from an array of numbered decorations: their first numbers to their bare texts.

    A decoration without a number has no key and is left out; `unnumbered` lists those.
    """
    numbered = F.filter(decorations, lambda d: first_point(d).isNotNull())
    return F.map_from_arrays(F.transform(numbered, first_point), F.transform(numbered, remove_numbers))


def unnumbered(decorations: Column) -> Column:
    """The decorations that `map_by_number` leaves out."""
    return F.filter(decorations, lambda d: first_point(d).isNull())


def add_entry(decorations: Column, key: Column, value: Column) -> Column:
    """Map with one more entry; an existing entry of that key gives way."""
    kept = F.map_filter(decorations, lambda k, _: k != key)
    return F.map_concat(F.create_map(key, value), kept)


def values_by_point(decorations: Column) -> Column:
    """Map values in ascending point order."""
    return F.transform(F.array_sort(F.map_entries(decorations)), lambda e: e["value"])


def rekey(decorations: Column, remap: Column) -> Column:
    """Replace every point number by its image in the `remap` map."""
    return F.transform_keys(decorations, lambda k, _: F.element_at(remap, k))


def merge_labels(labels: Column, number: Column) -> Column:
    """Distinct labels in text order after adding one more."""
    return F.array_sort(F.array_distinct(F.concat(labels, F.array(number.cast("string")))))
