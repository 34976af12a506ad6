"""Map-only steps in Python: Arrow batches in, the kept columns plus new ones out."""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of a batch whose values are Python objects at the same time.
ROWS = 2048


def named(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: list, *names: str) -> list:
    """The names, each with underscores put before it until no column of `taken` is called so (in any case of letters)."""
    known, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in known:
            name = "_" + name
        known.add(name.lower())
        out.append(name)
    return out


def kept_columns(df: DataFrame, new: list, keep: list = None) -> list:
    """The input columns that pass through; one named like a result column is replaced by it."""
    return [c for c in (df.columns if keep is None else keep) if c not in set(new)]


def add_columns(df: DataFrame, inputs: list, fields: list, start: Callable, keep: list = None) -> DataFrame:
    """Append columns that `start()` computes from the `inputs`, without a shuffle.

    fields: (name, type) of the new columns.  start() is called once in each task and returns
    step(*lists) -> one list for each field; lists hold the values of one batch.
    keep: names of the columns that pass through (default all).
    """
    names = [n for n, _ in fields]
    keep = kept_columns(df, names, keep)
    taken = list(dict.fromkeys([*keep, *inputs]))
    # numbered inside, so that columns may have any names
    source = df.select(*[named(c).alias(f"c{i}") for i, c in enumerate(taken)])
    number = {c: f"c{i}" for i, c in enumerate(taken)}
    schema = T.StructType([source.schema[number[c]] for c in keep] + [T.StructField(f"n{i}", T._parse_datatype_string(t)) for i, (_, t) in enumerate(fields)])
    width = len(keep)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        step = start()
        kinds = [to_arrow_type(f.dataType) for f in schema.fields[width:]]
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            at = {n: i for i, n in enumerate(batch.schema.names)}
            new = step(*[batch.column(at[number[c]]).to_pylist() for c in inputs])
            yield pa.RecordBatch.from_arrays([batch.column(at[number[c]]) for c in keep]
                                             + [pa.array(v, type=k) for v, k in zip(new, kinds)], schema.fieldNames())

    return source.mapInArrow(run, schema).toDF(*keep, *names)
