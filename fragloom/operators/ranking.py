"""Global and per-group row numbers without a single-task sort."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import materialise, measured

#: Runs of which every task may have the whole table; beyond, it is joined as any other.
BROADCAST_RUNS = 100_000


def ranked(df: DataFrame, by: list, order: list, name: str) -> DataFrame:
    """`name` = 1-based position within `by`, ordered by `order`; equal rows in the order they come.

    `order` holds names of columns, or Columns of which only the order is wanted: those are not written.
    Rows are dealt out by ranges of (by, order), sorted in their partitions and written once with
    their place.  Only the sizes of (group, partition) runs are counted and summed up, as many as
    there are partitions and groups; a row's position is its place, shifted by the runs of its group
    in earlier partitions.  Any group or equal key may hold most rows: ranges end inside it.
    """
    made = {f"_order{i}": c for i, c in enumerate(order) if not isinstance(c, str)}
    place = df.withColumns({**made, "_tie": F.monotonically_increasing_id()})
    keys = [*by, *[c if isinstance(c, str) else f"_order{i}" for i, c in enumerate(order)], "_tie"]
    sorted_rows = place.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie", *made)
    # the place of a row in the whole order: its partition in the upper bits, its row in the lower 33
    rows = materialise(sorted_rows.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).alias("_part")
    runs = rows.groupBy(*by, part).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_part",
                         (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    shifts, seen = measured(shifts, n=F.count(F.lit(1)))
    if seen["n"] <= BROADCAST_RUNS:  # so the rows are not shuffled again
        shifts = F.broadcast(shifts)
    same = F.shiftright(F.col("_place"), 33) == F.col("_part")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return (rows.join(shifts, same).withColumn(name, F.col("_place") + F.col("_shift"))
            .drop("_place", "_part", "_shift", *[f"_by{i}" for i in range(len(by))]))
