"""Encoded training data: shuffled, batched and padded per epoch."""

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import draws
from .ranking import ranked

#: Rows of whole batches for a task, and how many times as many it may get before its keys are too hot for that.
TASK_ROWS, HOT = 1 << 18, 4
#: Integer types, narrowest first, and their bits.
INTEGERS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def in_vocabulary(encoded: DataFrame, columns: list) -> DataFrame:
    """Rows whose sequences could all be encoded."""
    for c in columns:
        encoded = encoded.where(F.col(c).isNotNull())
    return encoded


def narrowed(encoded: DataFrame, columns: list, widest: int) -> DataFrame:
    """Id arrays in the narrowest integers that hold -widest .. widest; `pad` makes them bigint again."""
    kind = next(k for k, bits in INTEGERS.items() if widest < 1 << (bits - 1))
    return encoded.withColumns({c: F.col(c).cast(f"array<{kind}>") for c in columns})


def batches(df: DataFrame, key: str, epochs: int, batch_size: int, seed: int = 0, drop_last: bool = True, rows: int = None) -> DataFrame:
    """Add (epoch, batch) after a seeded shuffle of the rows of every epoch.  The input is read once.

    With the number of `rows`, which need not be exact, a written table is read twice instead and nothing
    is written: the result then has a column `_task`, and the rows of a batch lie in one task.  Where few
    keys have most rows it has none, and all is as without `rows`.
    """
    spread = df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    if rows and (whole := _whole_batches(spread, key, epochs, batch_size, seed, drop_last, rows)) is not None:
        return whole
    shuffled = F.unhex(draws.hash_hex(seed, key, "epoch"))  # half the bytes of the digits, in the same order
    placed = ranked(spread, ["epoch"], [shuffled, key], "_r").withColumn("batch", F.floor((F.col("_r") - 1) / batch_size))
    if drop_last:
        n = placed.where(F.col("epoch") == 1).agg(F.floor(F.max("_r") / batch_size).alias("_full"))
        placed = placed.join(F.broadcast(n), F.col("batch") < F.col("_full")).drop("_full")
    return placed.drop("_r")


def _whole_batches(spread: DataFrame, key: str, epochs: int, batch_size: int, seed: int, drop_last: bool, rows: int):
    """`batches` in one shuffle of the rows as they are, or None where the digests of the keys lie too unevenly.

    Every epoch is cut into slices of the digests, a task each.  The rows of every slice are counted first, so
    a task knows the place of its first row.  The head of a slice also goes to the task before, which so has the
    rest of its last batch; the task after leaves that batch out.  Rows of one key are told apart by a number
    that rows of a head carry, so both tasks see them in one order.
    """
    most = max(TASK_ROWS, 32 * batch_size)
    at_once = min(spread.sparkSession.sparkContext.defaultParallelism, rows // (32 * batch_size)) // epochs
    slices = max(ceil(rows / most), at_once, 1)
    heads = max(rows // slices // (8 * batch_size), 1)  # a slice has so many parts, and its head is the first
    digest = draws.hash_hex(seed, key, "epoch")
    part = F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") * F.lit(slices * heads), 32)
    parts = spread.withColumn("_part", part).withColumn("_slice", F.floor(F.col("_part") / heads))
    in_head = F.col("_part") % heads == 0
    seen = {(r["epoch"], r["_slice"]): (r["n"], r["n_head"]) for r in parts.groupBy("epoch", "_slice").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(in_head).alias("n_head")).collect()}
    if any(n > HOT * most for n, _ in seen.values()):
        return None
    bounds = []  # of every task: the place of its first row, and of the first row of its batches and behind them
    for epoch in range(1, epochs + 1):
        first, total = 0, sum(n for (e, _), (n, _) in seen.items() if e == epoch)
        end = total // batch_size * batch_size if drop_last else total
        for i in range(slices):
            behind = first + seen.get((epoch, i), (0, 0))[0]
            start, stop = (min(ceil(place / batch_size) * batch_size, end) for place in (first, behind))
            if stop - behind > seen.get((epoch, i + 1), (0, 0))[1]:
                return None
            bounds.append((first, start, end if i + 1 == slices else stop))
            first = behind
    task = ((F.col("epoch") - 1) * slices + F.col("_slice")).cast("int")
    tasks = F.when(in_head & (F.col("_slice") > 0), F.array(task, task - 1)).otherwise(F.array(task))
    dealt = (parts.withColumn("_tie", F.when(in_head, F.monotonically_increasing_id())).withColumn("_task", F.explode(tasks))
             .drop("epoch", "_part", "_slice").repartitionById(epochs * slices, F.col("_task"))
             .withColumn("epoch", F.floor(F.col("_task") / slices).cast("int") + 1))
    in_order = dealt.withColumn("_order", F.unhex(digest)).sortWithinPartitions("_order", key, "_tie")
    first, start, end = (F.get(F.split(F.lit(",".join(map(str, b))), ",").cast("array<bigint>"), F.col("_task")) for b in zip(*bounds))
    # the row's number in its partition is in the lower 33 bits
    placed = in_order.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = placed.withColumn("_place", F.col("_place") + first).where((F.col("_place") >= start) & (F.col("_place") < end))
    return placed.select(*spread.columns, F.floor(F.col("_place") / batch_size).alias("batch"), "_task")


def n_batches(batched: DataFrame) -> DataFrame:
    return batched.groupBy("epoch").agg(F.countDistinct("batch").alias("n_batches"))


def pad(batched: DataFrame, columns: list) -> DataFrame:
    """Right-pad id arrays with 0 to the longest of their batch, as bigint; adds `<column>_len`."""
    together = [c for c in ("_task",) if c in batched.columns]  # with it, rows of a batch need no shuffle to meet
    per_batch = Window.partitionBy(*together, "epoch", "batch")
    batched = batched.withColumns({f"{c}_len": F.size(c) for c in columns})
    batched = batched.withColumns({f"_max_{c}": F.max(f"{c}_len").over(per_batch) for c in columns})
    for c in columns:
        gap = F.array_repeat(F.lit(0).cast("bigint"), F.col(f"_max_{c}") - F.col(f"{c}_len"))
        batched = batched.withColumn(c, F.concat(F.col(c).cast("array<bigint>"), gap)).drop(f"_max_{c}")
    return batched.drop(*together)


def assign_sets(epochs: DataFrame, sets: DataFrame) -> DataFrame:
    """Join every epoch with its training set: numbered sets take turns."""
    n = sets.agg(F.max("set_no").alias("_n"))
    turn = epochs.crossJoin(F.broadcast(n)).withColumn("set_no", F.pmod(F.col("epoch") - 1, F.col("_n") + 1)).drop("_n")
    return turn.join(sets, "set_no")
