"""Hard negatives of anchor vectors by slot-decomposed selection.

The upper score limits of an anchor's positives cut the scores into disjoint slots.  Every cell of
(rows, anchors) keeps the best few rows of each slot, and so does each merge of cells; the rows under
one positive's limit are then the slots from its own downwards, so a merge of those few rows answers all
positives, though their windows overlap.  Every row is scored against every anchor, exactly.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import materialise
from .rows import named

#: Rows and anchors of one cell at most (on average, as rows are hashed), and rows of one cell before cells are split for parallelism.
ROWS, ANCHORS, FEW = 1 << 15, 1 << 15, 1 << 10
#: Scores held at a time in a task.
CHUNK = 1 << 20
_LOWEST = -(1 << 63) + 1


def mine(df: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5,
         k: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors: condition on the columns of `df`; NULL is no.  Components become floor(scale * x), scores
    are integer inner products.  Positives: the first `positives` other rows of the anchor's label.
    Negatives of a positive: the first `k` rows of other labels with low * positive <= 100 * score
    <= high * positive.  Higher scores come first, equal ones by smaller key, NULL keys last.

    Rows with a NULL label or vector or a NULL or non-finite component take no part.  A vector that is
    shorter than another counts as filled up with zeros; an empty one scores 0.  Rows are rows: one
    that repeats another's key or all of it is another row, and an anchor twice gives its rows twice.
    Scores beyond 64 bits are cut to the largest long.  Other columns are ignored.  An empty table,
    or one without anchors, gives no rows.
    """
    rows = _prepared(df, anchors, key, vector, label, scale)
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("a")).first()
    spark = df.sparkSession
    lanes = max(-(-sizes["n"] // ROWS), min(-(-sizes["n"] // FEW), 3 * spark.sparkContext.defaultParallelism), 1)
    grid = (lanes, max(-(-sizes["a"] // ANCHORS), 1))
    own = rows.where("anchor").select("row", "label", "v")
    better = [F.desc("score"), F.asc_nulls_last("id"), F.asc("other")]

    near = _cells(rows, own, grid, lambda a, r, s: [(0, positives, (a["label"][:, None] == r["label"]) & (a["row"][:, None] != r["row"]))], [])
    by_score = Window.partitionBy("anchor").orderBy(*better)
    near = near.withColumn("place", F.row_number().over(by_score) - 1).where(F.col("place") < positives)
    exact = F.col("score").cast("decimal(38,0)")
    wide = near.where("score >= 0").select("anchor", F.col("place").alias("slot"), F.col("id").alias("positive_id"),
                                           F.col("score").alias("positive_score"), F.floor(exact * high / 100).cast("bigint").alias("upper"),
                                           F.ceil(exact * low / 100).cast("bigint").alias("lower"))
    wide = materialise(wide)

    limits = wide.groupBy("anchor").agg(F.sort_array(F.collect_list("upper"), asc=False).alias("uppers"), F.min("lower").alias("least"))
    wanting = own.join(limits, own["row"] == limits["anchor"]).drop("anchor")
    kept = _cells(rows, wanting, grid, lambda a, r, s: _slots(a, r, s, positives, k), ["uppers", "least"])
    in_slot = Window.partitionBy("anchor", "slot").orderBy(*better)
    kept = kept.withColumn("place", F.row_number().over(in_slot)).where(F.col("place") <= k).drop("place")

    merged = wide.join(kept.withColumnRenamed("slot", "below"), "anchor").where(F.col("below") >= F.col("slot"))
    in_window = Window.partitionBy("anchor", "slot").orderBy(*better)
    merged = merged.withColumn("rank", F.row_number().over(in_window)).where((F.col("rank") <= k) & (F.col("score") >= F.col("lower")))
    # an anchor's key was left out of the cells, as they know it by its row number
    ids = rows.where("anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return merged.join(ids, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                                             F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _prepared(df: DataFrame, anchors: Column, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(row, id, label, anchor, v) of the rows that take part, written once; `row` numbers them."""
    whole = df.select(named(key).alias("id"), named(label).cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
                      named(vector).cast("array<double>").alias("v")).where("label IS NOT NULL AND v IS NOT NULL")
    broken = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # scaled as doubles: floor() of a double would be a long
    down = F.transform("v", lambda x: F.rint(x * scale) - F.when(F.rint(x * scale) > x * scale, 1.0).otherwise(0.0))
    return materialise(whole.where(~broken).withColumn("v", down).withColumn("row", F.monotonically_increasing_id()))


def _cells(rows: DataFrame, anchors: DataFrame, grid: tuple, groups, extra: list) -> DataFrame:
    """(anchor, slot, other, id, score): in every cell, the best rows of each group of each anchor.

    grid: numbers of lanes of rows and of anchors; a cell holds one lane of each.  groups(a, r, scores)
    -> [(slot, how many, mask of anchors by rows)].
    """
    lanes, blocks = grid
    cells = lanes * blocks
    tasks = min(cells, 1 << 14)
    lane, block = F.pmod(F.xxhash64("row"), F.lit(lanes)), F.pmod(F.xxhash64("row"), F.lit(blocks))
    left = rows.withColumn("cell", F.explode(F.sequence(lane * blocks, lane * blocks + (blocks - 1)))).drop("anchor")
    right = anchors.withColumn("cell", F.explode(F.sequence(block, block + (lanes - 1) * blocks, F.lit(blocks).cast("bigint"))))
    # both sides stem from one table: names of their own keep their columns apart
    right = right.withColumnsRenamed({c: f"a_{c}" for c in anchors.columns})

    def best(_, r, a):
        if not (r.num_rows and a.num_rows):  # one side has no row in this cell
            return pa.table({n: pa.array([], t) for n, t in kinds.items()})
        r, a = _arrays(r, ["row", "label", "id", "v"]), _arrays(a, ["row", "label", "v", *extra], "a_")
        order = np.lexsort((r["row"], r["id"], r["none"]))  # the last key counts first
        r = {name: values[order] for name, values in r.items()}
        found = [[] for _ in range(5)]
        step = max(CHUNK // max(len(r["row"]), 1), 1)
        for start in range(0, len(a["row"]), step):
            part = {name: values[start:start + step] for name, values in a.items()}
            scores = _products(part["v"], r["v"])
            for slot, k, valid in groups(part, r, scores):
                at, pos = _top(scores, valid, k)
                for into, values in zip(found, (part["row"][at], np.full(len(at), slot), r["row"][pos], pos, scores[at, pos])):
                    into.append(values)
        anchor, slot, other, pos, score = (np.concatenate([np.empty(0, np.int64), *f]).astype(np.int64) for f in found)
        ids = pa.array(r["id"][pos], pa.int64(), mask=r["none"][pos])
        return pa.table([pa.array(anchor), pa.array(slot, pa.int32()), pa.array(other), ids, pa.array(score)], names=list(kinds))

    kinds = {"anchor": pa.int64(), "slot": pa.int32(), "other": pa.int64(), "id": pa.int64(), "score": pa.int64()}
    dealt = left.repartition(tasks, "cell").groupBy("cell").cogroup(right.repartition(tasks, "cell").groupBy("cell"))
    return dealt.applyInArrow(best, "anchor long, slot int, other long, id long, score long")


def _arrays(table: pa.Table, names: list, prefix: str = "") -> dict:
    """Columns as arrays: vectors as one matrix, filled up with zeros, `none` marks NULL ids."""
    out = {}
    for name in names:
        column = table.column(prefix + name).combine_chunks()
        if name in ("v", "uppers"):
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            out[name] = np.zeros((len(sizes), max(sizes, default=0)), np.float64 if name == "v" else np.int64)
            if name == "uppers":
                out[name] += _LOWEST
            out[name][np.arange(out[name].shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        elif name == "label":
            out[name] = np.array(column.to_pylist(), dtype=object)
        else:
            out[name] = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if name == "id":
                out["none"] = column.is_null().to_numpy(zero_copy_only=False)
    return out


def _products(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact inner products as longs; Python integers where doubles would not hold every sum."""
    width = min(a.shape[1], r.shape[1])
    a, r = a[:, :width], r[:, :width]
    largest = (np.abs(a).max(initial=0) if a.size else 0) * (np.abs(r).max(initial=0) if r.size else 0) * max(width, 1)
    if largest < 2 ** 53:
        return (a @ r.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(r).T, _LOWEST, -_LOWEST).astype(np.int64)


def _slots(a: dict, r: dict, scores: np.ndarray, n: int, k: int) -> list:
    """The rows of other labels in each slot: at most this upper limit, above the next one."""
    able = (a["label"][:, None] != r["label"]) & (scores >= a["least"][:, None])
    uppers = a["uppers"]
    out = []
    for i in range(min(n, uppers.shape[1])):
        within = able & (scores <= uppers[:, i, None])
        out.append((i, k, within & (scores > uppers[:, i + 1, None]) if i + 1 < uppers.shape[1] else within))
    return out


def _top(scores: np.ndarray, valid: np.ndarray, k: int) -> tuple:
    """(anchor, place) of the first k valid rows of every anchor; equal scores in the order of places."""
    take = valid
    if scores.shape[1] > k:
        shown = np.where(valid, scores, _LOWEST)
        take = valid & (shown >= np.partition(shown, -k, axis=1)[:, -k, None])
    at, pos = np.nonzero(take)
    order = np.lexsort((pos, -scores[at, pos], at))
    at, pos = at[order], pos[order]
    first = np.searchsorted(at, at)
    keep = np.arange(len(at)) - first < k
    return at[keep], pos[keep]
