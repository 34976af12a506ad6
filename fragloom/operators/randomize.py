"""Random spellings of scaffolds, and training pairs made from them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import attach
from . import graph
from .lineage import materialise
from .lookup import lookup
from .spread import spread


def _seed(seed, *parts) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def randomized(df: DataFrame, column: str, count: int, attempts: int = 10000, repeats: bool = False,
               seed: int = 0, name: str = "randomized") -> DataFrame:
    """One row per random spelling of `column`: at most `count`, distinct unless `repeats`.

    `variant_no` numbers the spellings of one text, and `n_found` is how many it has: less than `count`
    where `attempts` draws found no more.  Unreadable texts give no row.
    """
    variants = graph.random_variants(
        F.col(column), _seed(seed, F.col(column)), F.lit(count), F.lit(attempts), F.lit(repeats))
    return (df.withColumn("_variants", variants)
            .select(*[c for c in df.columns if c != "n_found"], F.size("_variants").alias("n_found"),
                    F.posexplode_outer("_variants").alias("variant_no", name))
            .where(F.col(name).isNotNull()))


def training_pairs(sliced: DataFrame, epochs: int = 1, kind: str = "multi", seed: int = 0) -> DataFrame:
    """(epoch, scaffold, decoration) with a fresh spelling of both sides per epoch.

    multi: the decoration of the first point in the random scaffold text.
    single: the decorations of all points by appearance, packed with `|`.
    """
    if kind not in ("multi", "single"):
        raise ValueError(f"unknown kind '{kind}'")
    rows = spread(sliced.select("scaffold", "decorations"))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    key = (F.col("epoch"), F.col("scaffold"), F.col("decorations"))
    rows = rows.withColumn("_spelled", F.get(graph.respell(F.array("scaffold"), _seed(seed, *key)), F.lit(0)))
    order = attach.points(F.col("_spelled"))
    wanted = F.slice(order, 1, 1) if kind == "multi" else order
    rows = rows.withColumn("_chosen", F.transform(wanted, lambda p: F.get(F.col("decorations"), p)))
    rows = rows.withColumn("_texts", graph.respell(F.col("_chosen"), _seed(seed + 1, *key)))
    return rows.where(F.size("_texts") > 0).select(
        "epoch", attach.remove_numbers(F.col("_spelled")).alias("scaffold"),
        attach.remove_numbers(attach.pack_single(F.col("_texts"))).alias("decoration"))


def rejects(sliced: DataFrame) -> DataFrame:
    """The slicings of which `training_pairs` makes no pair of every point, each with its reason.

    Each different slicing is read once; the rows look their reason up, with frequent slicings set apart.
    """
    slicing = F.struct("scaffold", "decorations").alias("_slicing")  # as a struct its NULL parts are equal
    points = attach.points(F.col("scaffold"))
    different = sliced.groupBy(slicing).agg(F.count(F.lit(1)).alias("_uses")).select("_slicing", "_slicing.*", "_uses")
    parsed = graph.parse_molecules(spread(different), "scaffold").drop("graph")
    parsed = parsed.withColumn("_clean", graph.clean_all(F.col("decorations")))
    found = (F.when(F.col("reason").isNotNull(), F.lit("unreadable_scaffold"))
             .when(F.size(points) == 0, F.lit("no_numbered_point"))
             .when(F.exists(points, lambda p: F.get(F.col("decorations"), p).isNull()), F.lit("point_without_decoration"))
             .when(F.col("_clean").isNull() | F.exists("_clean", lambda t: t.isNull()), F.lit("unreadable_decoration")))
    reasons = parsed.select("_slicing", "_uses", found.alias("reason")).where(F.col("reason").isNotNull())
    found_rows = lookup(sliced.withColumn("_slicing", slicing), materialise(reasons), ["_slicing"], "_uses")
    return found_rows.where(F.col("reason").isNotNull()).drop("_slicing")
