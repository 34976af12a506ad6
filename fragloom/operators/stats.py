"""Distribution statistics over scored groups (grp, nll)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from .lineage import materialise
from .ranking import ranked

BINS = 1000


def sample_rows(df: DataFrame, n: int, key: list, seed: int = 0) -> DataFrame:
    """n rows without replacement in seeded order; fewer rows than n is an error."""
    if df.limit(n).count() < n:
        raise ValueError(f"cannot sample {n} rows from fewer")
    return df.withColumn("_h", draws.hash_hex(seed, *key)).orderBy("_h", *key).limit(n).drop("_h")


def moments(df: DataFrame) -> DataFrame:
    """Mean and population variance per group."""
    return df.groupBy("grp").agg(F.avg("nll").alias("mean_nll"), F.var_pop("nll").alias("var_nll"))


def bin_index(x: Column) -> Column:
    """Bin of [0, 100] in 1000 steps of 0.1, the last one closed on the right."""
    guess = F.least(F.floor(x * 10.0).cast("int"), F.lit(BINS - 1))
    return (F.when(x < guess.cast("double") * F.lit(0.1), guess - 1)
            .when((x >= (guess + 1).cast("double") * F.lit(0.1)) & (guess != BINS - 1), guess + 1).otherwise(guess))


def histogram(df: DataFrame) -> DataFrame:
    """(grp, bin, n, p): values outside [0, 100] dropped, empty bins counted as 1, normalised."""
    return filled(df.groupBy("grp", bin_within(F.col("nll")).alias("bin")).agg(F.count(F.lit(1)).alias("n")))


def bin_within(x: Column) -> Column:
    return F.when((x >= 0) & (x <= 100), bin_index(x))


def filled(counted: DataFrame) -> DataFrame:
    """The histogram of (grp, bin, n) counts; values outside have a NULL bin."""
    binned = counted.where(F.col("bin").isNotNull())
    grid = counted.select("grp").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    full = grid.join(binned, ["grp", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    return full.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("grp")))


def truncated(df: DataFrame, order: list) -> DataFrame:
    """The first rows of every group in `order`, as many as the shortest group has; adds `pos`.

    The input is read once: group sizes are counted from the numbered rows.
    """
    placed = ranked(df, ["grp"], order, "pos")
    sizes = placed.groupBy("grp").agg(F.max("pos").alias("_n")).agg(F.min("_n").alias("_min"))
    return placed.join(F.broadcast(sizes), F.col("pos") <= F.col("_min")).drop("_min")


def divergence(dist: DataFrame, at: str) -> DataFrame:
    """Jensen-Shannon divergence of (grp, at, p): mean KL of every group to their average.

    Each group is normalised, and so is the average, before the logarithms.
    """
    # one aggregate by place carries every group's share of it; groups are few, so a place's list is short
    places = dist.groupBy(at).agg(F.collect_list(F.struct("grp", "p")).alias("_l"), F.sum("p").alias("_q"))
    rows = places.select("_q", F.inline("_l"))
    norm = rows.groupBy("grp").agg(F.sum("p").alias("_s"))
    rows = rows.join(F.broadcast(norm), "grp").crossJoin(F.broadcast(norm.agg(F.count(F.lit(1)).alias("_g"), F.sum("_s").alias("_all"))))
    share = F.col("p") / F.col("_s")
    average = F.col("_q") / F.col("_all")
    term = F.when(share > 0, share * F.log(share / average)).otherwise(0.0)
    return rows.agg((F.sum(term) / F.max("_g")).alias("jsd"))


def jsd_binned(first_rows: DataFrame) -> DataFrame:
    """Divergence of the binned scores of `truncated` groups."""
    return divergence(histogram(first_rows), "bin")


def jsd_raw(first_rows: DataFrame) -> DataFrame:
    """Divergence of the scores themselves, compared position by position."""
    return divergence(first_rows.withColumn("p", F.col("nll")), "pos")


def one_pass(scored: DataFrame, groups: list) -> DataFrame:
    """Everything that the statistics of (grp, nll, smiles, pos) rows need, from one grouped aggregate.

    Grouping sets, told apart by `part`: 'group' (n, mean, variance, readable molecules), 'bin' and
    'first_bin' (n of all rows and of the first rows, as many of each group as the shortest has),
    'pos' (`shown`: the score of each group at a position of the first rows).  Written once.
    """
    sizes = scored.groupBy("grp").agg(F.max("pos").alias("_n")).agg(F.min("_n").alias("_least"))
    first = F.col("pos") <= F.col("_least")
    rows = scored.crossJoin(F.broadcast(sizes)).select(
        "grp", "nll", "smiles", bin_within(F.col("nll")).alias("bin"), F.when(first, F.coalesce(bin_within(F.col("nll")), F.lit(-1))).alias("first_bin"),
        F.when(first, F.col("pos")).alias("pos"))
    grp, bin_, first_bin, pos = keys = [F.col(c) for c in ("grp", "bin", "first_bin", "pos")]
    shown = F.map_from_arrays(F.array(*[F.lit(g) for g in groups]), F.array(*[F.max(F.when((grp == g) & pos.isNotNull(), F.col("nll"))) for g in groups]))
    # one bit a key, set where the key is summed over
    names = {0b0111: "group", 0b0011: "bin", 0b0101: "first_bin", 0b1110: "pos"}
    part = F.element_at(F.create_map(*[F.lit(x) for bits, name in names.items() for x in (bits, name)]), F.grouping_id(*keys).cast("int"))
    return materialise(rows.groupingSets([[grp], [grp, bin_], [grp, first_bin], [pos]], *keys).agg(
        part.alias("part"), F.count(F.lit(1)).alias("n"), F.avg("nll").alias("mean_nll"), F.var_pop("nll").alias("var_nll"),
        F.count("smiles").alias("n_valid"), shown.alias("shown")))


def validity(df: DataFrame, sample_size: int, column: str = "smiles") -> DataFrame:
    """Percentage of readable molecules per group against the wanted sample size."""
    return df.groupBy("grp").agg(
        (F.lit(100.0) * F.count_if(F.col(column).isNotNull()) / F.lit(sample_size)).alias("valid_percent"),
        F.count(F.lit(1)).alias("n_scored"))
