"""Quality statistics of a model per epoch."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..functions import draws
from ..operators import graph, stats, tokenmodel
from ..operators.lineage import materialise
from ..operators.ranking import ranked


def _scored_groups(training, validation, model, sample_size, kind, order, seed, key):
    """Rows (grp, nll, smiles) of the four groups, from samples of both sets."""
    join = graph.graft_first if kind == "multi" else graph.graft_packed
    groups, draw = [], tokenmodel.Sampler(model, order)
    unlike = [k for k in key if k != "decoration"]
    for name, table in (("training", training), ("validation", validation)):
        rows = materialise(stats.sample_rows(table, sample_size, key, seed))
        observed = tokenmodel.score(rows, model, order).withColumn("grp", F.lit(name))
        drawn = draw(tokenmodel.draw_rows(rows.select(*dict.fromkeys([*unlike, "scaffold"])), 1, seed, unlike))
        drawn = drawn.withColumn("smiles", join(F.col("scaffold"), F.col("decoration"))).withColumn("grp", F.lit("sampled_" + name))
        empty = F.lit(None).cast("string").alias("smiles")
        place = draws.hash_hex(seed, *unlike).alias("place")
        groups += [observed.select("grp", "nll", empty, place), drawn.select("grp", "nll", "smiles", place)]
    table = materialise(reduce(lambda a, b: a.unionByName(b), groups))
    draw.remove()
    return table


GROUPS = ["training", "sampled_training", "validation", "sampled_validation"]


def collect(training: DataFrame, validation: DataFrame, model: DataFrame, sample_size: int = 5000, epoch: int = 0,
            kind: str = "multi", order: int = 2, seed: int = 0, key: list = ("key",), other_values: dict = None) -> tuple:
    """(metrics, histograms): (epoch, metric, value) and (epoch, metric, bin, n, p).

    `key` names columns that identify a row of both sets.  All numbers come from one grouped
    aggregate over the scored rows (`stats.one_pass`), which is written once.
    """
    sample_size = max(sample_size, 1)
    rows = _scored_groups(training, validation, model, sample_size, kind, order, seed, list(key))
    placed = ranked(rows.where(F.col("nll").isNotNull()), ["grp"], ["place"], "pos")
    table = stats.one_pass(placed, GROUPS)
    of_group = table.where("part = 'group'")
    first = stats.filled(table.where("part = 'first_bin' AND first_bin IS NOT NULL").select("grp", F.when(F.col("first_bin") >= 0, F.col("first_bin")).alias("bin"), "n"))
    shown = table.where("part = 'pos' AND pos IS NOT NULL").select("pos", F.explode("shown").alias("grp", "p")).where("p IS NOT NULL")
    parts = [
        of_group.select(F.concat(F.lit("nll/avg."), "grp").alias("metric"), F.col("mean_nll").alias("value")),
        of_group.select(F.concat(F.lit("nll/var."), "grp").alias("metric"), F.col("var_nll").alias("value")),
        of_group.where(F.col("grp").startswith("sampled_")).select(
            F.concat(F.lit("valid_"), F.expr("substring(grp, 9)")).alias("metric"), (F.lit(100.0) * F.col("n_valid") / F.lit(sample_size)).alias("value")),
        stats.divergence(first, "bin").select(F.lit("nll_plot/jsd_joined_bins").alias("metric"), F.col("jsd").alias("value")),
        stats.divergence(shown, "pos").select(F.lit("nll_plot/jsd_joined_no_bins").alias("metric"), F.col("jsd").alias("value")),
    ]
    for name, value in (other_values or {}).items():
        parts.append(table.sparkSession.range(1).select(F.lit(name).alias("metric"), F.lit(float(value)).alias("value")))
    metrics = reduce(lambda a, b: a.unionByName(b), parts).select(F.lit(epoch).alias("epoch"), "metric", "value")
    histograms = stats.filled(table.where("part = 'bin'").select("grp", "bin", "n")).select(
        F.lit(epoch).alias("epoch"), F.concat(F.lit("nll_plot/"), "grp").alias("metric"), "bin", "n", "p")
    return metrics, histograms


def scheduled(epochs: DataFrame, frequency: int) -> DataFrame:
    """Epochs whose statistics are wanted."""
    return epochs.where((F.lit(frequency) > 0) & (F.col("epoch") % F.lit(max(frequency, 1)) == 0))
