"""Exhaustive decoration: sample, join, dedup, and go on with what is still open."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import attach
from ..operators import graph, merge, randomize, tokenmodel
from ..operators.lineage import delete_path, materialise, measured, new_path, remove
from ..operators.spread import spread


# Distinct samples of one molecule that may be joined in the same task.
ROWS_IN_ONE_TASK = 4096


def initial_results(scaffolds: DataFrame, column: str = "smiles") -> DataFrame:
    """The scaffolds themselves as results, repeats counted."""
    empty = F.create_map().cast("map<int,string>")
    return (scaffolds.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("smiles"))
            .agg(F.count(F.lit(1)).alias("count"))
            .select("smiles", F.col("smiles").alias("scaffold"), empty.alias("decorations"), "count"))


def _variants(open_rows: DataFrame, r: int, attempts: int, repeats: bool, seed: int) -> DataFrame:
    """Random spellings with their point numbers; every spelling gets a task slot of its own."""
    spelled = randomize.randomized(spread(open_rows), "smiles", r, attempts, repeats, seed, "_spelled")
    rows = spelled.select(
        F.col("smiles"), F.col("scaffold").alias("origin"), "decorations", "variant_no",
        attach.points(F.col("_spelled")).alias("points"), attach.remove_numbers(F.col("_spelled")).alias("scaffold"))
    # rows without a numbered point cannot take a decoration
    return spread(rows.where(F.size("points") > 0), "smiles", "variant_no")


def _by_molecule(counted: DataFrame, rows_per_molecule: int, *rest: str) -> DataFrame:
    """Spread join work so that a molecule is read once, unless it has too many rows for one task."""
    keys = ["smiles"] if rows_per_molecule <= ROWS_IN_ONE_TASK else ["smiles", *rest]
    return spread(counted, *keys).sortWithinPartitions("smiles")


def _round_multi(sampled: DataFrame, rows_per_molecule: int) -> DataFrame:
    """Join at the first point.  Equal samples are counted before they are joined."""
    counted = sampled.groupBy(
        "smiles", "origin", "decorations", F.get("points", F.lit(0)).alias("point"), "decoration").agg(
        F.count(F.lit(1)).alias("n"))
    counted = _by_molecule(counted, rows_per_molecule, "point", "decoration")
    joined = counted.withColumn(
        "_new", graph.graft(F.col("smiles"), attach.number_first(F.col("decoration"), F.col("point"))))
    joined = joined.where(F.col("_new").isNotNull()).withColumn("_clean", graph.clean_decoration(F.col("decoration")))
    return joined.select(
        F.col("_new").alias("smiles"), F.col("origin").alias("scaffold"),
        attach.add_entry(F.col("decorations"), F.col("point"), F.col("_clean")).alias("decorations"), "n")


def _round_single(sampled: DataFrame, rows_per_molecule: int) -> DataFrame:
    """Join all points at once, numbered by appearance in the random spelling."""
    parts = attach.unpack_single(F.col("decoration"))
    entries = F.array_sort(F.transform(
        F.col("points"), lambda p, i: F.struct(p.alias("point"), F.get(parts, i).alias("text"))))
    fitting = sampled.where(F.size(parts) == attach.count_points(F.col("scaffold")))
    counted = fitting.groupBy("smiles", "origin", entries.alias("entries")).agg(F.count(F.lit(1)).alias("n"))
    counted = _by_molecule(counted, rows_per_molecule, "entries")
    texts = F.transform("entries", lambda e: attach.number_first(e["text"], e["point"]))
    joined = counted.withColumn("_new", graph.graft_numbered(F.col("smiles"), texts)).where(F.col("_new").isNotNull())
    joined = joined.withColumn("_clean", graph.clean_all(F.transform("entries", lambda e: e["text"])))
    numbers = F.transform("entries", lambda e: e["point"])
    return joined.select(F.col("_new").alias("smiles"), F.col("origin").alias("scaffold"),
                         F.map_from_arrays(numbers, F.col("_clean")).alias("decorations"), "n")


class Seen:
    """Counted molecules of all rounds so far: one table in buckets of the molecule, a folder a round.

    A round is written in the buckets that its dedup has made.  The search for molecules not seen
    before joins buckets with buckets: no round is shuffled again, however many there are.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.rounds = spark, 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = new_path(spark, "seen")
        self.name = f"seen_{self.path.rsplit('-', 1)[-1]}"

    def add(self, rows: DataFrame) -> dict:
        """Append a round of (smiles, scaffold, decorations, n); returns its row counts."""
        seen = Observation()
        counted = merge.dedup(rows.repartition(self.buckets, "smiles"), F.col("n")).withColumn("round", F.lit(self.rounds))
        counted = counted.observe(seen, F.count(F.lit(1)).alias("n_molecules"), F.coalesce(F.sum("count"), F.lit(0)).alias("n_joined"),
                                  F.coalesce(F.max(attach.count_points(F.col("smiles"))), F.lit(0)).alias("most_points"))
        (counted.write.bucketBy(self.buckets, "smiles").sortBy("smiles").partitionBy("round").format("parquet").mode("append")
         .option("path", self.path).saveAsTable(self.name))
        self.rounds += 1
        return seen.get

    def frontier(self) -> DataFrame:
        """Open molecules of the last round that no earlier round has."""
        table = self.spark.table(self.name)
        last = self.rounds - 1
        return merge.frontier(table.where(F.col("round") == last), table.where(F.col("round") < last))

    def merged(self) -> DataFrame:
        """All rounds as one bag; the earliest gives the representative."""
        return merge.merge_marked(self.spark.table(self.name).withColumnRenamed("round", "_i"))

    def remove(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_path(self.spark, self.path)


def decorate_counted(scaffolds: DataFrame, model: DataFrame, kind: str = "multi", r: int = 32, n: int = 32,
                     max_randomized: int = 10000, repeats: bool = False, order: int = 2, max_len: int = 256,
                     seed: int = 0, column: str = "smiles") -> tuple:
    """(results, rounds): what `decorate` returns, and the row counts of every round.

    rounds: one dict a round with n_open (molecules that go into it), n_sampled (rows drawn for them),
    n_joined (of these, joined to a molecule) and n_molecules (different ones).  The jobs that
    write the tables count them; nothing is read again for it.
    """
    if kind not in ("multi", "single"):
        raise ValueError(f"unknown kind '{kind}'")
    seen, rounds = Seen(scaffolds.sparkSession), []
    start = seen.add(initial_results(scaffolds, column).withColumnRenamed("count", "n"))
    limit = start["most_points"] if kind == "multi" else min(start["most_points"], 1)
    draw = tokenmodel.Sampler(model, order, max_len) if limit else None
    for i in range(limit):
        open_rows, counts = measured(seen.frontier(), n_open=F.count(F.lit(1)))
        if not counts["n_open"]:
            remove(open_rows)
            break
        variants = _variants(open_rows, r, max_randomized, repeats, seed + i)
        sampled, drawn = measured(draw(tokenmodel.draw_rows(variants, n, seed + i, ["smiles", "variant_no"])), n_sampled=F.count(F.lit(1)))
        made = seen.add((_round_multi if kind == "multi" else _round_single)(sampled, r * n))
        rounds.append({**counts, **drawn, "n_joined": made["n_joined"], "n_molecules": made["n_molecules"]})
        remove(open_rows, sampled)
    results = materialise(seen.merged())
    seen.remove()
    if draw:
        draw.remove()
    return results, rounds


def decorate(scaffolds: DataFrame, model: DataFrame, *args, **options) -> DataFrame:
    """(smiles, scaffold, decorations, count): the scaffolds and all molecules grown from them.

    Options as of `decorate_counted`.  multi: one point per round until nothing new is open.  single:
    all points in one round.  Every join closes one point and adds none, so the rounds are bounded
    by the largest number of points; each round is written once and read by the next.
    """
    return decorate_counted(scaffolds, model, *args, **options)[0]
