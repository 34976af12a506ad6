"""The smaller jobs: training sets, vocabularies, scores, samples."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dataset, randomize, tokenmodel, vocab
from ..operators.lineage import measured
from ..sources import readers, writers


def training_sets(spark, sliced_path: str, output: str, num_files: int = 1, kind: str = "multi", seed: int = 0):
    """Slicings -> one folder of random training pairs per epoch."""
    sliced = readers.read_sliced(spark, sliced_path)
    writers.write_training_sets(randomize.training_pairs(sliced, num_files, kind, seed), output)


def vocabularies(pairs: DataFrame) -> DataFrame:
    """(side, token, id) of both columns of a training table."""
    return vocab.build(pairs, {"scaffold": "scaffold", "decoration": "decoration"})


def epoch_batches(pairs: DataFrame, vocabulary: DataFrame, epochs: int, batch_size: int, key: str, seed: int = 0) -> DataFrame:
    """Encoded, shuffled, batched and padded pairs per epoch; pairs with unknown tokens left out.

    Encoded rows are written once: numbering reads them several times.  From there on ids travel as
    the narrowest integers that hold them all, in one shuffle of the rows.
    """
    ids = vocab.encode(pairs.select(key, "scaffold", "decoration"), vocabulary, {"scaffold": "scaffold", "decoration": "decoration"})
    columns = ["scaffold_ids", "decoration_ids"]
    widest = F.max(F.greatest(*[extreme for c in columns for extreme in (F.array_max(c), -F.array_min(c))]))
    ids, seen = measured(dataset.in_vocabulary(ids, columns).select(key, *columns), {"compression": "zstd"}, n=F.count(F.lit(1)), widest=widest)
    narrow = dataset.narrowed(ids, columns, seen["widest"] or 0)
    return dataset.pad(dataset.batches(narrow, key, epochs, batch_size, seed, rows=seen["n"]), columns)


def nlls(spark, pairs_path: str, model: DataFrame, output: str, order: int = 2, gzip: bool = False):
    """Append the score to every input line; further fields stay as they are."""
    scored = tokenmodel.score(readers.read_pairs(spark, pairs_path), model, order)
    # further fields are there or not, each with its TAB
    whole = F.concat("decoration", F.when(F.col("rest") != "", F.concat(F.lit("\t"), "rest")).otherwise(F.lit("")))
    writers.write_scored(scored.withColumn("_fields", whole), output, ["scaffold", "_fields"], gzip)


def samples(spark, scaffolds_path: str, model: DataFrame, output: str, with_nll: bool = False, gzip: bool = False,
            order: int = 2, seed: int = 0):
    """One sampled decoration per scaffold line, with its score when wanted."""
    scaffolds = readers.read_smiles(spark, scaffolds_path).withColumnRenamed("smiles", "scaffold")
    # equal scaffold lines are numbered so that each gets its own draw
    counted = scaffolds.groupBy("scaffold").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")
    drawn = tokenmodel.sample(counted, model, 1, order, seed=seed, key=["scaffold", "copy"])
    if with_nll:
        writers.write_scored(drawn, output, ["scaffold", "decoration"], gzip)
    else:
        line = writers.tab_line("scaffold", "decoration").alias("value")
        drawn.select(line).write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(output)
