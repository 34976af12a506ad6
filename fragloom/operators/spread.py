"""Partition counts for stages whose rows are small but costly."""

from pyspark.sql import DataFrame

TASKS_PER_CORE = 3


def spread(df: DataFrame, *keys: str, partitions: int = None) -> DataFrame:
    """Hash rows over a fixed number of tasks; without keys, deal them out in turn.

    Adaptive execution merges small partitions by their bytes; a few megabytes of molecule
    text are minutes of graph work, so these stages name their number of partitions: some
    per core, and on a cluster, where executors may come later, at least the session's
    shuffle partitions.
    """
    spark = df.sparkSession
    if partitions is None:
        partitions = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
        if not spark.sparkContext.master.startswith("local"):
            partitions = max(partitions, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(partitions, *keys)
