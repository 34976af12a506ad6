"""Text and table outputs, all written by the tasks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import attach


def tab_line(*columns) -> Column:
    """Fields joined by TAB; a NULL field is an empty one, so later fields keep their places."""
    return F.concat_ws("\t", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns])


def sliced_line() -> Column:
    return tab_line("scaffold", attach.pack_list(F.col("decorations")), "smiles")


def scored_line(columns: list) -> Column:
    """Input fields and the score with 8 decimals; a row without a score has an empty last field."""
    return tab_line(*columns, F.when(F.col("nll").isNotNull(), F.format_string("%.8f", F.col("nll"))))


def results_csv(df: DataFrame) -> DataFrame:
    """Results with the decorations map as JSON text, for formats without maps."""
    return df.withColumn("decorations", F.to_json("decorations"))


def _text(df: DataFrame, path: str, gzip: bool = False):
    df.write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)


def write_sliced(df: DataFrame, parquet_path: str = None, text_path: str = None):
    if parquet_path:
        df.write.mode("overwrite").parquet(parquet_path)
    if text_path:
        _text(df.select(sliced_line().alias("value")), text_path)


def write_training_sets(pairs: DataFrame, path: str):
    """One folder per epoch, all epochs in one job."""
    lines = pairs.select("epoch", tab_line("scaffold", "decoration").alias("value"))
    lines.write.mode("overwrite").partitionBy("epoch").text(path)


def write_results(df: DataFrame, path: str, fmt: str = "parquet"):
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif fmt == "csv":
        results_csv(df).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown output format '{fmt}'")


def write_scored(df: DataFrame, path: str, columns: list, gzip: bool = False):
    _text(df.select(scored_line(columns).alias("value")), path, gzip)


def write_metrics(df: DataFrame, path: str, by: str = "epoch"):
    """Add the rows of some epochs to a folder; an epoch written again replaces its rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
