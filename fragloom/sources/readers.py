"""Text and table inputs."""

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import materialise
from ..operators.ranking import ranked


def fields(line: Column, num_fields: int = 0) -> Column:
    """TAB fields of a line, its trailing white space dropped; the first n when given."""
    parts = F.split(F.regexp_replace(line, r"\s+$", ""), "\t", -1)
    return F.slice(parts, 1, num_fields) if num_fields > 0 else parts


def keep_filled(line: Column) -> Column:
    return F.length(F.trim(F.regexp_replace(line, r"\s+", " "))) > 0


def read_rows(spark: SparkSession, path: str, ignore_invalid: bool = True, num: int = -1, num_fields: int = 0) -> DataFrame:
    """`fields` per line of a (possibly .gz) text; blank lines dropped unless kept as NULL."""
    lines = spark.read.text(path)
    if num >= 0:
        lines = lines.limit(num)
    filled = keep_filled(F.col("value"))
    if ignore_invalid:
        lines = lines.where(filled)
    return lines.select(F.when(filled, fields(F.col("value"), num_fields)).alias("fields"))


def read_smiles(spark: SparkSession, path: str, ignore_invalid: bool = True, num: int = -1) -> DataFrame:
    """First field of every line as `smiles`."""
    return read_rows(spark, path, ignore_invalid, num, 1).select(F.get("fields", F.lit(0)).alias("smiles"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(scaffold, decoration, rest) rows; further fields stay in `rest`."""
    f = F.col("fields")
    return read_rows(spark, path).select(
        F.get(f, F.lit(0)).alias("scaffold"), F.get(f, F.lit(1)).alias("decoration"),
        F.array_join(F.slice(f, 3, 1 << 20), "\t").alias("rest"))


def read_sliced(spark: SparkSession, path: str) -> DataFrame:
    """Three-field slicings: scaffold, `;`-packed decorations, source molecule."""
    f = F.col("fields")
    return read_rows(spark, path).select(
        F.get(f, F.lit(0)).alias("scaffold"), F.split(F.get(f, F.lit(1)), ";", -1).alias("decorations"),
        F.get(f, F.lit(2)).alias("smiles"))


def read_conditions(spark: SparkSession, path: str) -> tuple:
    """(scaffold conditions, decoration conditions) of one small JSON settings file."""
    data = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    return data.get("scaffold"), data.get("decoration")


def read_training_sets(spark: SparkSession, folder: str) -> DataFrame:
    """(set_no, scaffold, decoration): files of a folder and its sub-folders, numbered from 0 by path.

    The files of one epoch that `write_training_sets` has written are one set, however many there are.  The
    files are listed as a table without reading them, ranked, and joined by path; the list is written
    once, so a small one the engine broadcasts by itself.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("_metadata.file_path").alias("_file"))
    files = files.withColumn("_set", F.regexp_replace("_file", r"(/epoch=[^/]*)/part-[^/]*$", "$1"))
    sets = ranked(files.select("_set").distinct(), [], ["_set"], "_no")
    numbered = materialise(files.join(sets, "_set").select("_file", (F.col("_no") - 1).cast("int").alias("set_no")))
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select("value", F.col("_metadata.file_path").alias("_file"))
    f = fields(F.col("value"))
    return lines.join(numbered, "_file").select(
        "set_no", F.get(f, F.lit(0)).alias("scaffold"), F.get(f, F.lit(1)).alias("decoration"))
