"""Cut lineage of iterative jobs through tables in the shared checkpoint folder."""

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a local session may do without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A path in the shared folder that nothing else uses; one sub-folder for each application."""
    return f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, **options) -> DataFrame:
    """Write once, read back: computed a single time, survives lost executors.  `options` are the writer's."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, options: dict = None, **measures) -> tuple:
    """(table, {name: value}): `materialise`, with aggregates of the rows taken by the job that writes them."""
    seen = Observation()
    table = materialise(df.observe(seen, *[m.alias(name) for name, m in measures.items()]), **(options or {}))
    return table, seen.get


def delete_path(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def remove(*tables: DataFrame) -> None:
    """Delete the files of materialised tables whose readers are done."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete_path(df.sparkSession, folder)
