"""Session helpers: reading tables and cutting lineage through reliable storage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("folio")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder of spark.checkpoint.dir and read it from there.

    Where that setting is missing, a local session (tests, a laptop) uses a temporary
    folder; on a cluster that is an error, for executors couldn't read each other's files.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folio-checkpoint-"))
    return df.checkpoint(eager=True)


def never_broadcast(df: DataFrame) -> DataFrame:
    """df as one side of a sort-merge join, whatever size the planner takes it for.

    A checkpoint keeps the size estimated for the plan that it cut, and arrays count there
    as one element; so the planner would send tables of any size through the driver.
    """
    return df.hint("merge")


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for steps that cost far more than reading.

    Only inputs of few splits (small files) are shuffled; large ones stay as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
