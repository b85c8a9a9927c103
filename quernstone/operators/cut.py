"""Cutting lineage, and dealing small tables to all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str | None:
    """The folder in spark.checkpoint.dir, which driver and executors share; None where it is unset and all of Spark is in this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None and (path := spark.conf.get("spark.checkpoint.dir", None)):
        sc.setCheckpointDir(path)
    if sc.getCheckpointDir() is None and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once: as a checkpoint in the shared folder, or cached where there is none (one process, tests)."""
    return df.checkpoint() if shared_dir(df.sparkSession) else df.persist()


def spread(scan: DataFrame, key: str) -> DataFrame:
    """scan, a plain read of a table, dealt by key to as many tasks as there are cores if its files give fewer; those of a large
    table give more, and it stays as it is. For work that costs far more than moving the texts."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)
