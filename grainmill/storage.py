"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where none is set and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "grainmill-shared")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def unused(columns, *names: str) -> list[str]:
    """Names like these that none of ``columns`` has, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed (a cluster may use ``--py-files`` instead)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths and root in map(os.path.abspath, sys.path + [root]):
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


class Workspace:
    """Parquet tables of one job in the shared folder: they cut lineage and survive lost executors.

    ``table`` writes and rereads a frame; ``drop`` removes one that no later step reads.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        importable(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/grainmill-{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
