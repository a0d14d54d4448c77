"""Table access and lineage cuts shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's own switch: shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; where none is set, a temporary one in local mode, and an
    error on a cluster, whose machines don't share their temporary folders."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


class Scratch:
    """Tables written once into the shared folder and read back: later jobs neither recompute them nor depend on
    executors that may be gone. The shuffle files of a written table go when it is written. drop() deletes a table that
    nothing will read again; those that the caller's result still reads stay under the folder of the application in
    spark.checkpoint.dir and go with it (spark.cleaner.referenceTracking.cleanCheckpoints does not cover them)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = spark, f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path, conf = f"{self.root}/{self.count}", self.spark.conf
        before = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            df.select("*").write.parquet(path)
        finally:
            conf.set(CLEANUP, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
