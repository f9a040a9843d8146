"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from latticework.plans.workers import prepare


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, else the one set on the context; only a local session gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            at = got.get()
        elif spark.sparkContext.master.startswith("local"):  # tests: one machine, so its own folder is shared
            import tempfile

            at = tempfile.mkdtemp(prefix="checkpoints-")
            spark.sparkContext.setCheckpointDir(at)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return at


class Store:
    """Named intermediate tables, removed when they have served."""

    def __init__(self, spark: SparkSession):
        self.spark = prepare(spark)
        self.base = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
