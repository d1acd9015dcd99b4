"""Intermediate tables in the shared folder of the cluster.

Loops write each round there: that cuts lineage, and unlike a local checkpoint it outlives executors.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. A folder of this machine only where that is unset and the
    master is local: tasks on other machines would each write to a folder of their own."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (root or "file:///tmp/checkpoints").rstrip("/") + "/quadspark"


class Scratch:
    """Tables by name under one folder that goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the named tables, or all of them."""
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            for name in names or ("",):
                path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
                path.getFileSystem(conf).delete(path, True)
        except Exception:  # the session may be gone at exit; what is left is only scratch
            if names:
                raise
