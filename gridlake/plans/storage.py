"""Work folders on shared storage and tables written epoch by epoch."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, name: str) -> str:
    """New folder under the session's checkpoint folder; a private one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        base = tempfile.mkdtemp(prefix="gridlake-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


class EpochTable:
    """Parquet table with one partition per epoch.

    Writing an epoch replaces just its own partition and readers look at earlier epochs only, so a
    micro-batch that is run again after a lost executor or driver gives the same table.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def before(self, spark: SparkSession, epoch: int, schema) -> DataFrame:
        """Rows of the epochs before ``epoch``; empty when there are none yet."""
        if not exists(spark, self.path):
            return spark.createDataFrame([], schema)
        found = spark.read.schema(schema).parquet(self.path)
        return found.where(f"epoch < {int(epoch)}").drop("epoch")

    def last(self, spark: SparkSession, epoch: int, schema) -> DataFrame:
        """Rows of the epoch just before ``epoch``, for tables that hold a full snapshot."""
        if epoch == 0 or not exists(spark, f"{self.path}/epoch={epoch - 1}"):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.path}/epoch={epoch - 1}")
