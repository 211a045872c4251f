"""Intermediate tables in the folder that driver and executors share.

Long jobs cut their lineage by writing a table and reading it back, so a lost executor costs the tasks it
ran and not the whole plan.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..cluster import ship


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of this machine where Spark itself runs in one local process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="locusframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Workspace:
    """A folder of its own under the shared folder, for the tables of one run."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/locusframe-{uuid.uuid4().hex}"
        self._n = 0
        ship(spark)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df as written and read back; plans on the result start at the files."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._locusframe_path = path
        return out

    def drop(self, *kept: DataFrame | str) -> None:
        """Deletes tables made by keep, or folders by their path."""
        jvm = self.spark.sparkContext._jvm
        for x in kept:
            target = jvm.org.apache.hadoop.fs.Path(x if isinstance(x, str) else x._locusframe_path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
