"""Tables of one job in the folder that driver and executors share. They cut lineage and outlive any executor."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; without it, a temporary one if all run in this process, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="rowfeed-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def qualified(spark: SparkSession, url: str) -> str:
    """A path with the scheme of its file system, which may be the cluster's default one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(url)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


class Workspace:
    """A folder of its own for a job's tables; the driver deletes it when it ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/rowfeed-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` as Parquet and read it back."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def url(self) -> str:
        """The folder with its file system's scheme, for readers and writers besides Spark's."""
        return qualified(self.spark, self.path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        atexit.unregister(self.close)
        with suppress(Exception):  # the session may be gone
            self._delete(self.path)

    def _delete(self, at: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
