"""Tables in the folder that driver and executors share: they cut lineage, outlive any executor, and go when the application ends."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set and all tasks run in the driver."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(context, "_spanweave_shared", None):
        context._spanweave_shared = tempfile.mkdtemp(prefix="spanweave-shared-")
        atexit.register(shutil.rmtree, context._spanweave_shared, ignore_errors=True)
    return "file://" + context._spanweave_shared


def dealt(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the input: both are dealt over the tasks. Spark takes written tables for small by their packed size and
    would gather them in the driver, where a row takes many times that."""
    return df.hint("merge")


class Workspace:
    """Written tables of one operator's run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/spanweave/{name}-{uuid.uuid4().hex[:12]}"
        self.made: list[DataFrame] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{len(self.made) + 1:03d}-{name}"
        df.write.parquet(path)
        if not self.made:
            # a result may still be read from them, so the tables stay as long as the application does
            root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            root.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._spanweave_path = path
        self.made.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later step reads."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._spanweave_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
