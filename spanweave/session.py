"""Session helpers shared by every subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_DIR = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in every Python worker, once per application."""
    context = spark.sparkContext
    if getattr(context, "_spanweave_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="spanweave-ship-")
    archive = os.path.join(folder, "spanweave.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(PACKAGE_DIR.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE_DIR.parent))
    context.addPyFile(archive)
    context._spanweave_shipped = True


def tasks(spark: SparkSession) -> int:
    """Parts to deal rows over whose work or state is far larger than their bytes, by which Spark would put parts together. One more than its own number: it
    leaves out a deal equal to the one before, and then puts those parts together."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism) + 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
