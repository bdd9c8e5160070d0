"""A corpus pipeline: quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next one's docs.
All stages but the last keep the columns of documents, further columns too, whatever their names. Null and empty texts are documents
like any other; null ids can't be grouped, so such documents pass near-dedup; rows that repeat an id with other texts are documents of
their own; repeated rows are near copies of each other; very long texts are taken whole; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.decontaminate import without_leaks
from spanweave.llm.line_dedup import dedup_lines
from spanweave.llm.near_dedup import without_near_duplicates
from spanweave.llm.packing import pack_documents
from spanweave.llm.quality_classifier import classify
from spanweave.llm.support import Workspace
from spanweave.session import ship_package


def _named(names: list[str]) -> list[Column]:
    return [F.col(f"`{c.replace('`', '``')}`") for c in names]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for junk or toxic go."""
    judged = classify(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where(F.col(f"`{judged.columns[-1]}`.kept")).select(*_named(docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document left without lines stays, empty."""
    kept = dedup_lines(spark, docs).select(*_named(docs.columns))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays, once."""
    return without_near_duplicates(spark, docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids, one row a piece."""
    ship_package(spark)
    return pack_documents(docs)


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("decontamination", decontaminated), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = space.write(stage(spark, docs, sf_dir), name)
        if hasattr(docs, "_spanweave_path"):
            space.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
