"""Frames over groups of any size: running values, places and equal parts, with a group's rows dealt over tasks by ranges of the order.

Rows are cut into ranges of (keys, order) and written once with their range, so that a recomputed task can't cut them otherwise. Each range adds up what
it holds of a group; the sums of the ranges before are a group's offsets, as many rows as there are ranges. A window then runs within a group's range
only, so a group of a third of all rows is many tasks. The order must be total within a group; nulls come first, null keys are a group of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanweave.workspace import Workspace


def running(rows: DataFrame, keys: list[str], order: list[str], value: str, ranges: int | None = None) -> DataFrame:
    """rows with place (from 1) and group_size (longs), running_sum, running_max and running_count of value, from the group's first row to this one.
    Null values add nothing; before the first value sum and max are null."""
    parts = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id())
    held = Workspace(rows.sparkSession, "frames").write(ranged, "ranges").withColumn("_key", F.struct(*[F.col(k) for k in keys]))
    sums = held.groupBy("_key", "_range").agg(F.count("*").alias("_n"), F.sum(value).alias("_sum"), F.max(value).alias("_max"), F.count(value).alias("_some"))
    group = W.partitionBy("_key")
    before = group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        "_key", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.sum("_n").over(group).alias("group_size"),
        F.sum("_sum").over(before).alias("_sum0"), F.max("_max").over(before).alias("_max0"), F.coalesce(F.sum("_some").over(before), F.lit(0)).alias("_some0"),
    )
    local = W.partitionBy("_key", "_range").orderBy(*order)
    so_far = local.rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = held.withColumns({"_p": F.row_number().over(local), "_s": F.sum(value).over(so_far), "_m": F.max(value).over(so_far), "_c": F.count(value).over(so_far)})
    met = inside.join(offsets, ["_key", "_range"])
    total = F.when(F.col("_s").isNull(), F.col("_sum0")).otherwise(F.coalesce("_sum0", F.lit(0)) + F.col("_s"))
    return met.select(
        *rows.columns, (F.col("_n0") + F.col("_p")).alias("place"), "group_size", total.alias("running_sum"), F.greatest("_max0", "_m").alias("running_max"),
        (F.col("_some0") + F.col("_c")).alias("running_count"),
    )


def equal_parts(rows: DataFrame, parts: int) -> DataFrame:
    """rows with part: 1 to `parts`, sizes at most one apart and the larger ones first, and share: the part of its group that lies before the row."""
    small, larger = F.expr(f"group_size div {parts}"), F.expr(f"group_size % {parts}")
    border = larger * (small + 1)
    p = F.col("place")
    part = F.when(p <= border, F.ceil(p / (small + 1))).otherwise(larger + F.ceil((p - border) / F.nullif(small, F.lit(0))))
    share = F.when(F.col("group_size") > 1, (p - 1) / (F.col("group_size") - 1)).otherwise(0.0)
    return rows.withColumns({"part": part.cast("long"), "share": share})


def subtotals(rows: DataFrame, keys: list[str], values: dict[str, str], every: bool = False) -> DataFrame:
    """keys, level (bit i, from the last key, is 1 where a key is summed away) and the sums of values (name to SQL expression): the totals from left to
    right, or of every subset of the keys. One shuffle of partial sums."""
    grouped = rows.cube(*keys) if every else rows.rollup(*keys)
    return grouped.agg(F.grouping_id().cast("long").alias("level"), *[F.sum(F.expr(v)).alias(k) for k, v in values.items()])
