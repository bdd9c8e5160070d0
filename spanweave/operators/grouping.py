"""Grouped results: averages beside their rows, shares, rankings, islands, distances of distributions, relational division."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_average(rows: DataFrame, keys: list[str], part: str, values: list[str]) -> DataFrame:
    """rows (keys, part, values), and for each key of more than one part a row more, part null, of the means."""
    mean = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.avg(v).alias(v) for v in values]).where("_n > 1")
    return rows.select(*keys, part, *values).unionByName(mean.select(*keys, F.lit(None).cast(rows.schema[part].dataType).alias(part), *values))


def label_averages(rows: DataFrame, key: str, scores: str = "scores") -> DataFrame:
    """(key, label, score): of maps of label scores the mean a label; a span that lacks the label counts 0."""
    n = rows.groupBy(key).agg(F.count("*").alias("_n"))
    each = rows.select(key, F.explode(scores).alias("label", "score")).groupBy(key, "label").agg(F.sum("score").alias("_s"))
    return each.join(n, key).select(key, "label", (F.col("_s") / F.col("_n")).alias("score"))


def polarity(rows: DataFrame, key: str, label: Column, value: Column, positive: list[str], negative: list[str]) -> DataFrame:
    side = lambda names: F.sum(F.when(label.isin(*names), value).otherwise(F.lit(0)))
    return rows.groupBy(key).agg((side(positive) - side(negative)).alias("polarity"))


def islands(rows: DataFrame, key: str, order: list[str], cue: Column) -> DataFrame:
    """rows plus grp: a new group begins at each cue; what comes before the first one is of the first cue's group, 1, and so are all rows of a key
    without a cue."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("grp", F.greatest(F.sum(F.when(cue, 1).otherwise(0)).over(w), F.lit(1).cast("long")))


def totals(rows: DataFrame, key: str, label: str, value: Column) -> DataFrame:
    return rows.groupBy(key, label).agg(F.sum(value).alias("total"))


def ranked(rows: DataFrame, key: str, label: str, score: str, most: int | None = None) -> DataFrame:
    """rows plus rank by falling score, ties by label; the first `most` of each key."""
    out = rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), label)))
    return out if most is None else out.where(F.col("rank") <= most)


def shares(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows plus share: the value by the sum of its key's."""
    return rows.withColumn("share", F.col(value) / F.sum(value).over(W.partitionBy(key)))


def mode_share(rows: DataFrame, key: str, label: str) -> DataFrame:
    counts = rows.groupBy(key, label).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg((F.max("n").cast("double") / F.sum("n")).alias("share"))


def best_of(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """One row a key: the largest score."""
    return rows.groupBy(*keys).agg(F.max(score).alias("score"))


def in_every_run(rows: DataFrame, run: str, size: str) -> DataFrame:
    """Relational division: the rows of sizes that every run has."""
    runs = rows.agg(F.count_distinct(run)).first()[0]
    whole = rows.groupBy(size).agg(F.count_distinct(run).alias("_r")).where(F.col("_r") == runs).select(size)
    return rows.join(whole, size, "left_semi")


def run_totals(rows: DataFrame, run: str, duration: str) -> DataFrame:
    return rows.groupBy(run).agg(F.sum(duration).alias("total"))


def elapsed(begin: Column, end: Column) -> Column:
    """Seconds between two millisecond stamps."""
    return (end - begin) / 1000


def page(rows: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def distances(counts: DataFrame, key: str, label: str, n: str) -> DataFrame:
    """(key, jensen_shannon, bhattacharyya) of each key's distribution over labels to that of all keys together."""
    total = counts.agg(F.sum(n)).first()[0]
    whole = counts.groupBy(label).agg((F.sum(n) / F.lit(total)).alias("q"))
    p = shares(counts, key, n).join(whole, label).withColumn("m", (F.col("share") + F.col("q")) / 2)
    js = F.sum(0.5 * F.col("share") * F.log(F.col("share") / F.col("m")) + 0.5 * F.col("q") * F.log(F.col("q") / F.col("m"))) + 0.5 * F.log(F.lit(2.0)) * (1 - F.sum("q"))
    return p.groupBy(key).agg(F.abs(js).alias("jensen_shannon"), F.sum(F.sqrt(F.col("share") * F.col("q"))).alias("bhattacharyya"))


def by_span(rows: DataFrame, value: str, score: str) -> DataFrame:
    """A row a span: its values and scores in one list of structs, best first, so that they stay in line."""
    each = rows.groupBy("doc_id", "begin", "end").agg(F.collect_list(F.struct((-F.col(score)).alias("minus"), F.col(value).alias("value"))).alias("l"))
    return each.select("doc_id", "begin", "end", F.transform(F.array_sort("l"), lambda x: F.struct(x["value"].alias("value"), (-x["minus"]).alias("score"))).alias("topics"))


def by_begin(rows: DataFrame, *collected: str) -> DataFrame:
    """A row a begin: the smallest end, and the sets of some columns in order."""
    return rows.groupBy("doc_id", "begin").agg(F.min("end").alias("end"), *[F.array_sort(F.collect_set(c)).alias(c) for c in collected])


def differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows that one layer has more often than the other, with the side that has them and how many more; nulls equal nulls. Both
    layers are counted in one aggregation, so that equal layers cost one shuffle of partial counts."""
    cols = first.columns
    signed = first.withColumn("_sign", F.lit(1)).unionByName(second.select(*cols).withColumn("_sign", F.lit(-1)))
    left = signed.groupBy(*cols).agg(F.sum("_sign").alias("n")).where("n <> 0")
    return left.select(*cols, F.when(F.col("n") > 0, "first").otherwise("second").alias("side"), F.abs("n").alias("n"))


def unified(parts: list[DataFrame]) -> DataFrame:
    """One table of parts of different columns; a missing one is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def vector_means(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(key, mean): the mean of a key's vectors, zeros where all are null."""
    each = rows.select(key, F.posexplode_outer(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = each.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "x")))).alias("l"))
    return listed.select(key, F.when(F.size("l") > 0, F.transform("l", lambda p: p["x"])).otherwise(F.array_repeat(F.lit(0.0), size)).alias("mean"))
