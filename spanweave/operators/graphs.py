"""Annotations as graphs: nodes, edges by containment, distinct edges and connected groups.

Annotations: (doc_id, ann_id, type, begin, end, label).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanweave.operators import spans
from spanweave.workspace import Workspace, dealt


def components(space: Workspace, links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): (node, component), component the smallest node reached.

    Alternating large-star and small-star steps; every minimum is a map-side-combined aggregate, so a hub costs one row a
    map task. Each round is a written table. An empty link table gives an empty result.
    """
    edges = space.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def print_of(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = print_of(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(dealt(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(dealt(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = space.write(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        space.drop(edges)
        edges, was, before = after, before, print_of(after)
        if was == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def class_scan(annotations: DataFrame, name: str) -> DataFrame:
    """The annotations of a class: POS takes every class that holds POS, Dependency its root class too."""
    if name == "POS":
        return annotations.where(F.col("type").contains("POS"))
    return annotations.where(F.col("type").isin("Dependency", "ROOT")) if name == "Dependency" else annotations.where(F.col("type") == name)


def node_id(unique: bool, shared: bool) -> Column:
    """unique: equal labels are one node; shared: several documents lie in one graph."""
    if unique:
        return F.col("label")
    own = F.col("ann_id").cast("string")
    return F.concat_ws("_", own, F.col("doc_id").cast("string")) if shared else own


def nodes(annotations: DataFrame, unique: bool = False, shared: bool = True, colour: str = "white") -> DataFrame:
    """(id, type, label, colour), one row an id."""
    return annotations.select(node_id(unique, shared).alias("id"), "type", F.coalesce("label", F.lit("")).alias("label"), F.lit(colour).alias("colour")).dropDuplicates(["id"])


def edges(annotations: DataFrame, source: str, target: str, labels: str | None = None, directed: bool = True, unique: bool = False, shared: bool = True) -> DataFrame:
    """Distinct (source, target, label, directed) where a span of class `source` contains one of class `target`. The label is that of the
    last span of class `labels` within the source, null where there is none."""
    a = class_scan(annotations, source).withColumn("id", node_id(unique, shared))
    b = class_scan(annotations, target).withColumn("id", node_id(unique, shared))
    met = spans.contained(a, b).where("o_id <> i_id").select("o_doc_id", "o_ann_id", F.col("o_id").alias("source"), F.col("i_id").alias("target"))
    if labels:
        found = spans.contained(a, class_scan(annotations, labels)).groupBy("o_doc_id", "o_ann_id").agg(F.max_by("i_label", F.struct("i_begin", "i_end", "i_ann_id")).alias("label"))
        met = met.join(found, ["o_doc_id", "o_ann_id"], "left")
    else:
        met = met.withColumn("label", F.lit(None).cast("string"))
    return met.select("source", "target", "label", F.lit(directed).alias("directed")).distinct()


def groups(space: Workspace, edge_rows: DataFrame, node_rows: DataFrame, types: list[str], name: str = "g") -> DataFrame:
    """(id, group) of nodes of some types that edges between such nodes connect; group is `g<type>` and the smallest id reached. Groups may be
    given as nodes (id, type) to a later call."""
    inside = node_rows.where(F.col("type").isin(*types)).select("id")
    met = edge_rows.select(F.col("source").alias("a"), F.col("target").alias("b")).join(inside.withColumnRenamed("id", "a"), "a", "left_semi").join(inside.withColumnRenamed("id", "b"), "b", "left_semi")
    return components(space, met.select("a", "b")).select(F.col("node").alias("id"), F.concat(F.lit(f"g{name}"), "component").alias("group"))


def disambiguate(mentions: DataFrame, categories: DataFrame, tag: str) -> DataFrame:
    """Each mention with the value of the best-scored category of a tag that it covers, null if there is none; ties by value."""
    best = spans.contained(mentions, categories.where(F.array_contains(F.split("tags", "[;,:]"), tag))).groupBy("o_doc_id", "o_begin", "o_end").agg(F.max_by("i_value", F.struct("i_score", "i_value")).alias("value"))
    return mentions.join(best.select(F.col("o_doc_id").alias("doc_id"), F.col("o_begin").alias("begin"), F.col("o_end").alias("end"), "value"), ["doc_id", "begin", "end"], "left")


def overlapping_boxes(a: DataFrame, b: DataFrame, cell: float = 64.0) -> DataFrame:
    """Pairs of boxes (id, page, x0, y0, x1, y1) that share area: an equi-join on page and grid cells, checked inside."""

    def binned(boxes: DataFrame, p: str) -> DataFrame:
        named = boxes.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "page", "x0", "y0", "x1", "y1")])
        steps = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
        return named.withColumn("cx", steps(f"{p}_x0", f"{p}_x1")).withColumn("cy", steps(f"{p}_y0", f"{p}_y1")).withColumn("page", F.col(f"{p}_page"))

    hit = (F.col("a_x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("a_x1")) & (F.col("a_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("a_y1"))
    return binned(a, "a").join(binned(b, "b"), ["page", "cx", "cy"]).where(hit).select("page", "a_id", "b_id").distinct()


def matched_documents(entities: DataFrame, threshold: float) -> DataFrame:
    """Entities (pipeline_id, doc_index, entity_id, text) of different documents of one pipeline: (pipeline_id, doc_a, doc_b, entity_a, entity_b, similarity)
    of similarity 1 - normalised edit distance of at least threshold > 0. All pairs that reach it."""
    from spanweave.streaming.matching import matches

    return matches(entities.withColumn("seq", F.lit(0).cast("long")), threshold).drop("seq")


def turns_with_speakers(words: DataFrame, turns: DataFrame) -> DataFrame:
    """words (doc_id, begin, end, ...) with the speaker of the turn (doc_id, begin, end, speaker) that overlaps them longest; words
    without a time are dropped."""
    timed = words.where("begin is not null and end is not null")
    best = spans.overlapping(timed, turns).groupBy("a_doc_id", "a_begin", "a_end").agg(F.max_by("b_speaker", F.struct("overlap", "b_speaker")).alias("speaker"))
    return timed.join(best.select(F.col("a_doc_id").alias("doc_id"), F.col("a_begin").alias("begin"), F.col("a_end").alias("end"), "speaker"), ["doc_id", "begin", "end"], "left")


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
