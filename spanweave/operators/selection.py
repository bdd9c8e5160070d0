"""Span layers picked by a selection string, and counts over them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.operators import spans

LAYERS = {"text": spans.whole_text, "sentence": spans.sentences, "paragraph": spans.paragraphs, "token": spans.tokens}


def select_spans(docs: DataFrame, selection: str) -> DataFrame:
    """(doc_id, type, begin, end) of every layer that the selection names, between commas or semicolons; an unknown name is an error."""
    names = [n.strip().lower() for n in re.split("[,;]", selection) if n.strip()]
    if unknown := [n for n in names if n not in LAYERS]:
        raise ValueError(f"no such layer: {', '.join(unknown)}")
    if not names:
        raise ValueError("the selection names no layer")
    picked = [LAYERS[n](docs).select("doc_id", F.lit(n).alias("type"), F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end")) for n in dict.fromkeys(names)]
    return reduce(DataFrame.unionByName, picked)


def shared_items(sets: DataFrame, items: str = "ws", id_col: str = "doc_id") -> DataFrame:
    """(id, n_sets, shared_mean): the mean number of items that two sets of a group share, over all pairs of its sets.

    An item in k sets is shared by k * (k - 1) / 2 pairs, so no pair is built. Null with under two sets.
    """
    sizes = sets.groupBy(id_col).agg(F.count("*").alias("n_sets"))
    found = sets.select(id_col, F.explode(F.array_distinct(items)).alias("item")).groupBy(id_col, "item").agg(F.count("*").alias("k"))
    shared = found.groupBy(id_col).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("shared"))
    pairs = F.col("n_sets") * (F.col("n_sets") - 1) / 2
    mean = F.when(F.col("n_sets") > 1, F.coalesce("shared", F.lit(0.0)) / pairs)
    return sizes.join(shared, id_col, "left").select(id_col, "n_sets", mean.alias("shared_mean"))
