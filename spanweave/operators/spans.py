"""Span operators: layers are DataFrames (doc_id, begin, end, ...) of half-open code-point offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanweave.operators.folds import ordered_fold

SENTENCE = r"[^.!?]*[.!?]+|[^.!?]+$"
TOKEN = r"[^ \t\n\r]+|[ \t\n\r]+"
#: Spans are binned for range joins, so a document of any length is many join keys.
BIN = 4096


def tile(docs: DataFrame, pattern: str, order: str = "pos", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut each text into consecutive pieces: (doc_id, pos, begin, end, piece). Offsets are a running sum of lengths. Texts are dealt over the tasks, once
    and as they are, and their pieces stay with them."""
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).repartition("doc_id")
    pieces = whole.select("doc_id", F.posexplode(F.regexp_extract_all("_text", F.lit(pattern), 0)).alias(order, "piece"))
    before = W.partitionBy("doc_id").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)).cast("long")
    return pieces.select("doc_id", order, begin.alias("begin"), (begin + F.char_length("piece")).alias("end"), "piece")


def sentences(docs: DataFrame) -> DataFrame:
    return tile(docs, SENTENCE)


def tokens(docs: DataFrame) -> DataFrame:
    return tile(docs, TOKEN).where(F.btrim("piece", F.lit(" \t\n\r")) != "")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Line-feed paragraphs; an empty text is one empty paragraph."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("pos", "piece"))
    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.char_length("piece") + 1).over(before), F.lit(0)).cast("long")
    return lines.select("doc_id", "pos", begin.alias("begin"), (begin + F.char_length("piece")).alias("end"), "piece")


def whole_text(docs: DataFrame) -> DataFrame:
    """The span [0, length) of each document: the selection `text`."""
    return docs.select("doc_id", F.lit(0).cast("long").alias("begin"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("end"))


def covered_text(text: Column, begin: Column, end: Column) -> Column:
    return F.substring(text, begin + 1, end - begin)


def contained(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """inner spans within outer ones of the same document, as columns o_* and i_*: an equi-join on document and bin of the inner span's begin, the range
    checked inside."""
    a = outer.select(*[F.col(c).alias(f"o_{c}") for c in outer.columns]).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("o_begin") / BIN), F.floor(F.greatest(F.col("o_end") - 1, F.col("o_begin")) / BIN))))
    b = inner.select(*[F.col(c).alias(f"i_{c}") for c in inner.columns]).withColumn("_bin", F.floor(F.col("i_begin") / BIN))
    met = (a["o_doc_id"] == b["i_doc_id"]) & (a["_bin"] == b["_bin"]) & (b["i_begin"] >= a["o_begin"]) & (b["i_end"] <= a["o_end"])
    return a.join(b, met).drop("_bin")


def first_container(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Each inner span with its first container only."""
    w = W.partitionBy("i_doc_id", "i_begin", "i_end").orderBy("o_begin", "o_end")
    return contained(outer, inner).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _binned(layer: DataFrame, side: str) -> DataFrame:
    spans = layer.select(*[F.col(c).alias(f"{side}_{c}") for c in layer.columns])
    begin, end = F.col(f"{side}_begin"), F.col(f"{side}_end")
    return spans.withColumn("_bin", F.explode(F.sequence(F.floor(begin / BIN), F.floor(F.greatest(end - 1, begin) / BIN))))


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Half-open overlaps with their length: an equi-join on document and bin, each pair in the bin where the later of the two begins. Spans without
    a begin or an end meet none."""
    x, y = _binned(a, "a"), _binned(b, "b")
    met = (x["a_doc_id"] == y["b_doc_id"]) & (x["_bin"] == y["_bin"]) & (x["a_begin"] < y["b_end"]) & (y["b_begin"] < x["a_end"])
    begin = F.greatest("a_begin", "b_begin")
    joined = x.join(y, met & (x["_bin"] == F.floor(begin / BIN))).drop("_bin")
    return joined.withColumn("overlap", F.least("a_end", "b_end") - begin)


def close_gaps(layer: DataFrame, length: Column) -> DataFrame:
    """End of each span = next begin - 1, of the last = length - 1."""
    return layer.withColumn("end", F.coalesce(F.lead("begin").over(W.partitionBy("doc_id").orderBy("begin")) - 1, length - 1))


def clip(layer: DataFrame, length: Column) -> DataFrame:
    """Spans cut to the text; those left empty go."""
    return layer.withColumns({"begin": F.greatest("begin", F.lit(0)), "end": F.least("end", length)}).where("begin < end")


def longest_of_overlaps(layer: DataFrame, score: str = "score", kind: str = "type") -> DataFrame:
    """Dedupe on (begin, end, type) by best score, then keep the longest of overlapping spans, of equal ones the first: a stream in a document's order
    that holds one span."""
    best = layer.groupBy("doc_id", "begin", "end", kind).agg(F.max(score).alias(score))
    rows = best.select("doc_id", "begin", "end", kind, score, (-F.col("end")).alias("_minus_end"))

    class Longest:
        def __init__(self):
            self.last = None

        def take(self, begin, end, *more):
            last = self.last
            if last is None or begin >= last[1]:
                self.last = (begin, end, *more)
                return [] if last is None else [last]
            if end - begin > last[1] - last[0]:
                self.last = (begin, end, *more)
            return []

        def end(self):
            return [self.last]

    return ordered_fold(rows, ["doc_id"], ["begin", "_minus_end", kind, score], ["begin", "end", kind, score], Longest, best.select("begin", "end", kind, score).schema)


def fixed_chunks(layer: DataFrame, length: Column, size: int, id_col: str = "doc_id") -> DataFrame:
    """(id, chunk, begin, end): stretches of `size` from 0 that cover the length, the last one cut off; none for a length of 0 or null.
    An offset within a chunk is restored by adding its begin."""
    n = F.ceil(length / size).cast("int")
    each = layer.where(length > 0).select(id_col, length.alias("_length"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    begin = F.col("chunk").cast("long") * size
    return each.select(id_col, "chunk", begin.alias("begin"), F.least(begin + size, F.col("_length")).cast("long").alias("end"))


def redact(text: Column, spans: Column, placeholder: str = "<REDACTED>") -> Column:
    """Splice a placeholder over sorted, disjoint spans array<struct<begin,end>>; later spans that overlap a used one are skipped."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        begin, end = s["begin"].cast("int"), s["end"].cast("int")
        joined = F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, begin - acc["at"]), F.lit(placeholder)).alias("out"), end.alias("at"))
        return F.when(begin >= acc["at"], joined).otherwise(acc)

    return F.aggregate(F.array_sort(spans), zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))


def pack_consecutive(layer: DataFrame, size: int) -> DataFrame:
    """Greedy packing of consecutive spans into chunks of at most `size` characters: a running sum with reset, as a stream in a document's order."""
    rows = layer.select("doc_id", "pos", F.char_length("piece").alias("_n"))

    class Pack:
        def __init__(self):
            self.chunk, self.held, self.any = 0, 0, False

        def take(self, pos, n):
            n = n or 0
            if self.any and self.held + n > size:
                self.chunk, self.held = self.chunk + 1, 0
            self.held, self.any = self.held + n, True
            return [(pos, self.chunk)]

        def end(self):
            return []

    return ordered_fold(rows, ["doc_id"], ["pos", "_n"], ["pos", "_n"], Pack, rows.select("pos", F.lit(0).alias("chunk")).schema)
