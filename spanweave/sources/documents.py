"""Readers and writers of document formats, as plans over Spark's own text, JSON and XML sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VTT_TIME = r"(\d{2}:\d{2}:\d{2}\.\d{3}) --> (\d{2}:\d{2}:\d{2}\.\d{3})"


def read_json_cas(spark: SparkSession, path: str) -> DataFrame:
    """(path, lang, text) of JSON documents whose text sits under a key that the metadata names."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.parse_json("value").alias("v"))
    meta = "$._views._InitialView.DocumentMetaData[0]"
    named = files.select("path", F.try_variant_get("v", f"{meta}.language", "string").alias("lang"), F.try_variant_get("v", f"{meta}.sofa", "string").alias("sofa"), F.try_variant_get("v", "$._referenced_fss", "map<string,struct<sofaString:string>>").alias("fss"))
    return named.select("path", "lang", F.element_at("fss", F.col("sofa"))["sofaString"].alias("text"))


def write_json(docs: DataFrame, path: str) -> None:
    docs.write.json(path)


def write_xml(docs: DataFrame, path: str, version: str = "1.0") -> None:
    if version not in ("1.0", "1.1"):
        raise ValueError("version is 1.0 or 1.1")
    docs.write.format("xml").option("rowTag", "document").option("rootTag", "documents").option("declaration", f'version="{version}" encoding="UTF-8"').save(path)


def titled(df: DataFrame, title: str, body: str) -> DataFrame:
    """Collections whose text is a headline, a line feed and a body."""
    return df.withColumn("text", F.concat_ws("\n", F.col(title), F.col(body)))


def read_dictionary(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(word, n): a frequency list, summed over case."""
    rows = spark.read.csv(path, sep=sep, schema="word string, n bigint")
    return rows.groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"))


def parse_vtt(files: DataFrame) -> DataFrame:
    """files (doc_id, text): timed caption blocks (doc_id, pos, start, stop, caption)."""
    blocks = files.select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("pos", "b"))
    timed = blocks.where(F.col("b").rlike(VTT_TIME))

    def seconds(stamp: Column) -> Column:
        p = F.split(stamp, ":")
        return F.round(p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double"), 2)

    return timed.select("doc_id", "pos", seconds(F.regexp_extract("b", VTT_TIME, 1)).alias("start"), seconds(F.regexp_extract("b", VTT_TIME, 2)).alias("stop"), F.trim(F.regexp_replace("b", rf"(?s)^.*?{VTT_TIME}[^\n]*\n?", "")).alias("caption"))


def assemble_characters(chars: DataFrame) -> DataFrame:
    """OCR characters (page, para, word, pos, ch) to one text a page: words joined by one blank."""
    words = chars.groupBy("page", "para", "word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "").alias("w"))
    return words.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "word", "w"))), lambda x: x["w"]), " ").alias("text"))


#: What a page of hOCR is made of: where pages and paragraphs begin, and words with their boxes and confidence.
HOCR = (
    r"(?s)(?P<page><div[^>]*class=['\"]ocr_page['\"])|(?P<par><p[^>]*class=['\"]ocr_par['\"])"
    r"|<span[^>]*class=['\"]ocrx_word['\"][^>]*title=['\"][^'\"]*?bbox (?P<x0>\d+) (?P<y0>\d+) (?P<x1>\d+) (?P<y1>\d+)(?:[^'\"]*?x_wconf (?P<conf>[\d.]+))?[^'\"]*['\"][^>]*>(?P<word>.*?)</span>\s*(?=<|$)"
)


def parse_hocr(files: DataFrame) -> DataFrame:
    """files (doc_id, text): words (doc_id, page, para, n, x0, y0, x1, y1, conf, word) in order, pages and paragraphs from 1, 0 before the first; tags
    inside a word are taken off, the five named entities resolved, words left empty dropped."""
    from spanweave.operators.patterns import positions

    g = lambda k: F.col("groups")[k]
    found = positions(files.select("doc_id", "text"), HOCR).select("doc_id", "n", "groups")
    upto = W.partitionBy("doc_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    found = found.withColumn("page", F.count(g("page")).over(upto)).withColumn("para", F.count(g("par")).over(upto))
    plain = F.trim(F.regexp_replace(g("word"), "<[^>]*>", ""))
    for entity, mark in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        plain = F.replace(plain, F.lit(f"&{entity};"), F.lit(mark))
    boxes = [g(k).cast("int").alias(k) for k in ("x0", "y0", "x1", "y1")]
    return found.select("doc_id", "page", "para", "n", *boxes, g("conf").cast("double").alias("conf"), plain.alias("word")).where("word <> ''")


def graphml_document(nodes: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    """(part, line): the lines of one GraphML document, in order of part: its head, the nodes, the edges, its end. Written by write_graphml."""
    spark = nodes.sparkSession
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="label" for="all" attr.name="label" attr.type="string"/>', f'<graph edgedefault="{"directed" if directed else "undirected"}">']
    ends = spark.createDataFrame([(0, "\n".join(head)), (3, "</graph>\n</graphml>")], "part int, line string")
    lines = graphml(nodes, edges).select(F.when(F.col("kind") == "node", 1).otherwise(2).alias("part"), "line")
    return ends.unionByName(lines)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, parts: int = 8, directed: bool = True) -> None:
    """Text files that, one behind the other in order of their names, are one GraphML document. They are dealt by ranges, so a graph of any size is
    written by as many tasks as parts."""
    lines = graphml_document(nodes, edges, directed)
    lines.repartitionByRange(parts, "part", "line").sortWithinPartitions("part", "line").select("line").write.text(path)


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML lines (kind, line) of nodes (id, label) and edges (source, target, label); written as text, one part a task."""
    def esc(c: str) -> Column:
        return F.replace(F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))

    n = nodes.select(F.lit("node").alias("kind"), F.format_string('<node id="%s"><data key="label">%s</data></node>', esc("id"), esc("label")).alias("line"))
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), F.format_string('<edge source="%s" target="%s"><data key="label">%s</data></edge>', esc("source"), esc("target"), esc("label")).alias("line")))
