"""Registered queries of grouping, graph, filter and event operators over the driver's tables; their SQL is written apart from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanweave.functions import values
from spanweave.operators import filters, graphs, grouping, spans
from spanweave.plans.queries import _MAIL, ORACLE, QUERIES, query
from spanweave.session import table
from spanweave.streaming import events as streams
from spanweave.workspace import Workspace


def over(f):
    """A query through operators for a name whose SQL is registered already."""
    if f.__name__ not in ORACLE:
        raise KeyError(f.__name__)
    QUERIES[f.__name__] = f
    return f


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@over
def selection_average(spark, sf_dir):
    kinds = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    whole = kinds.groupBy("user_id").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return grouping.unified([kinds, whole]).select("user_id", "event_type", F.round("total", 2).alias("total"), "n")


@over
def polarity(spark, sf_dir):
    p = grouping.polarity(_events(spark, sf_dir), "user_id", F.col("event_type"), F.col("value"), ["click"], ["error"])
    return p.select("user_id", F.round("polarity", 4).alias("polarity"))


@over
def cue_groups(spark, sf_dir):
    return grouping.islands(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") == "error").groupBy("user_id", "grp").agg(F.count("*").alias("n"))


@over
def top_label(spark, sf_dir):
    totals = grouping.totals(_events(spark, sf_dir), "user_id", "event_type", F.col("value"))
    return grouping.ranked(totals, "user_id", "event_type", "total", 1).select("user_id", F.col("event_type").alias("label"))


@over
def normalised_share(spark, sf_dir):
    totals = grouping.totals(_events(spark, sf_dir), "user_id", "event_type", F.col("value"))
    return grouping.shares(totals, "user_id", "total").select("user_id", "event_type", F.round("share", 6).alias("share"))


@over
def mode_share(spark, sf_dir):
    return grouping.mode_share(_events(spark, sf_dir), "user_id", "event_type").select("user_id", F.round("share", 4).alias("share"))


@over
def dedupe_best(spark, sf_dir):
    return grouping.best_of(_events(spark, sf_dir), ["user_id", "event_type"], "value")


@over
def label_distances(spark, sf_dir):
    counts = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    d = grouping.distances(counts, "user_id", "event_type", "n")
    return d.select("user_id", *[F.round(c, 6).alias(c) for c in ("jensen_shannon", "bhattacharyya")])


@over
def page_of_documents(spark, sf_dir):
    return grouping.page(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], 50, 100)


@over
def tumbling_windows(spark, sf_dir):
    return streams.tumbling(_events(spark, sf_dir)).select(F.col("window.start").alias("hour"), "event_type", "n")


@over
def graph_edges(spark, sf_dir):
    """Regions, nations and suppliers as spans that contain each other: a supplier's span lies in its nation's, which lies in its region's."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    regions = r.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("r"), "r_regionkey").alias("ann_id"), F.lit("region").alias("type"), F.lit(0).cast("long").alias("begin"), F.lit(26 * 4096).cast("long").alias("end"), F.col("r_name").alias("label"))
    nations = n.select(F.col("n_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("n"), "n_nationkey").alias("ann_id"), F.lit("nation").alias("type"), "n_nationkey", F.col("n_name").alias("label"))
    suppliers = s.join(n.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey").select(F.col("n_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("s"), "s_suppkey").alias("ann_id"), F.lit("supplier").alias("type"), F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("label"), F.col("s_suppkey").cast("long").alias("k"))
    width = 1 << 12
    at = F.col("n_nationkey").cast("long") * width
    nations = nations.select("doc_id", "ann_id", "type", at.alias("begin"), (at + width).alias("end"), "label")
    inside = at + F.col("k") % (width - 1)
    suppliers = suppliers.select("doc_id", "ann_id", "type", inside.alias("begin"), (inside + 1).alias("end"), "label")
    all_of = regions.unionByName(nations).unionByName(suppliers)
    met = graphs.edges(all_of, "region", "nation").unionByName(graphs.edges(all_of, "nation", "supplier"))
    names = all_of.select(F.concat_ws("_", F.col("ann_id"), F.col("doc_id").cast("string")).alias("id"), F.col("label").alias("name"))
    named = met.join(names.select(F.col("id").alias("source"), F.col("name").alias("source_name")), "source").join(names.select(F.col("id").alias("target"), F.col("name").alias("target_name")), "target")
    return named.select(F.col("source_name").alias("source"), F.col("target_name").alias("target"), F.lit("contains").alias("label"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey % 500 AS a, o_custkey % 500 AS b FROM orders WHERE o_orderkey % 500 <> o_custkey % 500), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, reach) AS (SELECT a, a FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.reach) SELECT node, min(reach) AS component FROM r GROUP BY node""")
def graph_components(spark, sf_dir):
    """Groups of orders' and customers' keys modulo 500, which all orders connect."""
    o = table(spark, sf_dir, "orders")
    links = o.select((F.col("o_orderkey") % 500).alias("a"), (F.col("o_custkey") % 500).alias("b"))
    return graphs.components(Workspace(spark, "graph"), links)


@query("""WITH p AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2), m AS (SELECT user_id, avg(v) AS v FROM p GROUP BY user_id HAVING count(*) > 1)
SELECT user_id, event_type, round(v, 6) AS v FROM p UNION ALL SELECT user_id, NULL, round(v, 6) FROM m""")
def average_rows(spark, sf_dir):
    p = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return grouping.with_average(p, ["user_id"], "event_type", ["v"]).withColumn("v", F.round("v", 6))


@query("""WITH p AS (SELECT user_id, date_trunc('day', ts) AS d, event_type, sum(value) AS v FROM events GROUP BY 1, 2, 3), n AS (SELECT user_id, count(DISTINCT d) AS n FROM p GROUP BY 1)
SELECT p.user_id, event_type AS label, round(sum(v) / n, 6) AS score FROM p JOIN n USING (user_id) GROUP BY p.user_id, event_type, n""")
def label_map_averages(spark, sf_dir):
    each = _events(spark, sf_dir).groupBy("user_id", F.date_trunc("day", "ts").alias("d"), "event_type").agg(F.sum("value").alias("v"))
    maps = each.groupBy("user_id", "d").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("scores"))
    return grouping.label_averages(maps, "user_id").withColumn("score", F.round("score", 6))


@query("""WITH runs AS (SELECT user_id % 5 AS run, event_type AS size, value FROM events), k AS (SELECT size FROM runs GROUP BY size HAVING count(DISTINCT run) = (SELECT count(DISTINCT run) FROM runs))
SELECT run, round(sum(value), 2) AS total FROM runs WHERE size IN (SELECT size FROM k) GROUP BY run""")
def run_totals(spark, sf_dir):
    runs = _events(spark, sf_dir).select((F.col("user_id") % 5).alias("run"), F.col("event_type").alias("size"), "value")
    return grouping.run_totals(grouping.in_every_run(runs, "run", "size"), "run", "value").withColumn("total", F.round("total", 2))


@query(rf"SELECT doc_id, sha256(regexp_replace(text, '{_MAIL}', '<REDACTED>', 'g')) AS redacted, cast(len(regexp_extract_all(text, '{_MAIL}')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '{_MAIL}')")
def redaction_spans(spark, sf_dir):
    """Mail addresses as spans, found by tiling the text, and spliced."""
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(_MAIL))
    found = spans.tile(d, rf"{_MAIL}|(?s:.)(?:(?!{_MAIL})(?s:.))*").where(F.col("piece").rlike(f"^{_MAIL}$"))
    listed = found.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("begin"), F.col("end"))).alias("spans"))
    joined = d.select("doc_id", "text").join(listed, "doc_id")
    return joined.select("doc_id", F.sha2(spans.redact(F.col("text"), F.col("spans")), 256).alias("redacted"), F.size("spans").cast("long").alias("n"))


@query("""SELECT conv_id, turn, CASE lower(role) WHEN 'assistant' THEN 'model' WHEN 'user' THEN 'person' ELSE role END AS speaker, 'Q: ' || coalesce(text, '') || ' A:' AS prompt, 'be brief' AS system FROM conversations""")
def prompt_templates(spark, sf_dir):
    c = filters.prompts(table(spark, sf_dir, "conversations"), "Q: ", " A:", "be brief")
    return c.select("conv_id", "turn", filters.mapped(F.col("role"), {"assistant": "model", "user": "person"}).alias("speaker"), "prompt", "system")


@query("""SELECT d.doc_id, l.quality, d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic >= 0.5""")
def threshold_filter(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.where(filters.above(F.col("toxic"), 0.5)).select("doc_id", "quality", "lang")


@query(r"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS w FROM documents)
SELECT doc_id, cast(count(*) FILTER (WHERE regexp_matches(w, '^[\p{L}\p{N}]+$') AND NOT regexp_matches(w, '^\p{N}+$')) AS BIGINT) AS n_checkable FROM w GROUP BY doc_id""")
def alnum_gate(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(F.split("text", " "), lambda x: x != "")).alias("w"))
    return w.groupBy("doc_id").agg(F.count_if(filters.checkable(F.col("w"))).alias("n_checkable"))


@query("""SELECT event_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def tolerant_json(spark, sf_dir):
    """Every second body is written as a string within JSON first."""
    body = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"')))
    return _events(spark, sf_dir).select("event_id", values.tolerant_json(body, "k bigint")["k"].alias("k"))



@query("""WITH a AS (SELECT doc_id, toxic FROM labels), b AS (SELECT doc_id, CASE WHEN quality = 0 THEN 0 ELSE toxic END AS toxic FROM labels)
SELECT *, 'first' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL
UNION ALL SELECT *, 'second', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL""")
def layer_differences(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    changed = labels.select("doc_id", F.when(F.col("quality") == 0, 0).otherwise(F.col("toxic")).alias("toxic"))
    return grouping.differences(labels.select("doc_id", "toxic"), changed)


@query("""SELECT doc_id, c::INTEGER AS chunk, c * 1000 AS begin, least(c * 1000 + 1000, n) AS "end" FROM
(SELECT doc_id, length(text) AS n, unnest(range(0, (length(text) + 999) // 1000)) AS c FROM documents)""")
def fixed_chunks(spark, sf_dir):
    return spans.fixed_chunks(table(spark, sf_dir, "documents"), F.char_length("text"), 1000)
