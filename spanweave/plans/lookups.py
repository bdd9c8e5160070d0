"""Registered queries of matching between documents and of dictionaries within several edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanweave.operators import comparisons, matching, patterns, timex
from spanweave.operators.automaton import within_edits
from spanweave.plans.measures import _LATIN
from spanweave.plans.queries import query
from spanweave.session import table
from spanweave.streaming.matching import place_matches, places, stored_batch
from spanweave.workspace import Workspace

_SPLIT = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT conv_id, turn, unnest({_SPLIT}) AS word, unnest(range(len({_SPLIT}))) AS pos FROM conversations), e AS (SELECT conv_id, turn, word, min(pos) AS id, translate(word, '{_LATIN[0]}', '{_LATIN[1]}') AS x FROM w GROUP BY conv_id, turn, word),
n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS doc FROM (SELECT DISTINCT conv_id, turn FROM conversations)), d AS (SELECT e.*, doc FROM e JOIN n USING (conv_id, turn))
SELECT a.conv_id, a.doc AS doc_a, b.doc AS doc_b, a.id AS entity_a, b.id AS entity_b, round(1 - levenshtein(a.x, b.x)::DOUBLE / greatest(length(a.x), length(b.x)), 6) AS similarity
FROM d a JOIN d b ON a.conv_id = b.conv_id AND a.doc < b.doc WHERE 1 - levenshtein(a.x, b.x)::DOUBLE / greatest(length(a.x), length(b.x)) >= 0.8 - 1e-9""")
def two_phase_match(spark, sf_dir):
    """A conversation is a pipeline, its turns are documents and their words entities: those of similarity 0.8 between turns."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("pipeline_id"), F.col("turn").alias("seq"), "text")
    each = turns.select("pipeline_id", "seq", F.posexplode_outer(matching.tokens(F.col("text"))).alias("pos", "word")).groupBy("pipeline_id", "seq", "word").agg(F.min("pos").cast("long").alias("entity_id"))
    entities = F.collect_list(F.when(F.col("word").isNotNull(), F.struct("entity_id", F.col("word").alias("text"))))
    stored = each.groupBy("pipeline_id", "seq").agg(entities.alias("entities")).select("pipeline_id", "seq", F.lit("process").alias("event"), F.lit("Word").alias("selection"), "entities", F.lit(True).alias("clear"))
    ends = turns.select("pipeline_id").distinct().select("pipeline_id", F.lit(1 << 60).alias("seq"), F.lit("finalize").alias("event"), F.lit(None).cast("string").alias("selection"), F.lit(None).cast(stored.schema["entities"].dataType).alias("entities"), F.lit(True).alias("clear"))
    # several joins read the places: they are made once
    found = place_matches(Workspace(spark, "two_phase").write(places(stored_batch(stored.unionByName(ends))), "places"), 0.8)
    return found.select(F.col("pipeline_id").cast("long").alias("conv_id"), F.col("doc_a").cast("long").alias("doc_a"), F.col("doc_b").cast("long").alias("doc_b"), "entity_a", "entity_b", F.round("similarity", 6).alias("similarity"))


_TWO = "SELECT DISTINCT unnest({s}) AS w FROM {t}"


@query(f"""WITH a AS (SELECT w, translate(w, '{_LATIN[0]}', '{_LATIN[1]}') AS x FROM ({_TWO.format(s=_SPLIT, t='conversations')})), b AS (SELECT w, translate(w, '{_LATIN[0]}', '{_LATIN[1]}') AS x FROM ({_TWO.format(s=_SPLIT, t='benchmark')}))
SELECT a.w AS word, b.w AS entry, levenshtein(a.x, b.x)::BIGINT AS distance, CAST(NULL AS VARCHAR) AS error FROM a JOIN b ON abs(length(a.x) - length(b.x)) <= 2 AND levenshtein(a.x, b.x) <= 2""")
def dictionary_within_two_edits(spark, sf_dir):
    """Every word of the conversations among the items' words, within two edits."""
    of = lambda name, column: table(spark, sf_dir, name).select(F.explode(matching.tokens(F.col("text"))).alias(column))
    return within_edits(of("conversations", "word"), of("benchmark", "entry"), 2)


@query(r"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z]+|[^A-Z]+')) AS piece, unnest(range(len(regexp_extract_all(text, '[A-Z]+|[^A-Z]+')))) AS i FROM documents),
b AS (SELECT doc_id, i, piece, cast(coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x FROM p), m AS (SELECT doc_id, x, piece FROM b WHERE regexp_matches(piece, '^[A-Z]'))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY x) - 1 AS n, x + length(piece) AS begin_at, coalesce(lead(x) OVER (PARTITION BY doc_id ORDER BY x), (SELECT length(text) FROM documents d WHERE d.doc_id = m.doc_id)) AS end_at, piece AS match FROM m""")
def match_stretches(spark, sf_dir):
    """From each run of capital letters to the next."""
    found = patterns.stretches(table(spark, sf_dir, "documents").select("doc_id", "text"), "[A-Z]+")
    return found.select("doc_id", F.col("n").cast("long").alias("n"), F.col("begin").cast("long").alias("begin_at"), F.col("end").cast("long").alias("end_at"), "match")


@query("""SELECT o_orderkey AS doc_id, t.type, t.value FROM orders, LATERAL (SELECT unnest([{'type': 'DATE', 'value': strftime(o_orderdate, '%Y-%m-%d')}, {'type': 'DATE', 'value': strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d')},
{'type': 'DATE', 'value': strftime(o_orderdate - INTERVAL 14 DAY, '%Y-%m-%d')}, {'type': 'DURATION', 'value': 'P' || o_custkey % 90 + 10 || 'D'}, {'type': 'SET', 'value': 'XXXX-WXX-' || isodow(o_orderdate)}, {'type': 'TIME', 'value': strftime(o_orderdate, '%Y-%m-%dT') || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':05'}]) AS t)""")
def time_expressions(spark, sf_dir):
    """Notes of the orders, in words: the order's date, relative dates, a duration, a repeated weekday and a time."""
    at = F.col("o_orderdate").cast("timestamp")
    note = F.concat(F.lit("Ordered on "), F.date_format(at, "d MMMM yyyy"), F.lit(", to be sent in three days; offered vor 2 Wochen. Paid for "), (F.col("o_custkey") % 90 + 10).cast("string"), F.lit(" days, every "), F.date_format(at, "EEEE"), F.lit(" um "), (F.col("o_orderkey") % 24).cast("string"), F.lit(":05 Uhr"))
    # a file may have few parts, and finding takes long
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").repartition("o_orderkey")
    notes = orders.select(F.col("o_orderkey").alias("doc_id"), note.alias("text"), at.alias("reference_time"))
    return timex.expressions(notes).select("doc_id", "type", "value")


@query("""WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS u, b.embedding::DOUBLE[] AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
w AS (SELECT vec_id, list_avg(list_transform(list_zip(list_sort(u), list_sort(v)), lambda z: abs(z[1] - z[2]))) AS w FROM p),
e AS (SELECT vec_id, i, j, abs(u[i] - u[j]) AS a, abs(v[i] - v[j]) AS b FROM (SELECT vec_id, u, v, unnest(range(1, len(u) + 1)) AS i FROM p) CROSS JOIN (SELECT unnest(range(1, 65)) AS j)),
r AS (SELECT vec_id, i, avg(a) AS ra, avg(b) AS rb FROM e GROUP BY 1, 2), g AS (SELECT vec_id, avg(a) AS ga, avg(b) AS gb FROM e GROUP BY 1),
c AS (SELECT e.vec_id, a - x.ra - y.ra + ga AS a, b - x.rb - y.rb + gb AS b FROM e JOIN r x ON e.vec_id = x.vec_id AND e.i = x.i JOIN r y ON e.vec_id = y.vec_id AND e.j = y.i JOIN g ON e.vec_id = g.vec_id),
d AS (SELECT vec_id, sqrt(greatest(avg(a * b), 0) / sqrt(avg(a * a) * avg(b * b))) AS d FROM c GROUP BY 1)
SELECT vec_id, round(w, 5) AS wasserstein, round(d, 5) AS distance_correlation FROM w JOIN d USING (vec_id)""")
def vector_distances(spark, sf_dir):
    """Each vector and the next one as samples."""
    v = table(spark, sf_dir, "embeddings")
    pairs = v.select("vec_id", F.col("embedding").alias("u")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("v")), "vec_id")
    return comparisons.compared(pairs, "u", "v").select("vec_id", F.round("wasserstein", 5).alias("wasserstein"), F.round("distance_correlation", 5).alias("distance_correlation"))


@query(None)
def homogenisation(spark, sf_dir):
    """ROUGE-L of all pairs of a conversation's turns. No SQL: a common subsequence is a fold of folds; tested against the quadratic table."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.col("text").alias("piece"))
    found = comparisons.homogenisation(turns)
    return found.select("doc_id", F.round("homogenisation", 6).alias("homogenisation"), "pairs")


@query(None)
def direct_speech(spark, sf_dir):
    """A stack of quotation marks, tested on fixtures."""
    found = comparisons.direct_speech(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "words", "quoted_words", F.round("directspeech_ratio", 6).alias("directspeech_ratio"))
