"""Registered queries of the annotation engine, each with its SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanweave.functions import metrics as M
from spanweave.functions.readability import FORMULAS
from spanweave.operators import matching, spans, text_measures
from spanweave.session import table, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def same(name: str, sql: str, *tables: str, oracle: str | None = None) -> None:
    """A plan that is plain SQL in both engines."""
    QUERIES[name] = lambda spark, sf_dir: (views(spark, sf_dir, *tables), spark.sql(sql))[1]
    ORACLE[name] = oracle or sql


_SENT = r"""
WITH pieces AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]*[.!?]+|[^.!?]+$')) AS piece, unnest(range(len(regexp_extract_all(text, '[^.!?]*[.!?]+|[^.!?]+$')))) AS pos FROM documents
), sents AS (
  SELECT doc_id, pos, piece, cast(coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM pieces
)"""


@query(_SENT + " SELECT doc_id, pos, b AS begin_at, b + length(piece) AS end_at FROM sents")
def sentence_spans(spark, sf_dir):
    return spans.sentences(table(spark, sf_dir, "documents")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("begin").alias("begin_at"), F.col("end").alias("end_at"))


@query(_SENT + r""", tok AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^ \t\n\r]+|[ \t\n\r]+')) AS piece, unnest(range(len(regexp_extract_all(text, '[^ \t\n\r]+|[ \t\n\r]+')))) AS pos FROM documents
), toks AS (
  SELECT doc_id, pos, piece, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM tok
)
SELECT s.doc_id, s.pos AS sentence, count(*) AS n_tokens FROM sents s JOIN (SELECT * FROM toks WHERE regexp_matches(piece, '[^ \t\n\r]')) t
ON s.doc_id = t.doc_id AND t.b >= s.b AND t.b + length(t.piece) <= s.b + length(s.piece) GROUP BY 1, 2""")
def containment_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    joined = spans.contained(spans.sentences(docs), spans.tokens(docs))
    return joined.groupBy(F.col("o_doc_id").alias("doc_id"), F.col("o_pos").cast("long").alias("sentence")).agg(F.count("*").alias("n_tokens"))


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS piece, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
SELECT doc_id, pos, cast(coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin_at, length(piece) AS n_chars FROM p""")
def paragraph_spans(spark, sf_dir):
    p = spans.paragraphs(table(spark, sf_dir, "documents"))
    return p.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("begin").alias("begin_at"), (F.col("end") - F.col("begin")).alias("n_chars"))


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^a-zäöüáéíóúñàèêôûçß]+'), lambda x: x <> '')"


def _words(text="text"):
    return F.filter(F.split(F.lower(text), "[^a-zäöüáéíóúñàèêôûçß]+"), lambda w: w != "")


_SCORES = {"flesch": "flesch_reading_ease", "kincaid": "flesch_kincaid_grade", "fog": "gunning_fog", "smog": "smog_index", "ari": "automated_readability_index", "coleman_liau": "coleman_liau_index", "lix": "lix", "rix": "rix", "wstf": "wiener_sachtextformel_1"}


@query(f"""WITH w0 AS (SELECT doc_id, {_WORDS} AS ws, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS s FROM documents),
c AS (SELECT doc_id, s::DOUBLE AS s, len(ws)::DOUBLE AS w, list_sum(list_transform(ws, lambda x: length(x)))::DOUBLE AS chars,
 list_sum(list_transform(ws, lambda x: greatest(len(regexp_extract_all(x, '[aeiouyäöüáéíóúàèêôû]+')), 1)))::DOUBLE AS syll, len(list_filter(ws, lambda x: greatest(len(regexp_extract_all(x, '[aeiouyäöüáéíóúàèêôû]+')), 1) = 1))::DOUBLE AS mono,
 len(list_filter(ws, lambda x: length(x) > 6))::DOUBLE AS long7, len(list_filter(ws, lambda x: greatest(len(regexp_extract_all(x, '[aeiouyäöüáéíóúàèêôû]+')), 1) >= 3))::DOUBLE AS poly FROM w0 WHERE len(ws) > 0)
SELECT doc_id, {", ".join(f"({FORMULAS[f]})::DOUBLE AS {k}" for k, f in _SCORES.items())} FROM c""")
def readability_scores(spark, sf_dir):
    counts = text_measures.text_counts(table(spark, sf_dir, "documents"), [])
    return counts.select("doc_id", *[F.expr(FORMULAS[f]).cast("double").alias(k) for k, f in _SCORES.items()])


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents)
SELECT doc_id, len(ws) AS n_words, len(list_distinct(ws)) AS n_types, CASE WHEN len(ws) = 0 THEN 0.0 ELSE round(len(list_distinct(ws))::DOUBLE / len(ws), 6) END AS ttr,
 CASE WHEN len(ws) = 0 THEN 0.0 ELSE round(len(list_distinct(ws)) / sqrt(len(ws)::DOUBLE), 6) END AS root_ttr FROM w""")
def lexical_diversity(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", _words().alias("ws"))
    n, t = F.size("ws").cast("long"), F.size(F.array_distinct("ws")).cast("long")
    return d.select("doc_id", n.alias("n_words"), t.alias("n_types"), F.round(M.safe_ratio(t, n), 6).alias("ttr"), F.round(M.safe_ratio(t, F.sqrt(n)), 6).alias("root_ttr"))


@query(_SENT + f""", s AS (SELECT doc_id, pos, list_distinct({_WORDS.replace("text", "piece")}) AS ws FROM sents),
p AS (SELECT doc_id, ws, lag(ws) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM s)
SELECT doc_id, round(avg(CASE WHEN len(list_distinct(list_concat(ws, prev))) = 0 THEN 0.0 ELSE len(list_intersect(ws, prev))::DOUBLE / len(list_distinct(list_concat(ws, prev))) END), 6) AS overlap_mean,
 round(stddev_pop(CASE WHEN len(list_distinct(list_concat(ws, prev))) = 0 THEN 0.0 ELSE len(list_intersect(ws, prev))::DOUBLE / len(list_distinct(list_concat(ws, prev))) END), 6) AS overlap_sd
FROM p WHERE prev IS NOT NULL GROUP BY doc_id""")
def adjacent_overlap(spark, sf_dir):
    s = spans.sentences(table(spark, sf_dir, "documents")).select("doc_id", "pos", F.array_distinct(_words("piece")).alias("ws"))
    s = s.withColumn("prev", F.lag("ws").over(W.partitionBy("doc_id").orderBy("pos"))).where("prev is not null")
    j = M.safe_ratio(F.size(F.array_intersect("ws", "prev")), F.size(F.array_union("ws", "prev")))
    return s.groupBy("doc_id").agg(F.round(F.avg(j), 6).alias("overlap_mean"), F.round(F.stddev_pop(j), 6).alias("overlap_sd"))


@query(f"""WITH w AS (SELECT unnest({_WORDS}) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) > 1""")
def word_frequencies(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(_words()).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")


@query(f"""WITH w AS (SELECT unnest({_WORDS}) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word""")
def all_word_frequencies(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(_words()).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


_EACH = r"SELECT {k}, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS phrase FROM {t}"


@query(f"""WITH d AS (SELECT phrase, min(item_id) AS entry FROM ({_EACH.format(k='item_id', t='benchmark')}) GROUP BY phrase), w AS ({_EACH.format(k='doc_id', t='documents')})
SELECT doc_id, entry, count(*) AS hits FROM w JOIN d USING (phrase) GROUP BY 1, 2""")
def gazetteer_tagger(spark, sf_dir):
    """Every word of the items in the whole texts."""
    entries = matching.phrases(table(spark, sf_dir, "benchmark"), 1, "item_id").groupBy("phrase").agg(F.min("item_id").alias("entry"))
    return matching.tag(table(spark, sf_dir, "documents"), entries, 1).groupBy("doc_id", "entry").agg(F.count("*").alias("hits"))


_GRAMS = r"""SELECT {k}, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS phrase FROM (
 SELECT {k}, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT {k}, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM {t}), (VALUES (1), (2), (3)) v(n))"""


@query(f"""WITH d AS (SELECT phrase, min(item_id) AS entry FROM ({_GRAMS.format(k='item_id', t='benchmark')}) GROUP BY phrase),
w AS ({_GRAMS.format(k='doc_id', t='documents')})
SELECT doc_id, entry, count(*) AS hits FROM w JOIN d USING (phrase) GROUP BY 1, 2""")
def gazetteer_phrases(spark, sf_dir):
    """Every phrase of one to three words of the items in the whole texts."""
    entries = matching.phrases(table(spark, sf_dir, "benchmark"), 3, "item_id").groupBy("phrase").agg(F.min("item_id").alias("entry"))
    return matching.tag(table(spark, sf_dir, "documents"), entries, 3).groupBy("doc_id", "entry").agg(F.count("*").alias("hits"))


_ASCII = r"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM {t}"


@query(f"""WITH a AS ({_ASCII.format(t='conversations')}), b AS ({_ASCII.format(t='benchmark')})
SELECT a.word AS a, b.word AS b, cast(levenshtein(a.word, b.word) AS BIGINT) AS distance FROM a JOIN b ON length(a.word) = length(b.word) AND hamming(a.word, b.word) <= 1
UNION ALL SELECT a.word, b.word, 1 FROM a JOIN b ON abs(length(a.word) - length(b.word)) = 1 AND levenshtein(a.word, b.word) = 1""")
def fuzzy_dictionary_join(spark, sf_dir):
    """Every run of ASCII letters of the conversations against every one of the items."""
    pick = lambda t: table(spark, sf_dir, t).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).distinct()
    return matching.fuzzy(pick("conversations"), pick("benchmark")).select("a", "b", F.col("distance").cast("long").alias("distance"))


@query(None)
def fuzzy_dictionary_words(spark, sf_dir):
    """Every word of the conversations against every word of the items. No SQL: DuckDB's levenshtein counts bytes."""
    pick = lambda t: table(spark, sf_dir, t).select(F.explode(matching.tokens(F.col("text"))).alias("word")).distinct()
    return matching.fuzzy(pick("conversations"), pick("benchmark")).select("a", "b", F.col("distance").cast("long").alias("distance"))


@query("""WITH n AS (SELECT n_name, n_nationkey FROM nation) SELECT n_name AS name, n_nationkey AS value, 'exact' AS stage FROM n
UNION ALL SELECT n_name || 'x', n_nationkey, 'fuzzy' FROM n WHERE length(n_name) >= 4""")
def two_stage_match(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    left = n.select(F.initcap("n_name").alias("probe"), "n_name").select(F.col("n_name").alias("name")).union(n.select(F.concat("n_name", F.lit("x"))))
    return matching.two_stage(left, n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("value")))


@query(None)
def two_stage_match_edits(spark, sf_dir):
    """Probes of two edits: the names with a letter more within and one at the end, whether near enough or not."""
    n = table(spark, sf_dir, "nation")
    left = n.select(F.concat(F.expr("left(n_name, 1)"), F.lit("q"), F.expr("substring(n_name, 2)"), F.lit("q")).alias("name"))
    return matching.two_stage(left, n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("value")))


@query("""SELECT n_nationkey AS id, 'nation' AS provider, cast(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT n_nationkey, 'region', cast(n_regionkey AS VARCHAR), r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 1""")
def provider_lookup(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    even = F.col("n_nationkey") % 2 == 0
    links = n.select(F.col("n_nationkey").alias("id"), F.when(even, F.concat(F.lit("NATION:"), "n_nationkey")).otherwise(F.concat(F.lit("region:"), "n_regionkey")).alias("linking"))
    return matching.resolve(links, {"nation": n.select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name")), "region": r.select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("name"))})


_MAIL = r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]+"


@query(rf"SELECT doc_id, sha256(regexp_replace(text, '{_MAIL}', '<REDACTED>', 'g')) AS redacted, cast(len(regexp_extract_all(text, '{_MAIL}')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '{_MAIL}')")
def redaction(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(_MAIL))
    return d.select("doc_id", F.sha2(F.regexp_replace("text", _MAIL, "<REDACTED>"), 256).alias("redacted"), F.size(F.regexp_extract_all("text", F.lit(_MAIL), 0)).cast("long").alias("n"))


@query("""WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_cosine_similarity(x, y), 6) AS cosine, round(list_distance(x, y), 6) AS euclidean FROM p""")
def embedding_distances(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    p = e.select("vec_id", F.col("embedding").alias("x")).join(b, "vec_id")
    return p.select("vec_id", F.round(M.cosine(F.col("x"), F.col("y")), 6).alias("cosine"), F.round(M.euclidean(F.col("x"), F.col("y")), 6).alias("euclidean"))


@query("""WITH v AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) SELECT label, pos, round(avg(x::DOUBLE), 5) AS mean FROM v GROUP BY 1, 2""")
def vector_mean(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return v.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query(_SENT + """, c AS (SELECT doc_id, pos, length(piece) AS n FROM sents) SELECT doc_id, count(*) AS n_sentences, cast(sum(n) AS BIGINT) AS n_chars FROM c GROUP BY doc_id""")
def chunk_packing(spark, sf_dir):
    s = spans.sentences(table(spark, sf_dir, "documents"))
    c = spans.pack_consecutive(s, 800).join(s.select("doc_id", "pos", "piece"), ["doc_id", "pos"])
    sizes = c.groupBy("doc_id", "chunk").agg(F.count("*").alias("k"), F.sum(F.char_length("piece")).alias("n"))
    return sizes.groupBy("doc_id").agg(F.sum("k").alias("n_sentences"), F.sum("n").alias("n_chars"))


@query(_SENT.replace("WITH", "WITH RECURSIVE", 1) + """, s AS MATERIALIZED (SELECT doc_id, pos, length(piece) AS n FROM sents), c AS (
  SELECT doc_id, pos, n, 0 AS chunk, n AS held FROM s WHERE pos = 0
  UNION ALL SELECT s.doc_id, s.pos, s.n, CASE WHEN held + s.n <= 800 THEN chunk ELSE chunk + 1 END, CASE WHEN held + s.n <= 800 THEN held + s.n ELSE s.n END FROM c JOIN s ON s.doc_id = c.doc_id AND s.pos = c.pos + 1
) SELECT doc_id, chunk, count(*) AS n_sentences, cast(sum(n) AS BIGINT) AS n_chars FROM c GROUP BY doc_id, chunk""")
def chunk_packing_chunks(spark, sf_dir):
    """One row a chunk of at most 800 characters, or of one longer sentence."""
    s = spans.sentences(table(spark, sf_dir, "documents"))
    c = spans.pack_consecutive(s, 800).join(s.select("doc_id", "pos", "piece"), ["doc_id", "pos"])
    return c.groupBy("doc_id", "chunk").agg(F.count("*").alias("n_sentences"), F.sum(F.char_length("piece")).alias("n_chars"))


same("speech_spans", """SELECT conv_id, turn, role, cast(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin_at,
 coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS next_turn FROM conversations""", "conversations")
same("selection_average", """SELECT user_id, event_type, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY GROUPING SETS ((user_id, event_type), (user_id))""", "events")
same("polarity", """SELECT user_id, round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) - sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END), 4) AS polarity FROM events GROUP BY user_id""", "events")
same("cue_groups", """SELECT user_id, grp, count(*) AS n FROM (SELECT user_id, greatest(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS grp FROM events) GROUP BY user_id, grp""", "events",
     oracle="""SELECT user_id, cast(grp AS BIGINT) AS grp, count(*) AS n FROM (SELECT user_id, greatest(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS grp FROM events) GROUP BY user_id, grp""")
same("top_label", """SELECT user_id, event_type AS label FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY sum(value) DESC, event_type) AS rn FROM events GROUP BY user_id, event_type) WHERE rn = 1""", "events")
same("normalised_share", """SELECT user_id, event_type, round(sum(value) / sum(sum(value)) OVER (PARTITION BY user_id), 6) AS share FROM events GROUP BY user_id, event_type""", "events")
same("mode_share", """SELECT user_id, round(max(n) * 1.0 / sum(n), 4) AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id""", "events",
     oracle="""SELECT user_id, round(max(n)::DOUBLE / sum(n), 4) AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id""")
QUERIES["mode_share"] = lambda spark, sf_dir: (views(spark, sf_dir, "events"), spark.sql("SELECT user_id, round(cast(max(n) AS DOUBLE) / sum(n), 4) AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id"))[1]
same("dedupe_best", """SELECT user_id, event_type, max(value) AS score FROM events GROUP BY user_id, event_type""", "events")
same("document_labels", """SELECT d.doc_id, d.lang, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""", "documents", "labels")
same("unlabelled", """SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels""", "documents", "labels")
same("labelled", """SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels""", "documents", "labels")
same("graph_edges", """SELECT r_name AS source, n_name AS target, 'contains' AS label FROM region JOIN nation ON r_regionkey = n_regionkey UNION ALL SELECT n_name, s_name, 'contains' FROM nation JOIN supplier ON n_nationkey = s_nationkey""", "region", "nation", "supplier")
same("recursive_closure", """WITH RECURSIVE e AS (SELECT n_nationkey AS child, n_nationkey % 5 AS parent FROM nation WHERE n_nationkey >= 5), c(root, node) AS (SELECT parent, child FROM e UNION ALL SELECT c.root, e.child FROM c JOIN e ON e.parent = c.node) SELECT root, node FROM c""", "nation")
same("tumbling_windows", """SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2""", "events")
same("json_property", """SELECT event_id, cast(get_json_object(props, '$.k') AS BIGINT) AS k FROM events""", "events", oracle="""SELECT event_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
same("page_titles", r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""", "pages")
