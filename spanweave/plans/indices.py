"""Registered queries of text indices, distributions and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanweave.functions import metrics as M
from spanweave.operators import selection, spans
from spanweave.operators.lookup import lookup
from spanweave.plans.queries import _SENT, _WORDS, _words, query, same
from spanweave.session import table

_SENT_WORDS = _SENT + f", sw AS (SELECT doc_id, pos, {_WORDS.replace('text', 'piece')} AS ws FROM sents)"


@query(_SENT_WORDS + """, c AS (SELECT doc_id, len(ws) AS n, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::DOUBLE AS l1, coalesce(list_sum(list_transform(ws, lambda x: length(x) * length(x))), 0)::DOUBLE AS l2 FROM sw),
g AS (SELECT doc_id, count(*) AS n_sentences, cast(sum(n) AS BIGINT) AS n_words, round(avg(n), 6) AS words_mean, round(stddev_pop(n), 6) AS words_sd, sum(l1) AS l1, sum(l2) AS l2 FROM c GROUP BY doc_id)
SELECT doc_id, n_sentences, n_words, words_mean, words_sd, round(l1 / nullif(n_words, 0), 6) AS letters_mean, round(sqrt(greatest(l2 / nullif(n_words, 0) - (l1 / nullif(n_words, 0)) * (l1 / nullif(n_words, 0)), 0)), 5) AS letters_sd FROM g""")
def descriptive_indices(spark, sf_dir):
    s = spans.sentences(table(spark, sf_dir, "documents")).select("doc_id", _words("piece").alias("ws"))
    total = lambda f: F.aggregate("ws", F.lit(0), lambda a, x: a + f(F.char_length(x))).cast("double")
    c = s.select("doc_id", F.size("ws").alias("n"), total(lambda x: x).alias("l1"), total(lambda x: x * x).alias("l2"))
    g = c.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum("n").alias("n_words"), F.round(F.avg("n"), 6).alias("words_mean"), F.round(F.stddev_pop("n"), 6).alias("words_sd"), F.sum("l1").alias("l1"), F.sum("l2").alias("l2"))
    some = F.nullif("n_words", F.lit(0))
    mean = F.col("l1") / some
    sd = F.when(some.isNotNull(), F.sqrt(F.greatest(F.col("l2") / some - mean * mean, F.lit(0.0)))).otherwise(F.lit(0.0))
    return g.select("doc_id", "n_sentences", "n_words", "words_mean", "words_sd", F.round(mean, 6).alias("letters_mean"), F.round(sd, 5).alias("letters_sd"))


@query(_SENT_WORDS + " SELECT doc_id, count(*) AS n_sentences, cast(count(*) FILTER (WHERE len(ws) BETWEEN 1 AND 150) AS BIGINT) AS n_eligible FROM sw GROUP BY doc_id")
def sentence_eligibility(spark, sf_dir):
    s = spans.sentences(table(spark, sf_dir, "documents")).select("doc_id", F.size(_words("piece")).alias("n"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.count_if(F.col("n").between(1, 150)).alias("n_eligible"))


@query(_SENT_WORDS + """, n AS (SELECT doc_id, count(*) AS n_sets FROM sw GROUP BY doc_id), w AS (SELECT doc_id, unnest(list_distinct(ws)) AS word FROM sw),
k AS (SELECT doc_id, word, count(*) AS k FROM w GROUP BY 1, 2), m AS (SELECT doc_id, sum(k * (k - 1))::DOUBLE AS shared FROM k GROUP BY doc_id)
SELECT doc_id, n_sets, CASE WHEN n_sets > 1 THEN round(coalesce(shared, 0) / (n_sets * (n_sets - 1)), 6) END AS shared_mean FROM n LEFT JOIN m USING (doc_id)""")
def sentence_pair_overlap(spark, sf_dir):
    s = spans.sentences(table(spark, sf_dir, "documents")).select("doc_id", _words("piece").alias("ws"))
    return selection.shared_items(s).select("doc_id", "n_sets", F.round("shared_mean", 6).alias("shared_mean"))


@query(_SENT_WORDS + """, w AS (SELECT doc_id, pos, unnest(ws) AS word FROM sw), f AS (SELECT word, count(*) AS n FROM w GROUP BY word), r AS (SELECT doc_id, pos, min(ln(n + 1e-5::DOUBLE)) AS rarest FROM w JOIN f USING (word) GROUP BY 1, 2)
SELECT doc_id, round(avg(rarest), 6) AS rarest_mean FROM r GROUP BY doc_id""")
def rarest_word(spark, sf_dir):
    s = spans.sentences(table(spark, sf_dir, "documents")).select("doc_id", "pos", F.explode(F.array_distinct(_words("piece"))).alias("word"))
    counts = table(spark, sf_dir, "documents").select(F.explode(_words()).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    rarest = lookup(s, counts, "word").groupBy("doc_id", "pos").agg(F.min(M.smoothed_log(F.coalesce("n", F.lit(0)))).alias("rarest"))
    return rarest.groupBy("doc_id").agg(F.round(F.avg("rarest"), 6).alias("rarest_mean"))


@query(_SENT + """ SELECT 'text' AS type, count(*) AS n, cast(sum(length(text)) AS BIGINT) AS chars FROM documents UNION ALL SELECT 'sentence', count(*), cast(sum(length(piece)) AS BIGINT) FROM sents
UNION ALL SELECT 'paragraph', count(*), cast(sum(length(p)) AS BIGINT) FROM (SELECT unnest(string_split(text, chr(10))) AS p FROM documents)""")
def multi_type_selection(spark, sf_dir):
    picked = selection.select_spans(table(spark, sf_dir, "documents"), "text, sentence, paragraph")
    return picked.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("begin")).alias("chars"))


@query(r"""SELECT doc_id, cast(length(text) - length(replace(text, '-' || chr(10), '')) AS BIGINT) AS removed, sha256(replace(text, '-' || chr(10), '')) AS joined FROM documents""")
def dehyphenation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", M.dehyphenate(F.col("text")).alias("t"))
    return d.select("doc_id", (F.char_length("text") - F.char_length("t")).cast("long").alias("removed"), F.sha2("t", 256).alias("joined"))


@query(r"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS w FROM documents)
SELECT doc_id, count(*) AS n, cast(count(*) FILTER (WHERE regexp_replace(w, '^\p{P}+|\p{P}+$', '', 'g') = '') AS BIGINT) AS n_punct FROM w GROUP BY doc_id""")
def punctuation_tokens(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(F.split("text", " "), lambda x: x != "")).alias("w"))
    return w.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(M.strip_edge_punctuation(F.col("w")) == "").alias("n_punct"))


@query("""WITH p AS (SELECT n_name AS name, lag(n_name) OVER (ORDER BY n_nationkey) AS prev FROM nation)
SELECT name, round(levenshtein(name, prev)::DOUBLE / greatest(length(name), length(prev)), 6) AS distance FROM p WHERE prev IS NOT NULL""")
def normalised_edit_distance(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    before = n.select((F.col("n_nationkey") + 1).alias("n_nationkey"), F.col("n_name").alias("prev"))
    return n.join(before, "n_nationkey").select(F.col("n_name").alias("name"), F.round(M.normalised_levenshtein(F.col("n_name"), F.col("prev")), 6).alias("distance"))


@query("""SELECT vec_id, round(1 / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))), 6) AS top FROM embeddings""")
def softmax_top(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.select("vec_id", F.round(F.array_max(M.softmax(F.col("x"))), 6).alias("top"))


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings) SELECT vec_id, cast(pos // 50 AS BIGINT) AS chunk, count(*) AS n, round(sum(x), 4) AS total FROM v GROUP BY 1, 2""")
def array_chunks(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return v.groupBy("vec_id", F.floor(F.col("pos") / 50).cast("long").alias("chunk")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("x").cast("double")), 4).alias("total"))


_SHARES = """WITH u AS (SELECT user_id, event_type, cast(count(*) AS DOUBLE) AS n FROM events GROUP BY user_id, event_type),
g AS (SELECT event_type, sum(n) / (SELECT count(*) FROM events) AS q FROM u GROUP BY event_type),
p AS (SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id) AS p FROM u),
j AS (SELECT user_id, p, q, (p + q) / 2 AS m FROM p JOIN g ON p.event_type = g.event_type)
SELECT user_id, round(abs(sum(0.5 * p * ln(p / m) + 0.5 * q * ln(q / m)) + 0.5 * ln(2) * (1 - sum(q))), 6) AS jensen_shannon, round(sum(sqrt(p * q)), 6) AS bhattacharyya FROM j GROUP BY user_id"""
same("label_distances", _SHARES, "events")
same("complete_runs", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)", "events")
same("page_of_documents", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100", "documents")
same("url_parts", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages", "pages")
same("case_folded_sum", "SELECT lower(role) AS role, count(*) AS n, sum(turn) AS turns FROM conversations GROUP BY lower(role)", "conversations", oracle="SELECT lower(role) AS role, count(*) AS n, cast(sum(turn) AS BIGINT) AS turns FROM conversations GROUP BY lower(role)")
