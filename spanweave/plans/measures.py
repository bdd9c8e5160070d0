"""Registered queries of readability, word usage, Coh-Metrix and second-language indices, on rule-tagged tokens of the documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.functions import readability as R
from spanweave.operators import cohesion, dependencies, tagging, text_measures
from spanweave.plans.queries import _SENT, _WORDS, query
from spanweave.session import table
from spanweave.workspace import Workspace

EASY = sorted({w for words in R.USAGE.values() for w in words})
_Y = "[aeiouyäöüáéíóúàèêôû]+"
_SYLL = f"greatest(len(regexp_extract_all(x, '{_Y}')), 1)"
_LIST = "[" + ", ".join(f"'{w}'" for w in EASY) + "]"
_HEAD = "array_to_string(list_slice(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> ''), 1, 100), ' ')"
_COUNTS = f"""WITH h0 AS (SELECT doc_id, text, {_HEAD} AS head FROM documents), w0 AS (SELECT doc_id, text AS t, {_WORDS} AS ws, head, {_WORDS.replace('text', 'head')} AS hs FROM h0),
c AS (SELECT doc_id, ws, len(hs)::DOUBLE AS w100, greatest(len(regexp_extract_all(head, '[.!?]+')), 1)::DOUBLE AS s100, len(list_filter(hs, lambda x: {_SYLL} >= 3))::DOUBLE AS poly100, len(ws)::DOUBLE AS w, greatest(len(regexp_extract_all(t, '[.!?]+')), 1)::DOUBLE AS s, greatest(len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')), 1)::DOUBLE AS p,
 list_sum(list_transform(ws, lambda x: length(x)))::DOUBLE AS chars, list_sum(list_transform(ws, lambda x: {_SYLL}))::DOUBLE AS syll, len(list_filter(ws, lambda x: {_SYLL} = 1))::DOUBLE AS mono,
 len(list_filter(ws, lambda x: {_SYLL} >= 3))::DOUBLE AS poly, len(list_filter(ws, lambda x: length(x) > 6))::DOUBLE AS long7, len(list_filter(ws, lambda x: {_SYLL} >= 2 AND NOT list_contains({_LIST}, x)))::DOUBLE AS hard,
 len(list_filter(ws, lambda x: length(x) <= 3))::DOUBLE AS mini, length(regexp_replace(t, '[ \\t\\n\\r]', '', 'g'))::DOUBLE AS body, len(list_distinct(ws))::DOUBLE AS types FROM w0 WHERE len(ws) > 0)"""


def _union(source: str, values: dict[str, str], error: bool = True) -> str:
    """Long rows of a wide source, as cohesion.rows_of gives them, rounded."""
    tail = ", CASE WHEN v IS NULL THEN 'no value' END AS error" if error else ""
    return " UNION ALL ".join(f"SELECT doc_id, '{k}' AS label, round(v, 6) AS value{tail} FROM (SELECT doc_id, ({v})::DOUBLE AS v FROM {source})" for k, v in values.items())


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6))


def _docs(spark, sf_dir) -> DataFrame:
    """The texts, dealt over the tasks: what is made out of a text takes long, and a file may have few parts. The number of parts is given, since Spark would
    put parts that are small in bytes together, to hardly more than one a core, and the longest would be waited for."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return table(spark, sf_dir, "documents").select("doc_id", "text").repartition(parts, "doc_id")


def _tokens(spark, sf_dir) -> DataFrame:
    """The token rows of a folder's documents, tagged once an application and written; every later query reads the table."""
    context = spark.sparkContext
    held = context.__dict__.setdefault("_spanweave_tokens", {})
    if sf_dir not in held:
        made = Workspace(spark, "tokens").write(tagging.rule_tokens(_docs(spark, sf_dir)), "rows")
        held[sf_dir] = made._spanweave_path, made.schema
    path, schema = held[sf_dir]
    return spark.read.schema(schema).parquet(path)


def _sentences(spark, sf_dir, *fields: str) -> DataFrame:
    """The sentence rows of a folder's documents with some fields of their tokens, made out of the documents' rows."""
    return tagging.rule_sentences(_docs(spark, sf_dir), fields)


@query(_COUNTS + " " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS label, ({f})::DOUBLE AS value, CAST(NULL AS VARCHAR) AS error FROM c" for k, f in R.FORMULAS.items()))
def readability_measures(spark, sf_dir):
    return text_measures.readability_rows(table(spark, sf_dir, "documents"), EASY)


@query(_COUNTS + ", g AS (SELECT doc_id, unnest([" + ", ".join(f"floor(x{i})" for i in range(7)) + ", " + ", ".join(f"ceil(x{i})" for i in range(7)) + "])::BIGINT AS grade FROM (SELECT doc_id, " + ", ".join(f"({R.FORMULAS[k]})::DOUBLE AS x{i}" for i, k in enumerate(R.GRADES)) + " FROM c)), n AS (SELECT doc_id, grade, count(*) AS n FROM g GROUP BY 1, 2) SELECT doc_id, grade FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, grade) = 1")
def text_standard(spark, sf_dir):
    return text_measures.text_standard(table(spark, sf_dir, "documents"), EASY)


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(f"WITH w0 AS (SELECT doc_id, {_WORDS} AS ws FROM documents) " + " UNION ALL ".join([f"SELECT doc_id, '{k}' AS label, len(list_filter(ws, lambda x: x IN {_in(v)})) AS n FROM w0 WHERE len(ws) > 0" for k, v in R.USAGE.items()] + [f"SELECT doc_id, 'nominalizations', len(list_filter(ws, lambda x: regexp_matches(x, '{R.NOMINAL[0]}') AND length(x) >= {R.NOMINAL[1]})) FROM w0 WHERE len(ws) > 0"]))
def word_usage(spark, sf_dir):
    return text_measures.word_usage(table(spark, sf_dir, "documents"))


@query(_SENT + f", f AS (SELECT doc_id, ({_WORDS.replace('text', 'piece')})[1] AS w FROM sents) " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS label, count(*) FILTER (WHERE w IN {_in(R.USAGE[k])}) AS n FROM f GROUP BY doc_id" for k in ("pronouns", "interrogatives", "articles", "subordinations", "conjunctions", "prepositions")))
def sentence_beginnings(spark, sf_dir):
    return text_measures.sentence_beginnings(table(spark, sf_dir, "documents"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS phrase FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(n))),
s AS (SELECT doc_id, n, count(DISTINCT phrase)::DOUBLE / count(*) AS share FROM g GROUP BY 1, 2) SELECT doc_id, round(sum(share), 6) AS value FROM s GROUP BY doc_id""")
def ngram_diversity(spark, sf_dir):
    return _rounded(text_measures.ngram_diversity(table(spark, sf_dir, "documents")))


_TOK = "WITH RECURSIVE " + tagging.SQL
_LETTERS = r"length(regexp_replace(text, '[^\p{L}]', '', 'g'))"
_ALPHA = r"regexp_matches(text, '^\p{L}+$')"
_N = lambda k: f"{k} / nullif(DESWC, 0)"
_SD = lambda s2, s, n: f"sqrt(greatest({s2} / nullif({n}, 0) - ({s} / nullif({n}, 0)) * ({s} / nullif({n}, 0)), 0))"


@query(_TOK + f""", s AS (SELECT doc_id, para, sent, sum(CASE WHEN NOT is_punct THEN 1 ELSE 0 END)::DOUBLE AS w, sum(CASE WHEN NOT is_punct THEN {_LETTERS} ELSE 0 END)::DOUBLE AS l, sum(CASE WHEN NOT is_punct THEN {_LETTERS} * {_LETTERS} ELSE 0 END)::DOUBLE AS l2,
 sum(CASE WHEN NOT is_punct THEN {_SYLL.replace('(x,', '(text,')} ELSE 0 END)::DOUBLE AS y, sum(CASE WHEN NOT is_punct THEN {_SYLL.replace('(x,', '(text,')} * {_SYLL.replace('(x,', '(text,')} ELSE 0 END)::DOUBLE AS y2 FROM tok GROUP BY 1, 2, 3),
p AS (SELECT doc_id, para, count(*) AS k, sum(w) AS w, sum(w * w) AS w2, sum(l) AS l, sum(l2) AS l2, sum(y) AS y, sum(y2) AS y2 FROM s GROUP BY 1, 2),
d AS (SELECT doc_id, count(*) AS DESPC, sum(k) AS DESSC, sum(w) AS DESWC, avg(k) AS DESPL, stddev_pop(k) AS DESPLd, sum(w2) AS w2, sum(l) AS l, sum(l2) AS l2, sum(y) AS y, sum(y2) AS y2 FROM p GROUP BY 1) """
       + _union("d", {"DESPC": "DESPC", "DESSC": "DESSC", "DESWC": "DESWC", "DESPL": "DESPL", "DESPLd": "DESPLd", "DESSL": "DESWC / DESSC", "DESSLd": _SD("w2", "DESWC", "DESSC"), "DESWLsy": _N("y"), "DESWLsyd": _SD("y2", "y", "DESWC"), "DESWLlt": _N("l"), "DESWLltd": _SD("l2", "l", "DESWC")}))
def cohmetrix_descriptive(spark, sf_dir):
    return _rounded(cohesion.descriptive(_tokens(spark, sf_dir)))


_COARSE = {"WRDNOUN": "pos_coarse IN ('NOUN', 'PROPN')", "WRDVERB": "pos_coarse = 'VERB'", "WRDADJ": "pos_coarse = 'ADJ'", "WRDADV": "pos_coarse = 'ADV'", "WRDPRO": "pos_coarse = 'PRON'"}
_COARSE |= {k: f"pos_coarse = 'PRON' AND text IN {_in(v)}" for k, v in cohesion.PERSONS.items()}
_CONTENT = "pos_coarse IN ('NOUN', 'VERB', 'ADJ', 'ADV')"


@query(_TOK + f""", d AS (SELECT doc_id, count(*) FILTER (WHERE NOT is_punct) AS w, {", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in _COARSE.items())},
 count(DISTINCT CASE WHEN {_ALPHA} THEN lower(text) END) AS t, count(*) FILTER (WHERE {_ALPHA}) AS tw, count(DISTINCT CASE WHEN {_CONTENT} AND {_ALPHA} THEN lower(lemma) END) AS ct, count(*) FILTER (WHERE {_CONTENT} AND {_ALPHA}) AS cn, count(tense) AS tn,
 greatest(count(*) FILTER (WHERE tense = 'Past'), count(*) FILTER (WHERE tense = 'Pres'), count(*) FILTER (WHERE tense = 'Inf')) AS tm FROM tok GROUP BY doc_id) """
       + _union("d", {k: f"1000 * {k}::DOUBLE / nullif(w, 0)" for k in _COARSE} | {"LDTTRa": "t::DOUBLE / nullif(tw, 0)", "LDTTRc": "ct::DOUBLE / nullif(cn, 0)", "SMTEMP": "tm::DOUBLE / nullif(tn, 0)"}))
def cohmetrix_words(spark, sf_dir):
    return _rounded(cohesion.word_information(_sentences(spark, sf_dir, "text", "lemma", "pos_coarse", "is_punct", "tense")))


_DENSE = {
    "DRNP": "pos_coarse IN ('NOUN', 'PROPN') AND coalesce(nx, '') NOT IN ('NOUN', 'PROPN')", "DRVP": "pos_coarse = 'VERB'", "DRAP": "pos_coarse = 'ADV'", "DRPP": "pos_coarse = 'ADP'",
    "DRNEG": "dep_type IN ('NEG', 'NG')", "DRGERUND": "tag = 'VBG'", "DRINF": "text IN ('to', 'zu') AND pos > 0 AND nt IN ('VB', 'VVINF') AND nx = 'VERB'",
}


@query(_TOK + f""", t AS (SELECT *, lead(pos_coarse) OVER x AS nx, lead(tag) OVER x AS nt FROM tok WINDOW x AS (PARTITION BY doc_id, para, sent ORDER BY pos)),
s AS (SELECT doc_id, para, sent, {", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in _DENSE.items())}, max(CASE WHEN upper(dep_type) IN ('AUXPASS', 'NSUBJPASS') THEN 1 ELSE 0 END) AS DRPVAL, count(*) FILTER (WHERE NOT is_punct) AS w FROM t GROUP BY 1, 2, 3),
d AS (SELECT doc_id, {", ".join(f"1000 * sum({k})::DOUBLE / nullif(sum(w), 0) AS {k}" for k in [*_DENSE, "DRPVAL"])} FROM s GROUP BY doc_id) """ + _union("d", {k: k for k in [*_DENSE, "DRPVAL"]}))
def cohmetrix_densities(spark, sf_dir):
    return _rounded(cohesion.densities(_tokens(spark, sf_dir)))


#: DuckDB's levenshtein counts bytes, so its words are spelt with one byte a letter: those of Latin-1 as letters and marks that lower-case words lack.
_LATIN = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ[]^_{}"
_GATHER = f""", g AS (SELECT doc_id, para, sent, row_number() OVER (PARTITION BY doc_id ORDER BY para, sent) AS n, list_distinct(list(text) FILTER (WHERE pos_coarse IN ('NOUN', 'PROPN'))) AS nouns, list_distinct(list(lemma) FILTER (WHERE pos_coarse IN ('NOUN', 'PROPN'))) AS stems,
 list_distinct(list(text) FILTER (WHERE pos_coarse = 'PRON')) AS prons, list_distinct(list(lemma) FILTER (WHERE {_CONTENT})) AS content, list_distinct(coalesce(list(dep_type || ' ' || pos_coarse) FILTER (WHERE NOT is_punct), [])) AS syntax,
 string_agg(pos_coarse, ' ' ORDER BY pos) AS p, translate(string_agg(text, ' ' ORDER BY pos), '{_LATIN[0]}', '{_LATIN[1]}') AS x, translate(string_agg(lemma, ' ' ORDER BY pos), '{_LATIN[0]}', '{_LATIN[1]}') AS l, min(CASE WHEN dep_type = 'ROOT' THEN pos END) AS root_at FROM tok GROUP BY doc_id, para, sent),
r AS (SELECT g.doc_id, g.para, g.sent, CASE WHEN min(root_at) IS NOT NULL THEN count(*) FILTER (WHERE NOT is_punct AND tok.pos < root_at) END AS before FROM g JOIN tok ON g.doc_id = tok.doc_id AND g.para = tok.para AND g.sent = tok.sent GROUP BY 1, 2, 3),
e AS (SELECT doc_id, para, n, coalesce(nouns, []) AS nouns, coalesce(stems, []) AS stems, coalesce(prons, []) AS prons, coalesce(content, []) AS content, syntax, p, x, l FROM g)"""


def _jac(c: str) -> str:
    return f"CASE WHEN len(a.{c}) + len(b.{c}) = 0 THEN 0.0 ELSE len(list_intersect(a.{c}, b.{c}))::DOUBLE / (len(a.{c}) + len(b.{c}) - len(list_intersect(a.{c}, b.{c}))) END"


def _edit(c: str) -> str:
    return f"levenshtein(a.{c}, b.{c})::DOUBLE / greatest(length(a.{c}), length(b.{c}))"


_BINARY = {"CRFNO": "len(list_intersect(a.nouns, b.nouns)) > 0", "CRFAO": "len(list_intersect(a.stems, b.stems)) > 0 OR len(list_intersect(a.prons, b.prons)) > 0"}


@query(_TOK + _GATHER + f""", j AS (SELECT a.doc_id, ({_BINARY['CRFNO']})::INT AS no, ({_BINARY['CRFAO']})::INT AS ao, (len(list_intersect(b.stems, a.content)) > 0)::INT AS so, {_jac('content')} AS cw, {_jac('syntax')} AS sy, {_edit('p')} AS dp, {_edit('x')} AS dx, {_edit('l')} AS dl FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.n = a.n + 1),
d AS (SELECT q.doc_id, CRFNO1, CRFAO1, CRFSO1, CRFCWO1, coalesce(SYNSTRUTa, 0) AS SYNSTRUTa, coalesce(SYNMEDpos, 0) AS SYNMEDpos, coalesce(SYNMEDwrd, 0) AS SYNMEDwrd, coalesce(SYNMEDlem, 0) AS SYNMEDlem, CRFCWO1d, coalesce(SYNLE, 0) AS SYNLE FROM (SELECT doc_id, avg(before) AS SYNLE FROM r GROUP BY doc_id) q LEFT JOIN (SELECT doc_id, avg(no) AS CRFNO1, avg(ao) AS CRFAO1, avg(so) AS CRFSO1, avg(cw) AS CRFCWO1, avg(sy) AS SYNSTRUTa, avg(dp) AS SYNMEDpos, avg(dx) AS SYNMEDwrd, avg(dl) AS SYNMEDlem, stddev_pop(cw) AS CRFCWO1d FROM j GROUP BY doc_id) z ON q.doc_id = z.doc_id) """
       + _union("d", {k: k for k in ("CRFNO1", "CRFAO1", "CRFSO1", "CRFCWO1", "SYNSTRUTa", "SYNMEDpos", "SYNMEDwrd", "SYNMEDlem", "CRFCWO1d", "SYNLE")}))
def cohmetrix_adjacent(spark, sf_dir):
    return _rounded(cohesion.adjacent(_sentences(spark, sf_dir, "text", "lemma", "pos_coarse", "dep_type", "is_punct")))


@query(None)
def cohmetrix_all_pairs(spark, sf_dir):
    """No SQL: a join of all pairs of sentences takes minutes. Tested by brute force."""
    return _rounded(cohesion.all_pairs(_sentences(spark, sf_dir, "text", "lemma", "pos_coarse", "dep_type", "is_punct")))


@query(None)
def compression_ratio(spark, sf_dir):
    """gzip has no SQL; tested against the library."""
    return text_measures.compression_ratio(table(spark, sf_dir, "documents"))


@query(None)
def cohmetrix_diversity(spark, sf_dir):
    """MTLD and VOCD: folds over the words in order, tested by brute force."""
    return _rounded(cohesion.ordered_diversity(_sentences(spark, sf_dir, "text", "is_punct")))


#: Connectives and situation-model verbs and particles of the queries (label, phrase), English and German.
LEXICON = {
    "CNCCaus": ["because", "so", "therefore", "as a result", "weil", "deshalb"], "CNCLogic": ["and", "or", "if", "und", "oder"], "CNCADC": ["but", "although", "however", "whereas", "aber"],
    "CNCTemp": ["when", "until", "after", "before"], "CNCTempx": ["first", "second", "finally", "next"], "CNCAdd": ["and", "moreover", "also", "und"], "CNCPos": ["also", "moreover", "and"], "CNCNeg": ["but", "however", "aber"],
    "SMCAUSv": ["make", "cause", "break", "impact"], "SMCAUSvp": ["make", "cause", "break", "because", "so"], "SMINTEp": ["want", "plan", "contact", "buy"],
}
LEXICON["CNCAll"] = sorted({p for k, v in LEXICON.items() if k.startswith("CNC") for p in v})
_LEX = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{p}')" for k, v in LEXICON.items() for p in v) + ") v(label, phrase))"


@query(_TOK + f""", {_LEX}, ws AS (SELECT doc_id, para, sent, list(text ORDER BY pos) FILTER (WHERE NOT is_punct) AS ws FROM tok GROUP BY 1, 2, 3),
gr AS (SELECT doc_id, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS phrase FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM ws, (VALUES (1), (2), (3), (4)) v(n))),
sz AS (SELECT doc_id, sum(len(ws)) AS w FROM ws GROUP BY doc_id), f AS (SELECT doc_id, label, count(*) AS n FROM gr JOIN lex USING (phrase) GROUP BY 1, 2)
SELECT sz.doc_id, k.label, round(1000 * coalesce(n, 0)::DOUBLE / nullif(w, 0), 6) AS value, CASE WHEN nullif(w, 0) IS NULL THEN 'no value' END AS error FROM sz CROSS JOIN (SELECT DISTINCT label FROM lex) k LEFT JOIN f ON f.doc_id = sz.doc_id AND f.label = k.label""")
def cohmetrix_incidences(spark, sf_dir):
    lexicon = spark.createDataFrame([(k, p) for k, v in LEXICON.items() for p in v], "label string, phrase string")
    return _rounded(cohesion.incidences(_sentences(spark, sf_dir, "text", "is_punct"), lexicon))


@query(_TOK + f""", fr AS (SELECT text AS word, count(*)::DOUBLE AS f FROM tok WHERE NOT is_punct GROUP BY text),
j AS (SELECT t.doc_id, t.para, t.sent, ({_CONTENT}) AS c, coalesce(f, 0) AS f, ln(coalesce(f, 0) + 1e-5::DOUBLE) AS lf FROM tok t LEFT JOIN fr ON t.text = fr.word WHERE NOT is_punct),
s AS (SELECT doc_id, sum(CASE WHEN c THEN f END) AS cf, count(*) FILTER (WHERE c) AS cn, sum(lf) AS al, count(*) AS an, min(CASE WHEN c THEN lf END) AS low FROM j GROUP BY doc_id, para, sent),
d AS (SELECT doc_id, sum(cf) / nullif(sum(cn), 0) AS a, sum(al) / sum(an) AS b, avg(low) AS c FROM s GROUP BY doc_id) """ + _union("d", {"WRDFRQc_wiki10000": "a", "WRDFRQa_wiki10000": "b", "WRDFRQmc_wiki10000": "c"}))
def cohmetrix_frequencies(spark, sf_dir):
    """The frequency list is that of the documents' own words; it is written, as tokens are not."""
    words = _sentences(spark, sf_dir, "text", "is_punct").select(F.explode(F.filter("toks", lambda t: ~t["is_punct"])["text"]).alias("word"))
    counts = Workspace(spark, "frequencies").write(words.groupBy("word").agg(F.count("*").alias("f")), "words")
    return _rounded(cohesion.frequency_means(_sentences(spark, sf_dir, "text", "pos_coarse", "is_punct"), counts))


_NORMS = {"WRDAOAc": "aoa", "WRDFAMc": "fam", "WRDCNCc": "cnc", "WRDIMGc": "img", "WRDMEAc": "mea", "WRDPOLc": "pol", "WRDHYPnv": "hyp"}
_RATE = {c: f"CASE WHEN length(word) % {k + 2} > 0 THEN cast(length(word) * {k + 3} AS DOUBLE) END" for k, c in enumerate(_NORMS.values())}


@query(_TOK + f""", norms AS (SELECT word, {", ".join(f"{v} AS {c}" for c, v in _RATE.items())} FROM (SELECT DISTINCT text AS word FROM tok WHERE length(text) > 4)),
d AS (SELECT doc_id, {", ".join(f"avg({c}) AS {c}" for c in _NORMS.values())} FROM tok JOIN norms ON text = word WHERE {_CONTENT} GROUP BY doc_id) """ + _union("d", _NORMS))
def cohmetrix_norms(spark, sf_dir):
    """Made-up norms: numbers from the lengths of the documents' words of five letters or more."""
    tokens = _sentences(spark, sf_dir, "text", "pos_coarse")
    norms = _sentences(spark, sf_dir, "text").select(F.explode("toks.text").alias("word")).where("length(word) > 4").distinct().select("word", *[F.expr(v).alias(c) for c, v in _RATE.items()])
    return _rounded(cohesion.word_means(tokens, norms, _NORMS))


@query("SELECT doc_id, unnest([" + ", ".join(f"'{k}'" for k in cohesion.NOT_COMPUTED) + "]) AS label, CAST(NULL AS DOUBLE) AS value, 'not implemented' AS error FROM documents")
def cohmetrix_not_computed(spark, sf_dir):
    return cohesion.not_computed(table(spark, sf_dir, "documents"))


_L2 = """CASE WHEN pos_coarse = 'ADJ' THEN pos + 2 WHEN dep_type = 'ROOT' THEN 0 ELSE root_at + 1 END"""
_REL = "CASE WHEN dep_type = 'ROOT' THEN 'root' WHEN dep_type = 'CC' AND text LIKE 'o%' THEN 'conj' ELSE lower(dep_type) END"
_FEATS = "CASE WHEN tag = 'VBD' THEN 'Tense=Past|VerbForm=Fin' END"
_RATIOS = {"MLC": ("W", "C"), "MLS": ("W", "S"), "MLT": ("W", "T")} | {f"{a}/{b}": (a, b) for a, b in (("C", "S"), ("C", "T"), ("CT", "T"), ("DC", "C"), ("DC", "T"), ("CP", "C"), ("CP", "T"), ("T", "S"), ("CN", "C"), ("CN", "T"), ("VP", "T"))}


@query(_TOK + f""", ro AS (SELECT *, min(CASE WHEN dep_type = 'ROOT' THEN pos END) OVER (PARTITION BY doc_id, para, sent) AS root_at FROM tok),
wd AS MATERIALIZED (SELECT doc_id, para * 100000 + sent AS sent, pos + 1 AS id, {_L2} AS head, pos_coarse AS upos, {_FEATS} AS feats, {_REL} AS deprel FROM ro),
m AS (SELECT DISTINCT doc_id, sent, head FROM wd WHERE deprel IN {dependencies.MODIFIERS}), cl AS (SELECT DISTINCT doc_id, sent, head FROM wd WHERE deprel IN {dependencies.CLAUSES}),
x AS (SELECT wd.*, m.head IS NOT NULL AS modified, cl.head IS NOT NULL AS clause FROM wd LEFT JOIN m ON wd.doc_id = m.doc_id AND wd.sent = m.sent AND wd.id = m.head LEFT JOIN cl ON wd.doc_id = cl.doc_id AND wd.sent = cl.sent AND wd.id = cl.head),
k AS (SELECT doc_id, count(DISTINCT sent) AS S, count(*) FILTER (WHERE upos <> 'PUNCT') AS W, count(*) FILTER (WHERE upos = 'VERB' AND feats LIKE '%VerbForm=Fin%') AS VP, count(*) FILTER (WHERE upos = 'VERB' AND deprel IN ('root', 'advcl', 'ccomp', 'acl', 'xcomp')) AS C,
 count(*) FILTER (WHERE upos = 'VERB' AND deprel IN ('advcl', 'ccomp', 'acl', 'xcomp')) AS DC, count(*) FILTER (WHERE deprel = 'root') AS T, count(*) FILTER (WHERE deprel = 'root' AND clause) AS CT, count(*) FILTER (WHERE deprel IN ('cc', 'conj')) AS CP, count(*) FILTER (WHERE upos = 'NOUN' AND modified) AS CN FROM x GROUP BY doc_id) """
       + _union("k", {k: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END" for k, (a, b) in _RATIOS.items()}, False))
def syntactic_complexity(spark, sf_dir):
    return _rounded(dependencies.syntactic_complexity(_words(spark, sf_dir, "id", "head", "upos", "feats", "deprel")))


def _words(spark, sf_dir, *fields: str) -> DataFrame:
    """Dependency words of rule-tagged sentences (doc_id, sent, ws), with some fields: the sentence's first verb is the root, adjectives hang on the next word."""
    rules = {"id": "pos + 1", "head": _L2, "upos": "pos_coarse", "feats": _FEATS, "deprel": _REL, "text": "text"}
    rooted = tagging.rule_sentences(_docs(spark, sf_dir), ("pos", "text", "pos_coarse", "tag", "dep_type"), {k: rules[k] for k in fields})
    return rooted.select("doc_id", F.expr("para * 100000 + sent").alias("sent"), F.col("toks").alias("ws"))
