"""Token rows from rules, where no tagger's output is given: closed word classes and endings, English and German.

Rows: (doc_id, para, sent, pos, text, lemma, pos_coarse, tag, dep_type, is_punct, tense). Every rule is an SQL expression over the token
`text` in lower case, so any engine derives the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters with their marks, digits, and the punctuation inside a sentence.
TOKEN = r"[\p{L}\p{M}\p{N}]+|[,;:]"
LETTER = r"\p{L}"


def _among(words: str) -> str:
    return "text IN (" + ", ".join(f"'{w}'" for w in words.split()) + ")"


#: Closed classes.
DET = "the a an der die das this that"
PRON = "i me we us you he him she her it they them ich wir du er sie es"
ADP = "in on at of with for from by von mit auf"
CCONJ = "and or but und oder aber"
NEG = "not no never nicht kein"

COARSE = f"""CASE WHEN text IN (',', ';', ':') THEN 'PUNCT' WHEN substring(text, 1, 1) BETWEEN '0' AND '9' THEN 'NUM' WHEN {_among(DET)} THEN 'DET' WHEN {_among(PRON)} THEN 'PRON' WHEN {_among(ADP)} THEN 'ADP'
 WHEN {_among(CCONJ)} THEN 'CCONJ' WHEN {_among(NEG)} OR text = 'to' THEN 'PART' WHEN text LIKE '%ly' THEN 'ADV' WHEN text LIKE '%ed' OR text LIKE '%ing' OR text LIKE '%en' THEN 'VERB'
 WHEN text LIKE '%al' OR text LIKE '%ous' OR text LIKE '%ic' OR text LIKE '%ive' THEN 'ADJ' ELSE 'NOUN' END"""
TAG = "CASE WHEN text LIKE '%ing' THEN 'VBG' WHEN text LIKE '%ed' THEN 'VBD' WHEN text LIKE '%en' THEN 'VB' ELSE 'X' END"
TENSE = "CASE WHEN text LIKE '%ed' THEN 'Past' WHEN text LIKE '%ing' THEN 'Pres' WHEN text LIKE '%en' THEN 'Inf' END"
LEMMA = "CASE WHEN length(text) > 3 AND text LIKE '%s' THEN substring(text, 1, length(text) - 1) ELSE text END"
DEP = f"""CASE WHEN {_among(NEG)} THEN 'NEG' WHEN pos_coarse = 'VERB' AND verb_no = 1 THEN 'ROOT' WHEN pos_coarse = 'VERB' THEN 'ADVCL' WHEN pos_coarse = 'ADJ' THEN 'AMOD'
 WHEN pos_coarse = 'ADP' THEN 'PREP' WHEN pos_coarse = 'CCONJ' THEN 'CC' ELSE 'DEP' END"""


#: The same classes, with one look into the set of all closed words in place of one into each. A word's first character is a digit if it stands from 0 up to the
#: character after 9, so it isn't cut out.
_CLOSED = " ".join([", ; :", DET, PRON, ADP, CCONJ, NEG, "to"])
_CLASS = f"CASE WHEN {_among(_CLOSED)} THEN {COARSE} ELSE CASE WHEN text >= '0' AND text < ':' THEN 'NUM'" + COARSE[COARSE.index(" WHEN text LIKE '%ly'") :] + " END"
_VERB = f"{_CLASS} = 'VERB'"
#: The fields of a token but for its place, text and part of speech. verb_no = 1 at a sentence's first verb alone, whose place is `root_at`;
#: words of negation are particles, so others aren't looked up among them.
_FIELDS = {"lemma": LEMMA, "tag": TAG, "dep_type": DEP.replace("verb_no = 1", "pos = root_at").replace(_among(NEG), f"pos_coarse = 'PART' AND {_among(NEG)}"), "is_punct": "text IN (',', ';', ':')", "tense": TENSE}
FIELDS = ("pos", "text", "lemma", "pos_coarse", "tag", "dep_type", "is_punct", "tense")


def _sentences(docs: DataFrame) -> DataFrame:
    """A row a sentence: (doc_id, n, x), x its paragraph, its number there and its text."""
    lower = F.lower(F.coalesce("text", F.lit("")))
    lettered = lambda parts: F.filter(parts, lambda x: x.rlike(LETTER))
    within = lambda p, i: F.transform(lettered(F.split(p, "[.!?]+")), lambda s, j: F.struct(i.alias("para"), j.alias("sent"), s.alias("s")))
    sents = docs.select("doc_id", F.posexplode(F.flatten(F.transform(lettered(F.split(lower, "\n")), within))).alias("n", "x"))
    return sents.select("doc_id", (F.col("n") + 1).alias("n"), "x")


def _words(docs: DataFrame) -> DataFrame:
    """A row a sentence: (doc_id, n, para, sent, ts), ts its tokens' texts. Arrays come out of an explode, so that each is made once."""
    return _sentences(docs).select("doc_id", "n", "x.para", "x.sent", F.explode(F.array(F.regexp_extract_all("x.s", F.lit(TOKEN), 0))).alias("ts"))


def _bound(value: str, name: str, then: str) -> str:
    """`then`, an expression over `name`, with the value made once. It is no column, so that no row is copied for it."""
    return f"get(transform(array({value}), {name} -> {then}), 0)"


def rule_sentences(docs: DataFrame, fields: tuple[str, ...] = FIELDS, into: dict[str, str] | None = None) -> DataFrame:
    """docs (doc_id, text) -> a row a sentence: (doc_id, n, para, sent, toks), n its number in the document from 1, toks the named fields of its tokens. Paragraphs
    are lines with a letter of any script, sentences with one end in marks; both are numbered from 0 within the document. The sentences of a document are
    made out of its row, lie together and come in order; nothing is shuffled. A doc_id is one row's. `into` gives other fields of toks, as rules over the
    named ones and root_at, the place of the sentence's first verb. A sentence's arrays are copied into rows once, when its tokens are done."""
    classes = bool({"pos_coarse", "dep_type"} & {*fields}) or into is not None
    given = {k: re.sub(r"\bpos_coarse\b", "get(classes, pos)", _FIELDS.get(k, k)) for k in fields}
    toks = "transform(ts, (text, pos) -> named_struct(" + ", ".join(f"'{k}', {v}" for k, v in given.items()) + "))"
    if into is not None:
        named = {k: re.sub(rf"\b({'|'.join(fields)})\b", r"t.\1", v) for k, v in into.items()}
        toks = f"transform({toks}, t -> named_struct(" + ", ".join(f"'{k}', {v}" for k, v in named.items()) + "))"
    if classes:
        toks = _bound("cast(nullif(array_position(classes, 'VERB'), 0) - 1 as int)", "root_at", toks)
        toks = _bound(f"transform(ts, text -> {_CLASS})", "classes", toks)
    pattern = TOKEN.replace("\\", "\\\\")
    made = _bound(f"regexp_extract_all(x.s, '{pattern}', 0)", "ts", toks)
    return _sentences(docs).select("doc_id", "n", "x.para", "x.sent", F.explode(F.array(F.expr(made))).alias("toks"))


def rule_tokens(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> a row a token, made out of the document's row."""
    rooted = _words(docs).withColumn("root_at", F.array_position(F.expr(f"transform(ts, text -> {_VERB})"), True).cast("int") - 1)
    each = rooted.select("doc_id", "para", "sent", "root_at", F.posexplode("ts").alias("pos", "text"))
    each = each.withColumn("pos_coarse", F.expr(COARSE))
    return each.select("doc_id", "para", "sent", *[F.expr(_FIELDS.get(k, k)).alias(k) for k in FIELDS])


#: The same rows in DuckDB, as the table `tok`.
SQL = f"""paras AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS para FROM (SELECT doc_id, list_filter(string_split(lower(coalesce(text, '')), chr(10)), lambda x: regexp_matches(x, '{LETTER}')) AS ps FROM documents)),
sent0 AS (SELECT doc_id, para, unnest(ss) AS s, unnest(range(len(ss))) AS sent FROM (SELECT doc_id, para, list_filter(regexp_split_to_array(p, '[.!?]+'), lambda x: regexp_matches(x, '{LETTER}')) AS ss FROM paras)),
tok0 AS (SELECT doc_id, para, sent, unnest(ts) AS text, unnest(range(len(ts))) AS pos FROM (SELECT doc_id, para, sent, regexp_extract_all(s, '{TOKEN}') AS ts FROM sent0)),
tok1 AS (SELECT *, {COARSE} AS pos_coarse, {TAG} AS tag, {TENSE} AS tense, {LEMMA} AS lemma FROM tok0),
tok2 AS (SELECT *, sum(CASE WHEN pos_coarse = 'VERB' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, para, sent ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS verb_no FROM tok1),
tok AS MATERIALIZED (SELECT doc_id, para, sent, pos, text, lemma, pos_coarse, tag, {DEP} AS dep_type, pos_coarse = 'PUNCT' AS is_punct, tense FROM tok2)"""
