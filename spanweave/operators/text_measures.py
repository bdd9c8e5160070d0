"""Readability and word-usage measures of whole texts: one projection of counts a document, no shuffle."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.functions import readability as R
from spanweave.functions.metrics import syllables

#: Words that Linsear's formula takes.
HEAD = 100
WORD_BREAK = "[^a-zäöüáéíóúñàèêôûçß]+"


def text_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")


def text_counts(docs: DataFrame, easy: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ws, and the counts that the formulas take, as doubles) of texts with a word; easy is a bounded word list."""
    t = F.col(text_col)
    # the words come out of an explode so that they are made once
    d = docs.select(F.col(id_col).alias("doc_id"), t.alias("t"), F.explode(F.array(text_words(t))).alias("ws")).where("size(ws) > 0")
    marks = F.transform("ws", lambda w: F.struct(F.char_length(w).alias("n"), syllables(w).alias("y"), (~w.isin(*easy) if easy else F.lit(True)).alias("new")))
    d = d.select("doc_id", "t", "ws", F.explode(F.array(marks)).alias("m"))
    # the first hundred words between blanks, as one text
    head = F.array_join(F.slice(F.filter(F.split("t", "[ \\t\\n\\r]+"), lambda x: x != ""), 1, HEAD), " ")
    head_words = F.size(text_words(F.col("head")))
    d = d.withColumn("head", head)
    total = lambda f: F.aggregate("m", F.lit(0), lambda a, x: a + f(x))
    many = lambda f: F.size(F.filter("m", f))
    counts = {
        "w": F.size("ws"),
        "s": F.greatest(F.size(F.regexp_extract_all("t", F.lit("[.!?]+"), 0)), F.lit(1)),
        "p": F.greatest(F.size(F.filter(F.split("t", "\n"), lambda x: F.btrim(x) != "")), F.lit(1)),
        "chars": total(lambda x: x["n"]),
        "syll": total(lambda x: x["y"]),
        "mono": many(lambda x: x["y"] == 1),
        "poly": many(lambda x: x["y"] >= 3),
        "long7": many(lambda x: x["n"] > 6),
        "hard": many(lambda x: (x["y"] >= 2) & x["new"]),
        "hard3": many(lambda x: (x["y"] >= 3) & x["new"]),
        "mini": many(lambda x: x["n"] <= 3),
        "body": F.char_length(F.regexp_replace("t", "[ \\t\\n\\r]", "")),
        "types": F.size(F.array_distinct("ws")),
        "w100": head_words,
        "s100": F.greatest(F.size(F.regexp_extract_all("head", F.lit("[.!?]+"), 0)), F.lit(1)),
        # words come in order, so the first hundred's are the first of all
        "poly100": F.size(F.filter(F.slice("m", F.lit(1), F.greatest(head_words, F.lit(1))), lambda x: x["y"] >= 3)),
    }
    return d.select("doc_id", "ws", *[c.cast("double").alias(k) for k, c in counts.items()])


def readability_rows(docs: DataFrame, easy: list[str], labels: list[str] | None = None) -> DataFrame:
    """(doc_id, label, value, error): one row a measure; a value that is not a number is null with an error, and removes no other."""
    counts = text_counts(docs, easy)
    chosen = {k: f for k, f in R.FORMULAS.items() if labels is None or k in labels}
    rows = F.array(*[F.struct(F.lit(k).alias("label"), F.expr(f).cast("double").alias("value")) for k, f in chosen.items()])
    each = counts.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")
    bad = F.col("value").isNull() | F.isnan("value")
    return each.select("doc_id", "label", F.when(~bad, F.col("value")).alias("value"), F.when(bad, F.lit("not a number")).alias("error"))


def text_standard(docs: DataFrame, easy: list[str]) -> DataFrame:
    """(doc_id, grade): the most frequent grade among the levels rounded down and up; of equal ones the smallest."""
    counts = text_counts(docs, easy)
    levels = F.array(*[F.expr(R.FORMULAS[k]) for k in R.GRADES])
    both = F.concat(F.transform(levels, lambda x: F.floor(x)), F.transform(levels, lambda x: F.ceil(x)))
    each = counts.select("doc_id", F.explode(both).alias("grade")).groupBy("doc_id", "grade").count()
    return each.groupBy("doc_id").agg(F.min(F.struct((-F.col("count")).alias("n"), "grade"))["grade"].alias("grade"))


def word_usage(docs: DataFrame) -> DataFrame:
    """(doc_id, label, n): words of the closed classes, and nominalisations, in each text with a word."""
    d = docs.select("doc_id", F.explode(F.array(text_words(F.col("text")))).alias("ws")).where("size(ws) > 0")
    among = lambda words: F.size(F.filter("ws", lambda w: w.isin(*words)))
    of = [F.struct(F.lit(k).alias("label"), among(v).alias("n")) for k, v in R.USAGE.items()]
    pattern, least = R.NOMINAL
    of.append(F.struct(F.lit("nominalizations").alias("label"), F.size(F.filter("ws", lambda w: w.rlike(pattern) & (F.char_length(w) >= least))).alias("n")))
    return d.select("doc_id", F.explode(F.array(*of)).alias("r")).select("doc_id", "r.label", F.col("r.n").cast("long").alias("n"))


def sentence_beginnings(docs: DataFrame) -> DataFrame:
    """(doc_id, label, n): sentences whose first word belongs to a class."""
    from spanweave.operators import spans

    first = spans.sentences(docs).select("doc_id", F.get(text_words(F.col("piece")), F.lit(0)).alias("w"))
    kinds = ("pronouns", "interrogatives", "articles", "subordinations", "conjunctions", "prepositions")
    counts = first.groupBy("doc_id").agg(*[F.count_if(F.col("w").isin(*R.USAGE[k])).alias(k) for k in kinds])
    rows = F.array(*[F.struct(F.lit(k).alias("label"), F.col(k).alias("n")) for k in kinds])
    return counts.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


def ngram_diversity(docs: DataFrame, most: int = 4) -> DataFrame:
    """(doc_id, value): the sum over n of distinct n-grams by all n-grams, n-grams by their 64-bit hashes; no shuffle."""
    from spanweave.operators.matching import tokens

    d = docs.select("doc_id", F.explode(F.array(F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w)))).alias("h")).where("size(h) > 0")

    def share(n: int) -> Column:
        count = F.size("h") - (n - 1)
        grams = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice("h", i, F.lit(n)))) if n > 1 else F.col("h")
        return F.when(count > 0, F.size(F.array_distinct(grams)) / count).otherwise(0.0)

    shares = [share(n) for n in range(1, most + 1)]
    return d.select("doc_id", sum(shares[1:], shares[0]).alias("value"))


def compression_ratio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, value): bytes of a text by its bytes under gzip, to three decimals; null for a null or empty text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_col, "UTF-8").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [round(len(raw) / len(gzip.compress(raw, mtime=0)), 3) if raw else None for raw in map(lambda x: x.as_py(), batch.column("raw"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "value"])

    return rows.mapInArrow(run, "doc_id bigint, value double")


#: Arabic short vowels, letters that lengthen them, doubled and nunated marks, all marks, and the letters of classical words.
_SHORT, _LONG, _STRESS, _MARKS = "َُِ", "اوي", "ًٌٍّ", "ً-ٓٗ٘"
_CLASSICAL = "[ئءؤذظ]|وا|ون"


def _arabic_syllables(text: Column) -> Column:
    """Short vowels once, lengthened, doubled and nunated ones twice; without marks the letters that are neither alef nor punctuation, less two."""
    many = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), 0))
    long = many(f"[{_SHORT}][^\\p{{L}}\\p{{N}}_\\s'{_MARKS}]*[{_LONG}]")
    short = many(f"[{_SHORT}]") - long
    bare = F.char_length(F.regexp_replace(text, "[اى?.!,\\s*]", "")) - 2
    return F.when(short == 0, bare).otherwise(short) + 2 * (long + many(f"[{_STRESS}]"))


def osman(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, value): Osman's readability of Arabic, of each text with a word; words lie between blanks. No shuffle."""
    t = F.coalesce(text_col, F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), t.alias("t"), F.explode(F.array(F.filter(F.split(t, "\\s+"), lambda w: w != ""))).alias("ws")).where("size(ws) > 0")
    many = lambda f: F.size(F.filter("ws", f))
    # what is cheap to tell comes first: most words are too short, or not classical, and need no more
    over = lambda w: F.char_length(w) > 5
    long = many(lambda w: over(w) & (F.char_length(F.regexp_replace(F.regexp_replace(w, f"[{_MARKS}]", ""), "[^\\p{L}\\p{N}_]", "")) > 5))
    complex_ = many(lambda w: over(w) & w.rlike("[ً-ّ]") & (F.size(F.regexp_extract_all(w, F.lit("[ً-ّ]"), 0)) > 5))
    classical = many(lambda w: w.rlike(_CLASSICAL) & (_arabic_syllables(w) > 5))
    s = F.greatest(F.size(F.regexp_extract_all("t", F.lit("[.!?]+"), 0)), F.lit(1))
    of = (complex_ + long + _arabic_syllables(F.col("t")) + classical) / F.size("ws")
    return d.select("doc_id", (200.791 - 1.015 * (F.size("ws") / s) - 24.181 * of).alias("value"))
