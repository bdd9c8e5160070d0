"""Readability with a table of easy words and a table of syllables: distinct words are measured once, documents add up what their words are.

A document's words are counted first, where the document lies, so a word as common as can be is one row a document. The commonest words, a bounded number,
meet their measures there, by a broadcast, and are added up to one row a document; only the others are shuffled, of which none is common. Rows that share a
doc_id are one text, null ids among them; null and empty texts, or texts without a word, give no row. Distinct words of a text count once among the
difficult ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.functions.readability import FORMULAS
from spanweave.operators.lookup import BOUND
from spanweave.operators.text_measures import WORD_BREAK
from spanweave.session import tasks
from spanweave.workspace import Workspace, dealt

_DALE = "0.1579 * (100 * ({0} / w)) + 0.0496 * (w / s) + CASE WHEN {0} / w > 0.05 THEN 3.6365 ELSE 0 END"
#: Formulas over counts (doubles): w words, s sentences, syll syllables, mono and poly words of one and of three or more syllables, long7 words of over
#: six letters, new distinct words that the list lacks, hard those of two or more syllables. The published constants.
LISTED = {k: FORMULAS[k] for k in ("flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "smog_index", "wiener_sachtextformel_1", "syllable_count")} | {
    "dale_chall_readability_score": _DALE.format("new"),
    "dale_chall_readability_score_v2": _DALE.format("hard"),
    "spache_readability": "0.141 * (w / s) + 0.086 * (100 * (hard / w)) + 0.839",
    "difficult_words": "hard",
}


def each_word(docs: DataFrame, text_col: str = "text", *others: str) -> DataFrame:
    """The other columns and word, a row a lower-case word of a text."""
    return docs.select(*others, F.explode(F.split(F.lower(F.col(text_col)), WORD_BREAK)).alias("word")).where("word != ''")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word, n): the lower-case words of each text with their number."""
    each = each_word(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "doc_id")
    return each.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def occurrences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): the distinct lower-case words of all texts with their number, written once."""
    return Workspace(docs.sparkSession, "occurrences").write(each_word(docs, text_col).groupBy("word").agg(F.count("*").alias("n")), "words")


def _commonest(words: DataFrame, bound: int) -> tuple[DataFrame, DataFrame]:
    """words (word, n, ...) in two: the commonest, at most `bound`, and the others. The line between them is one of a few steps of n, so no rows are ordered."""
    step = F.floor(F.log2("n") * 8)
    least, held = None, 0
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True):
        held += r.words
        if held > bound:
            break
        least = r.step
    return (words.where(F.lit(False)), words) if least is None else (words.where(step >= least), words.where(step < least))


def list_counts(docs: DataFrame, easy: DataFrame, syllables: DataFrame, counts: DataFrame | None = None, bound: int = BOUND) -> DataFrame:
    """(doc_id and the counts of LISTED). easy has a column word; syllables has word and syllables, and words that it lacks have one. counts are the
    `occurrences` of docs, if they have been made; `bound` words are sent to every task at most."""
    words = word_counts(docs.select("doc_id", "text").repartition(tasks(docs.sparkSession), "doc_id"))
    measured = dealt(syllables.groupBy("word").agg(F.max("syllables").alias("y")))
    listed = easy.select("word").where("word IS NOT NULL").distinct().withColumn("easy", F.lit(True))
    known = dealt(occurrences(docs) if counts is None else counts).join(measured, "word", "left").join(dealt(listed), "word", "left")
    known = known.select("word", "n", F.coalesce("y", F.lit(1)).alias("y"), F.col("easy").isNull().alias("lacks"))
    common, rare = _commonest(Workspace(docs.sparkSession, "word-lists").write(known, "known"), bound)

    def values(n, y, lacks, word):
        made = {
            "w": n, "syll": n * y, "mono": F.when(y == 1, n), "poly": F.when(y >= 3, n), "long7": F.when(F.char_length(word) > 6, n),
            "new": F.when(n > 0, lacks.cast("int")), "hard": F.when(n > 0, (lacks & (y >= 2)).cast("int")),
        }
        return {k: v.cast("long") for k, v in made.items()}

    n, y, lacks, word = (F.col(c) for c in ("n", "y", "lacks", "word"))
    met = words.join(F.broadcast(common.drop("n")), "word", "left")
    # the common words of a text become one row, under a key that is no word
    key = F.when(y.isNull(), word).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("word")
    found = values(F.when(y.isNotNull(), n), y, lacks, word)
    firsts = met.groupBy("doc_id", key).agg(F.sum(F.when(y.isNull(), n)).alias("n"), *[F.sum(v).alias(f"_{k}") for k, v in found.items()])
    both = dealt(firsts).join(dealt(rare.drop("n")), "word", "left")
    rows = both.select("doc_id", *[F.coalesce(f"_{k}", v).alias(k) for k, v in values(n, y, lacks, word).items()])
    # sentences come as rows of their own, so texts are not joined
    ends = docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[.!?]+"), 0)).cast("long").alias("ends"))
    rows = rows.unionByName(ends, allowMissingColumns=True)
    summed = rows.groupBy("doc_id").agg(*[F.coalesce(F.sum(k), F.lit(0)).cast("double").alias(k) for k in [*found, "ends"]])
    return summed.where("w > 0").withColumn("s", F.greatest("ends", F.lit(1.0))).drop("ends")


def list_readability(docs: DataFrame, easy: DataFrame, syllables: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, label, value): one row a formula of LISTED."""
    rows = F.array(*[F.struct(F.lit(k).alias("label"), F.expr(f).cast("double").alias("value")) for k, f in LISTED.items()])
    return list_counts(docs, easy, syllables, counts).select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


def commonest_words(docs: DataFrame, size: int, text_col: str = "text") -> DataFrame:
    """(word): the `size` words of most occurrences, of equal ones the smallest, as a list of familiar words."""
    counts = each_word(docs, text_col).groupBy("word").count()
    return counts.orderBy(F.desc("count"), "word").limit(size).select("word")
