"""Spelling variants: words within one edit of each other, grouped under their most frequent form.

Words are counted over whole texts. Near words are found by an even-partition pigeonhole join: a word of l code points is
indexed by its first l // 2 and by its other code points; one edit leaves one of the two whole, so a word of equal length
holds that segment at the same place, and a word one longer holds the first segment at its start or the second one place
further on. The keys name the length, the segment's number and its text. Every candidate is verified by the exact distance.

A key held by more than `crowd` words is cut once more by the same rule: the edit lies in the rest of the word, whose two
halves give it two longer keys, one of which survives. No key is capped, and no pair is lost. Keys are joined by their hashes.

A pair met by two keys (an inserted letter in a run of that letter) counts once, after
verification. Forms are chosen by partial aggregation. As a form is at least twice as frequent as its word, chains end after
log2 of the largest count; roots are found by pointer doubling, each round written.

Defined results: a null or empty text has no words; a null id is the empty string in the hash of the planted deletions; repeated
rows count each; ties in frequency go to the smallest word in code-point order; very long texts are taken whole, one
array of words at a time; an empty table, or one without a word often enough, gives an empty result; further columns are
not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.support import Workspace, ascii_lower

RUN = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form is at least so many times as frequent as its word.
RATIO = 2
#: One run in so many loses a letter in the query's copy of the texts.
DAMAGE = 97
#: Words of one key beyond which it is cut again.
CROWD = 32


def _letter_dropped(run: Column, h: Column) -> Column:
    """The run without the code point that its hash h names, if DAMAGE divides h."""
    at = F.pmod(h, F.char_length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def word_counts(docs: DataFrame, text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, id_col: str | None = None) -> DataFrame:
    """(word, n): runs of letters lower-cased in A-Z, of least_length code points and least_count occurrences or more; with id_col, some
    runs lose a letter first. Shorter runs are left out as they are read: no result is longer than its run."""
    text = ascii_lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    start = F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(":")) if id_col else F.lit("")
    df = docs.select(start.alias("start"), F.explode(F.regexp_extract_all(text, F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))).alias("word"))
    if id_col:
        df = df.select("word", F.crc32(F.concat("start", "word").cast("binary")).alias("h"))
        df = df.select(_letter_dropped(F.col("word"), F.col("h")).alias("word"))
    return df.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least_count) & (F.char_length("word") >= least_length))


def _key(length: Column, number: int, *parts: Column) -> Column:
    """A hash of the key: words that meet by chance are told apart by the verification."""
    return F.xxhash64(length, F.lit(number), *parts)


def _part(word: Column, begin: Column, end: Column) -> Column:
    """The code points [begin, end), from 0."""
    return F.substring(word, (begin + 1).cast("int"), (end - begin).cast("int"))


def _split(v: DataFrame, longer: bool, level: int) -> DataFrame:
    """(key, parent, word): the keys under which words are indexed (longer False), or by which words one code point longer look for them.

    Level 1 keys are the two segments. Level 2 keys add one half of what is left, each under its own number, and keep their level 1
    key as parent.
    """
    w = F.col("word")
    n = F.char_length(w) - (1 if longer else 0)
    a = F.floor(n / 2)
    shift = F.lit(1 if longer else 0)
    first, second = _part(w, F.lit(0), a), _part(w, a + shift, n + shift)
    one = _key(n, 1, first), _key(n, 2, second)
    if level == 1:
        return v.select(F.explode(F.array(*one)).alias("key"), "word")
    # the edit lies in the rest: behind the first segment, or before the second
    out = []
    for parent, segment, begin, end, number in ((one[0], first, a, n, 3), (one[1], second, F.lit(0), a, 5)):
        mid = begin + F.floor((end - begin) / 2)
        out.append(F.struct(_key(n, number, segment, _part(w, begin, mid)).alias("key"), parent.alias("parent")))
        out.append(F.struct(_key(n, number + 1, segment, _part(w, mid + shift, end + shift)).alias("key"), parent.alias("parent")))
    return v.select(F.explode(F.array(*out)).alias("k"), "word").select("k.key", "k.parent", "word")


def near_pairs(v: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): every pair of v's distinct words that one inserted, deleted or replaced code point tells apart; a is the shorter word, or the
    smaller of two of equal length."""
    crowded = _split(v, False, 1).groupBy("key").count().where(F.col("count") > crowd).select(F.col("key").alias("crowded"))

    def keyed(longer: bool) -> DataFrame:
        plain = _split(v, longer, 1).join(crowded, F.col("key") == F.col("crowded"), "left_anti")
        cut = _split(v, longer, 2).join(crowded, F.col("parent") == F.col("crowded"), "left_semi")
        return plain.select("key", "word").unionByName(cut.select("key", "word"))

    # words of equal length and words one longer look up the same index in one join
    index = keyed(False)
    probes = index.select("key", F.col("word").alias("b")).unionByName(keyed(True).select("key", F.col("word").alias("b")))
    met = index.select("key", F.col("word").alias("a")).join(probes, "key")
    met = met.where((F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def roots(forms: DataFrame, space: Workspace) -> DataFrame:
    """(word, root) of (word, form): where following forms ends; only words that have a form. No chain may be a circle."""
    up = space.write(forms.select("word", F.col("form").alias("root")), "up")
    while True:
        above = up.select(F.col("word").alias("w"), F.col("root").alias("above"))
        then = up.join(above, up["root"] == above["w"], "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        then = space.write(then, "up")
        space.drop(up)
        up = then.select("word", "root")
        up._spanweave_path = then._spanweave_path
        if not then.where("moved").limit(1).count():
            return up


def variants(spark: SparkSession, counts: DataFrame, ratio: int = RATIO, crowd: int = CROWD) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of (word, n)."""
    space = Workspace(spark, "spelling")
    v = space.write(counts.select("word", "n"), "words")
    pairs = space.write(near_pairs(v.select("word"), crowd), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    near = both.join(v.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    held = v.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    held = space.write(held, "forms")
    last = roots(held.where("form is not null").select("word", "form"), space)
    return held.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(spark, word_counts(docs, id_col="doc_id"))
