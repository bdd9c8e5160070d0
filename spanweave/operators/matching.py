"""Dictionary and fuzzy lookup, and two-stage matching."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanweave.session import ship_package


def tokens(text: Column) -> Column:
    """The lower-case words: all runs of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def phrases(docs: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, n, phrase): all n-grams of 1..most words. The words come out of an explode, so that they are made once and not again
    for every n-gram: the work grows with the text."""
    whole = docs.select(F.col(id_col).alias(id_col), F.explode(F.array(tokens(F.col(text_col)))).alias("w")).where("size(w) > 0")
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.slice(F.col("w"), i + 1, F.lit(most)))
    each = whole.select(id_col, F.posexplode(grams).alias("pos", "g"))
    sized = each.select(id_col, "pos", "g", F.explode(F.sequence(F.lit(1), F.size("g"))).alias("n"))
    return sized.select(id_col, "pos", "n", F.array_join(F.slice("g", F.lit(1), F.col("n")), " ").alias("phrase"))


def tag(docs: DataFrame, dictionary: DataFrame, most: int = 3, result_selection: str = "all") -> DataFrame:
    """(doc_id, pos, n, phrase, entry): every dictionary phrase of at most `most` words in the texts, an equi-join on the n-gram; with
    result_selection first or last, one entry a phrase, the smallest or the largest."""
    entries = dictionary.select(F.lower("phrase").alias("phrase"), "entry")
    if result_selection not in ("all", "first", "last"):
        raise ValueError("result_selection is all, first or last")
    if result_selection != "all":
        entries = entries.groupBy("phrase").agg((F.min if result_selection == "first" else F.max)("entry").alias("entry"))
    return phrases(docs, most).join(entries, "phrase")


def deletions(word: Column) -> Column:
    """The word and every way to delete one letter: two words within one edit share one of these."""
    cut = F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.concat(F.substring(word, 1, i - 1), F.substring(word, i + 1, F.char_length(word))))
    return F.array_distinct(F.concat(F.array(word), F.when(F.char_length(word) > 0, cut).otherwise(F.array().cast("array<string>"))))


def fuzzy(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of (word) within one edit, through shared deletion keys."""
    a = left.select(F.col("word").alias("a"), F.explode(deletions(F.col("word"))).alias("key"))
    b = right.select(F.col("word").alias("b"), F.explode(deletions(F.col("word"))).alias("key"))
    return a.join(b, "key").select("a", "b").distinct().withColumn("distance", F.levenshtein("a", "b", 1)).where("distance >= 0")


def letters(word: Column) -> Column:
    """The letters with their numbers among equal ones: two words share as many of these as letters, repeats included."""
    each = F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.substring(word, i, F.lit(1)))
    number = F.transform(each, lambda c, i: F.concat(c, F.size(F.filter(F.slice(each, F.lit(1), i + 1), lambda x: x == c)).cast("string")))
    return F.when(F.char_length(word) > 0, number).otherwise(F.array().cast("array<string>"))


def similar(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """All pairs (a, b, sim) of distinct words of left (word) and right (word) with difflib's ratio 2 M / T >= cutoff > 0.

    M is at most the number of letters shared, so a pair that passes shares cutoff / 2 of its letters and the lengths n and m
    have n / m >= cutoff / (2 - cutoff). A word of n letters then shares at least cutoff / (2 - cutoff) * n of them, so both share
    one among their first n - that + 1 by one order of all letters, rarest first.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("cutoff must be over 0 and at most 1")
    ship_package(left.sparkSession)
    least = cutoff / (2 - cutoff) - 1e-9

    def numbered(words: DataFrame) -> DataFrame:
        return words.where("word <> ''").distinct().select("word", letters(F.col("word")).alias("ls"))

    a, b = numbered(left), numbered(right)
    counts = b.select(F.explode("ls").alias("key")).groupBy("key").agg(F.count("*").alias("df"))

    def first(words: DataFrame) -> DataFrame:
        each = words.select("word", "ls", F.size("ls").alias("n"), F.explode("ls").alias("key")).join(counts, "key", "left")
        placed = each.withColumn("place", F.row_number().over(W.partitionBy("word").orderBy(F.coalesce("df", F.lit(0)), "key")))
        return placed.where(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).select("key", "word", "ls", "n")

    x, y = first(a).select("key", F.col("word").alias("a"), F.col("ls").alias("la"), F.col("n").alias("n")), first(b).select("key", F.col("word").alias("b"), F.col("ls").alias("lb"), F.col("n").alias("m"))
    near = F.least("n", "m") >= F.lit(least) * F.greatest("n", "m")
    enough = 2 * F.size(F.array_intersect("la", "lb")) >= F.lit(cutoff - 1e-9) * (F.col("n") + F.col("m"))
    pairs = x.join(y, "key").where(near & enough).select("a", "b").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the name looked up comes second, as in difflib.get_close_matches
            sims = [SequenceMatcher(None, y, x).ratio() for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], ["a", "b", "sim"])

    return pairs.mapInArrow(run, "a string, b string, sim double").where(F.col("sim") >= cutoff)


def _numbered(parts: Column) -> Column:
    """Each part with its number among equal ones."""
    return F.transform(parts, lambda c, i: F.concat(c, F.lit(" "), F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


#: Numbers of edits that are counted in a band.
BANDED = 4


def near_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """(group, a, b, similarity): the pairs a < b of texts (group, text), each once a group, with 1 - edit distance / longer length >= threshold, for 0 < threshold <= 1.

    Within d edits, d <= (1 - threshold) * n for the longer one's n letters, two texts share n - d letters and, padded at both ends, n + 1 - 2 d
    pairs of letters, repeats included: threshold * n and (2 * threshold - 1) * n + 1 at least, which is less for the shorter one. So both
    hold a shared part among their first (all - that + 1) by any one order; pairs of letters are taken where they tell enough, single letters below
    a threshold of 0.6. The order is rarest first among the distinct texts of all groups, so parts are made and placed once a text and not once a group
    that holds it; pairs are told before they are made distinct, so only near ones are shuffled.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    pairs = threshold >= 0.6
    n = F.char_length("text")
    padded = F.concat(F.lit("\x02"), F.col("text"), F.lit("\x03"))
    parts = F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.substring(padded, i, F.lit(2))) if pairs else letters(F.col("text"))
    all_of = n + 1 if pairs else n
    shared = F.ceil(F.lit(2 * threshold - 1) * n + 1 - 1e-9) if pairs else F.ceil(F.lit(threshold) * n - 1e-9)
    edits = lambda longer: F.floor(F.lit(1 - threshold) * longer + 1e-6)
    # texts that are too short for one edit, with the longest partner too, are near no other
    held = texts.select("group", "text").where((n > 0) & (edits(F.floor(n / threshold + 1e-6)) >= 1))
    each = held.select("text").distinct().select("text", n.alias("n"), (all_of - shared + 1).alias("first"), F.explode(_numbered(parts) if pairs else parts).alias("key"))
    counts = each.groupBy("key").agg(F.count("*").alias("df"))
    place = F.row_number().over(W.partitionBy("text").orderBy("df", "key"))
    first = each.join(counts, "key").withColumn("place", place).where("place <= first and df > 1").select("text", "n", "key")
    placed = held.join(first, "text").select("group", "key", "text", "n")
    longer = F.greatest("x.n", "y.n")
    near = (F.col("x.text") < F.col("y.text")) & (F.least("x.n", "y.n") >= F.lit(threshold - 1e-9) * longer) & (edits(longer) >= 1)
    met = placed.alias("x").join(placed.alias("y"), (F.col("x.group") == F.col("y.group")) & (F.col("x.key") == F.col("y.key")) & near)
    told = met.select("x.group", F.col("x.text").alias("a"), F.col("y.text").alias("b"), longer.alias("longer"))
    # few edits are counted up to their number only, which takes a band of the table
    distance = F.levenshtein("a", "b")
    for most in range(BANDED, 0, -1):
        distance = F.when(edits(F.col("longer")) == most, F.levenshtein("a", "b", most)).otherwise(distance)
    told = told.withColumn("distance", distance).where("distance >= 0")
    told = told.select("group", "a", "b", (1 - F.col("distance") / F.col("longer")).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
    return told.distinct()


def near_texts(texts: DataFrame, threshold: float) -> DataFrame:
    """(group, a, b, similarity): near_pairs, and each text with itself."""
    held = texts.select("group", "text").where(F.char_length("text") > 0).distinct()
    return near_pairs(held, threshold).unionByName(held.select("group", F.col("text").alias("a"), F.col("text").alias("b"), F.lit(1.0).alias("similarity")))


def two_stage(left: DataFrame, right: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """left (name), right (name, value): exact match ignoring case, first row wins; the rest by the most similar of all names
    whose ratio (difflib's 2 M / T) reaches the cutoff."""
    first = right.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("value", "name")).alias("v"))
    exact = left.join(first, F.lower("name") == F.col("key"), "left")
    hit = exact.where("v is not null").select("name", F.col("v.value").alias("value"), F.lit("exact").alias("stage"))
    rest = exact.where("v is null").select("name")
    near = similar(rest.select(F.lower("name").alias("word")), right.select(F.lower("name").alias("word")), cutoff)
    best = near.withColumn("n", F.row_number().over(W.partitionBy("a").orderBy(F.desc("sim"), "b"))).where("n = 1")
    found = rest.join(best, F.lower("name") == F.col("a")).join(first, F.col("b") == F.col("key")).select("name", F.col("v.value").alias("value"), F.lit("fuzzy").alias("stage"))
    return hit.unionByName(found)


def resolve(links: DataFrame, providers: dict[str, DataFrame]) -> DataFrame:
    """links (id, linking 'provider:key') to each provider's (key, name); unknown keys are dropped."""
    parts = links.withColumns({"provider": F.lower(F.element_at(F.split("linking", ":"), 1)), "key": F.element_at(F.split("linking", ":"), 2)})
    out = None
    for name, table in providers.items():
        one = parts.where(F.col("provider") == name).join(table, "key").select("id", "provider", "key", "name")
        out = one if out is None else out.unionByName(one)
    return out
