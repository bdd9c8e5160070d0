"""Hyphenation by a table of patterns, over distinct words.

A pattern is letters with digits between them (`1na`, `b2l`, `.re1`, a dot is the word's edge). Wherever its letters occur in a word, its digits
are levels of the places between letters; the highest level of a place holds, and an odd one allows a break. Words are cut into all their pieces of a
pattern's length, which meet the patterns by equality, so no pattern is tried on a word that doesn't hold it. Words are matched in lower case. Null
words go; an empty word, or one without a break, is one syllable; repeated words give one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.operators.lookup import lookup
from spanweave.session import tasks

#: Letters from which the patterns of open syllables are made.
VOWELS = "aeiouyäöüáéíóúàèêôû"
CONSONANTS = "bcdfghjklmnpqrstvwxzßçñ"
#: Pairs of consonants that begin a syllable together: stops with liquids, and digraphs.
TOGETHER = tuple(a + b for a in "bcdfgkpt" for b in "lr") + ("ch", "ph", "sh", "th", "qu")


def open_syllables() -> list[str]:
    """Patterns by rule: a consonant before a vowel begins a syllable, pairs that belong together do so undivided."""
    single = [f"1{c}{v}" for c in CONSONANTS for v in VOWELS]
    return single + [f"1{p[0]}2{p[1]}" for p in TOGETHER]


def pattern_points(patterns: DataFrame) -> DataFrame:
    """(letters, at, level): the digits of each pattern with the number of letters before them; of equal places the highest level."""
    digit = F.substring("pattern", F.col("k"), F.lit(1))
    each = patterns.where("char_length(pattern) > 0").select("pattern", F.explode(F.sequence(F.lit(1), F.char_length("pattern"))).alias("k")).where(digit.rlike("[0-9]"))
    letters = lambda c: F.regexp_replace(c, "[0-9]", "")
    at = F.char_length(letters(F.substring("pattern", F.lit(1), F.col("k"))))
    points = each.select(F.lower(letters(F.col("pattern"))).alias("letters"), at.alias("at"), digit.cast("int").alias("level"))
    return points.groupBy("letters", "at").agg(F.max("level").alias("level"))


def _breaks(words: DataFrame, patterns: DataFrame, left: int, right: int) -> DataFrame:
    """(word, place): the offsets of each distinct word's breaks, and rows of null, one at least."""
    points = pattern_points(patterns).where("letters != ''").groupBy("letters").agg(F.collect_list(F.struct("at", "level")).alias("points"))
    longest = points.agg(F.max(F.char_length("letters"))).first()[0] or 1
    # a word makes many pieces, so words are dealt over a given number of tasks, not by their bytes
    distinct = words.select("word").where("word IS NOT NULL").distinct().repartition(tasks(words.sparkSession), "word")
    edged = distinct.withColumn("edged", F.concat(F.lit("."), F.lower("word"), F.lit(".")))
    starts = edged.select("word", "edged", F.explode(F.sequence(F.lit(1), F.char_length("edged"))).alias("from"))
    most = F.least(F.lit(longest), F.char_length("edged") - F.col("from") + 1)
    # a word's first place has an empty piece as well, which no pattern has: a row that stays where no piece meets a pattern
    sizes = starts.select("word", "edged", "from", F.explode(F.sequence(F.when(F.col("from") == 1, 0).otherwise(1), most)).alias("size"))
    pieces = sizes.select("word", "from", F.substring("edged", F.col("from"), F.col("size")).alias("letters"))
    met = lookup(pieces, points, "letters").where("points IS NOT NULL OR letters = ''").select("word", "from", F.explode_outer("points").alias("p"))
    # a place in the word is one less than in the edged word, whose offsets begin at 1
    levels = met.groupBy("word", (F.col("from") + F.col("p.at") - 2).alias("place")).agg(F.max("p.level").alias("level"))
    good = (F.col("level") % 2 == 1) & F.col("place").between(F.lit(left), F.char_length("word") - right)
    return levels.select("word", F.when(good, F.col("place")).alias("place"))


def break_places(words: DataFrame, patterns: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    """(word, places): the sorted offsets in code points at which each distinct word may be broken, at least `left` letters from its begin and `right`
    from its end."""
    return _breaks(words, patterns, left, right).groupBy("word").agg(F.array_sort(F.collect_list("place")).alias("places"))


def syllable_counts(words: DataFrame, patterns: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    """(word, syllables): places of a break, and one."""
    return _breaks(words, patterns, left, right).groupBy("word").agg((F.count("place") + 1).cast("int").alias("syllables"))
