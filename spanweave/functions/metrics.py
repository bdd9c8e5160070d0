"""Closed-form text metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(n: Column, d: Column) -> Column:
    return F.coalesce(n / F.nullif(d.cast("double"), F.lit(0.0)), F.lit(0.0))


def incidence(n: Column, total: Column) -> Column:
    return 1000 * safe_ratio(n, total)


def syllables(word: Column) -> Column:
    """Vowel groups, at least one."""
    return F.greatest(F.size(F.regexp_extract_all(F.lower(word), F.lit("[aeiouyäöüáéíóúàèêôû]+"), 0)), F.lit(1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def softmax(scores: Column) -> Column:
    """exp(x - max) / sum, each of the two computed once an array: a one-element array is the scope that holds them."""
    once = F.transform(F.array(F.struct(scores.alias("x"), F.array_max(scores).alias("top"))), lambda a: F.transform(a["x"], lambda x: F.exp(x - a["top"])))
    summed = F.transform(once, lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda s, y: s + y).alias("sum")))
    return F.transform(summed, lambda a: F.transform(a["e"], lambda x: x / a["sum"]))[0]


def timestamp_seconds(stamp: Column) -> Column:
    """hh:mm:ss.mmm as seconds, two decimals."""
    p = F.split(stamp, ":")
    return F.round(p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double"), 2)


def truthy(value: Column) -> Column:
    return F.lower(F.trim(value)).isin("1", "true", "yes", "on", "y")


def positive_int(value: Column, default: int) -> Column:
    n = value.try_cast("int")
    return F.when(n > 0, n).otherwise(F.lit(default))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def normalised_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 0 for two empty texts."""
    return safe_ratio(F.levenshtein(a, b), F.greatest(F.char_length(a), F.char_length(b)))


def jaccard(a: Column, b: Column) -> Column:
    return safe_ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def smoothed_log(x: Column, floor: float = 1e-5) -> Column:
    return F.log(x + F.lit(floor))


def strip_edge_punctuation(word: Column) -> Column:
    return F.regexp_replace(word, r"^\p{P}+|\p{P}+$", "")


def dehyphenate(text: Column) -> Column:
    """Words broken at a line end are joined again."""
    return F.replace(text, F.lit("-\n"), F.lit(""))


def repeat_until(text: Column, length: int) -> Column:
    """A short text repeated until it has `length` characters; an empty one stays."""
    n = F.char_length(text)
    return F.when((n > 0) & (n < length), F.repeat(text, F.ceil(F.lit(length) / n).cast("int"))).otherwise(text)


def perplexity(log_probs: Column) -> Column:
    """exp of the mean negative log probability of an array; null if it is empty."""
    n = F.size(log_probs)
    return F.when(n > 0, F.exp(-F.aggregate(log_probs, F.lit(0.0), lambda a, x: a + x) / n))
