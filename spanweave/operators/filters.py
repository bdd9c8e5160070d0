"""Predicates and filters over layers, tokens and pairs, and the joins that bring results back to their spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTENT, NOUN, PRONOUN = ("NOUN", "VERB", "ADJ", "ADV"), ("NOUN", "PROPN"), ("PRON",)


def pos_set(tokens: DataFrame, coarse: tuple[str, ...]) -> DataFrame:
    return tokens.where(F.col("pos_coarse").isin(*coarse))


def function_word(tag: Column) -> Column:
    """German tags of closed classes: articles, conjunctions, particles, adpositions, modal and auxiliary verbs."""
    return (tag == "ART") | tag.rlike("^(K|PTK|AP|VM|VA)")


def punctuation(word: Column) -> Column:
    return F.trim(F.regexp_replace(word, r"[\p{P}|]", "")) == ""


def above(score: Column, threshold: float | None) -> Column:
    """Whether a pair stays: always, if there is no threshold."""
    return F.lit(True) if threshold is None else F.coalesce(score >= threshold, F.lit(False))


def checkable(word: Column) -> Column:
    """Letters or digits only, and not digits alone."""
    return word.rlike(r"^[\p{L}\p{N}]+$") & ~word.rlike(r"^\p{N}+$")


def eligible(sentences: DataFrame, most: int = 150) -> DataFrame:
    """Sentences (toks array of structs with pos_coarse) of 1 to `most` tokens that hold a verb or an auxiliary."""
    return sentences.where(F.size("toks").between(1, most) & F.exists("toks", lambda t: t["pos_coarse"].isin("VERB", "AUX")))


def timed(words: DataFrame) -> DataFrame:
    return words.where("start is not null and stop is not null")


def verified(names: DataFrame, only: bool) -> DataFrame:
    return names.where("match_type <> 'NoMatch'") if only else names


def window_checked(begin: Column, end: Column, text: Column) -> Column:
    """The text of a selection window; a window outside of the text is an error."""
    inside = (begin >= 0) & (begin <= end) & (end <= F.char_length(text))
    return F.when(F.coalesce(inside, F.lit(False)), F.substring(text, begin + 1, end - begin)).otherwise(F.raise_error(F.lit("selection window outside of the text")))


def recomposed(text: Column, begin: Column, end: Column, replacement: Column) -> Column:
    """The text with its window replaced."""
    return F.concat(F.substring(text, F.lit(1), begin), replacement, F.substring(text, end + 1, F.char_length(text)))


def of_div_type(divs: DataFrame, selection: str) -> DataFrame:
    """`<layer>;<type>`: the divisions of a type; without a type all of them."""
    _, _, kind = selection.partition(";")
    return divs.where(F.col("div_type") == kind) if kind else divs


def without_old(layer: DataFrame, old: DataFrame) -> DataFrame:
    """The layer without the annotations (doc_id, begin, end, type) to be removed."""
    return layer.join(old.select("doc_id", "begin", "end", "type"), ["doc_id", "begin", "end", "type"], "left_anti")


def by_ids(divs: DataFrame, ids: str) -> DataFrame:
    """Divisions (id, ...) of a comma-separated list in the order of the list (column place); missing ones are left out."""
    wanted = divs.sparkSession.createDataFrame([(k, i.strip()) for k, i in enumerate(ids.split(",")) if i.strip()], "place int, id string")
    return divs.join(F.broadcast(wanted), "id")  # as long as the parameter


def restored(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests (ref, doc_id, begin, end) with their response (ref, ...); one that did not come is null."""
    return requests.join(responses, "ref", "left")


def written_back(layer: DataFrame, results: DataFrame) -> DataFrame:
    """The layer with results of exactly the same span."""
    return layer.join(results, ["doc_id", "begin", "end"], "left")


def mapped(column: Column, pairs: dict[str, str]) -> Column:
    """A label through a map; one that it lacks stays."""
    flat = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*flat), column), column) if flat else column


def linked(claims: DataFrame, facts: DataFrame, claim_fact: DataFrame) -> DataFrame:
    """Claims and facts of a many-to-many link table, a row a pair."""
    named = lambda t, p: t.select(*[F.col(c).alias(f"{p}_{c}") if c != f"{p}_id" else F.col(c) for c in t.columns])
    return claim_fact.join(named(claims, "claim"), "claim_id").join(named(facts, "fact"), "fact_id")


def prompts(base: DataFrame, prefix: str | None = None, suffix: str | None = None, system: str | None = None) -> DataFrame:
    """base (id, text) plus prompt and system; parts that are missing are empty texts."""
    return base.withColumn("prompt", F.concat(F.lit(prefix or ""), F.coalesce("text", F.lit("")), F.lit(suffix or ""))).withColumn("system", F.lit(system or ""))


def pairs_within(rows: DataFrame, key: str, n: str) -> DataFrame:
    """All pairs i < j of the rows of a key (paragraphs, verbs, sentences of a document), as columns a_* and b_*."""
    a, b = (rows.select(*[F.col(c).alias(c if c == key else f"{p}_{c}") for c in rows.columns]) for p in "ab")
    return a.join(b, key).where(F.col(f"a_{n}") < F.col(f"b_{n}"))
