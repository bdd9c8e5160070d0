"""Lookup within several edits against the quadratic table, on all words of the conversations."""

import random

import pytest

from spanweave.operators import automaton as A
from spanweave.operators.matching import tokens
from tests.test_two_phase import edits

CONVERSATIONS, ITEMS = "/root/testdata/sf0.001/conversations.parquet", "/root/testdata/sf0.001/benchmark.parquet"


def rows_of(df):
    return {(r.word, r.entry, r.distance) for r in df.collect() if r.error is None}


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_equals_brute_force(spark, k):
    rng = random.Random(k)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(120)}
    entries = {"".join(rng.choice("abéx") for _ in range(rng.randrange(1, 9))) for _ in range(150)}
    want = {(w, e, edits(w, e)) for w in words for e in entries if edits(w, e) <= k}
    asked = spark.createDataFrame([(w,) for w in [*words, *list(words)[:5], "", None]], "word string")
    held = spark.createDataFrame([(e,) for e in [*entries, *list(entries)[:5], "", None]], "entry string")
    for block, chunk in ((A.BLOCK, A.CHUNK), (7, 11)):
        assert rows_of(A.within_edits(asked, held, k, block=block, chunk=chunk)) == want
    first = {}
    for w, e, d in want:
        first[w] = min(first.get(w, (9, "")), (d, e))
    assert rows_of(A.within_edits(asked, held, k, result_selection="first")) == {(w, e, d) for w, (d, e) in first.items()}


def test_all_words_of_the_conversations(spark):
    from pyspark.sql import functions as F

    of = lambda path, name: spark.read.parquet(path).select(F.explode(tokens(F.col("text"))).alias(name))
    asked, held = of(CONVERSATIONS, "word").distinct(), of(ITEMS, "entry").distinct()
    near = asked.crossJoin(held).select("word", "entry", F.levenshtein("word", "entry", 3).alias("distance")).where("distance >= 0")
    assert rows_of(A.within_edits(asked, held, 3)) == {tuple(r) for r in near.collect()}


def test_parameters(spark):
    asked = spark.createDataFrame([("ab",), ("abcdefgh",)], "word string")
    held = spark.createDataFrame([("ab",), ("abc",), ("abcdefgx",)], "entry string")
    assert rows_of(A.within_edits(asked, held, 1, min_length=3)) == {("abcdefgh", "abcdefgx", 1)}
    small, large = A.Automaton("ab", 1).size(10_000), A.Automaton("abcdefgh", 1).size(10_000)
    assert small < large
    got = {(r.word, r.entry, r.error) for r in A.within_edits(asked, held, 1, state_limit=small).collect()}
    assert got == {("ab", "ab", None), ("ab", "abc", None), ("abcdefgh", None, "state limit exceeded")}
    assert {r.error for r in A.within_edits(asked, held, 1, state_limit=large).collect()} == {None}
    assert A.within_edits(asked, held.limit(0), 1).count() == A.within_edits(asked.limit(0), held, 1).count() == 0
    for bad in ({"max_dist": -1}, {"max_dist": 1, "state_limit": 0}, {"max_dist": 1, "result_selection": "last"}):
        with pytest.raises(ValueError):
            A.within_edits(asked, held, **bad)
