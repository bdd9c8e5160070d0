"""Dictionary lookup within any number of edits: a Levenshtein automaton run over a trie of the dictionary.

A word of n letters has an automaton whose states are max_dist + 1 bit vectors of n + 1 places; its transitions are made as they are
needed. The trie is walked with it: a branch ends where no place is left in reach, so equal beginnings are judged once and far ones
never.

The dictionary is dealt in blocks of words of near lengths, at most some `block` words each, and a word goes to the blocks that lie within
max_dist of its length, so neither the dictionary nor the words need fit in a worker. Each task builds the trie of one block and
looks up one chunk of words.

state_limit bounds the automaton itself: the states that a word can reach, over its own letters and any other one. It doesn't depend on the
dictionary; a word beyond it is told with an error and isn't looked up.

Defined results: null and empty words, and words shorter than min_length, have no row; a word of the dictionary is listed once however often it
is given; distances count code points; ties under result_selection `first` go to the smallest entry in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanweave.session import ship_package

#: Words of the dictionary in one trie, words looked up in one, and lengths that share blocks.
BLOCK, CHUNK, BAND = 20_000, 500, 4
_OTHER = ""


class Automaton:
    """Of one word: accepts what lies within k edits of it. A state is a tuple of bit vectors; bit i of vector j says that the word's first i letters can
    become what was read with j edits."""

    def __init__(self, word: str, k: int):
        self.masks: dict[str, int] = {}
        for i, c in enumerate(word):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.full, self.last, self.k = (1 << len(word) + 1) - 1, 1 << len(word), k
        self.start = tuple((1 << min(j, len(word)) + 1) - 1 for j in range(k + 1))
        self.known: dict[tuple, tuple | None] = {}

    def step(self, state: tuple, letter: str) -> tuple | None:
        """The state behind one more letter, None if nothing is in reach."""
        key = state, letter if letter in self.masks else _OTHER
        if key in self.known:
            return self.known[key]
        mask, out, before = self.masks.get(letter, 0), [], 0
        for j, bits in enumerate(state):
            new = (bits & mask) << 1
            if j:
                # a letter more, another letter, a letter of the word left out
                new |= state[j - 1] | state[j - 1] << 1 | before << 1
            before = new & self.full
            out.append(before)
        found = self.known[key] = tuple(out) if before else None
        return found

    def distance(self, state: tuple) -> int | None:
        """Edits between the word and what was read, None beyond k."""
        return next((j for j, bits in enumerate(state) if bits & self.last), None)

    def size(self, limit: int) -> int:
        """States that can be reached, counted up to limit + 1."""
        seen, todo = {self.start}, [self.start]
        while todo and len(seen) <= limit:
            state = todo.pop()
            for c in (*self.masks, _OTHER):
                then = self.step(state, c)
                if then and then not in seen:
                    seen.add(then)
                    todo.append(then)
        return len(seen)


def trie(words: list[str]) -> dict:
    """Nested dicts by letter; the word itself under the empty string."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[_OTHER] = w
    return root


def lookup(root: dict, word: str, k: int) -> Iterator[tuple[str, int]]:
    """(entry, distance) of all entries within k edits."""
    automaton = Automaton(word, k)
    todo = [(root, automaton.start)]
    while todo:
        node, state = todo.pop()
        for c, below in node.items():
            if c == _OTHER:
                d = automaton.distance(state)
                if d is not None:
                    yield below, d
            else:
                then = automaton.step(state, c)
                if then:
                    todo.append((below, then))


def _band(n: Column) -> Column:
    return F.floor(n / BAND).cast("int")


def within_edits(words: DataFrame, dictionary: DataFrame, max_dist: int, min_length: int = 0, state_limit: int | None = None, result_selection: str = "all", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(word, entry, distance, error) of words (word) and dictionary (entry): all entries within max_dist edits, or with result_selection `first`
    the nearest. A word beyond the state limit has one row, with an error alone."""
    if max_dist < 0 or min_length < 0 or state_limit is not None and state_limit < 1:
        raise ValueError("max_dist and min_length are 0 or more, state_limit 1 or more")
    if result_selection not in ("all", "first"):
        raise ValueError("result_selection is all or first")
    ship_package(words.sparkSession)
    n = F.char_length("word")
    asked = words.select("word").where((n > 0) & (n >= min_length)).distinct()
    held = dictionary.select("entry").where(F.char_length("entry") > 0).distinct().withColumn("band", _band(F.char_length("entry")))
    near = asked.select("word", F.explode(F.sequence(_band(F.greatest(n - max_dist, F.lit(0))), _band(n + max_dist))).alias("band"))
    # a band's blocks and chunks: one row a band, so as many rows as the longest word has bands
    sizes = held.groupBy("band").agg(F.ceil(F.count("*") / block).alias("blocks")).join(near.groupBy("band").agg(F.ceil(F.count("*") / chunk).alias("chunks")), "band")
    spread = lambda text, of: F.pmod(F.xxhash64(text), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), (F.col(of) - 1).cast("int")))
    left = held.join(sizes, "band").withColumn("b", spread("entry", "blocks")).select("band", "b", every("chunks").alias("c"), "entry")
    right = near.join(sizes, "band").withColumn("c", spread("word", "chunks")).select("band", every("blocks").alias("b"), "c", "word")

    def run(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        root = trie(sorted(entries["entry"])) if len(asked) else {}
        rows = []
        for word in asked["word"]:
            if state_limit is not None and Automaton(word, max_dist).size(state_limit) > state_limit:
                rows.append((word, None, None, "state limit exceeded"))
            else:
                rows += [(word, entry, d, None) for entry, d in lookup(root, word, max_dist)]
        return pd.DataFrame(rows, columns=["word", "entry", "distance", "error"]).astype({"distance": "Int64"})

    keys = ["band", "b", "c"]
    # few bytes, but much work: a number that is asked for isn't cut down to fit the bytes
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.repartition(parts, *keys), right.repartition(parts, *keys)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "word string, entry string, distance bigint, error string")
    bad = found.where("error is not null").distinct()
    good = found.where("error is null")
    if result_selection == "first":
        good = good.withColumn("place", F.row_number().over(W.partitionBy("word").orderBy("distance", "entry"))).where("place = 1").drop("place")
    return good.unionByName(bad)
