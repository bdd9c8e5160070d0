"""Hyphenation by patterns, readability with word tables and Osman's formula, against plain loops."""

import re

import pytest
from pyspark.sql import functions as F

from spanweave.operators import hyphenation, lookup, text_measures, word_lists


def plain_places(word, patterns, left=2, right=2):
    edged = "." + word.lower() + "."
    levels = [0] * (len(edged) + 1)
    for p in patterns:
        letters, digits, seen = re.sub(r"\d", "", p), {}, 0
        for c in p:
            if c.isdigit():
                digits[seen] = int(c)
            else:
                seen += 1
        for i in range(len(edged) - len(letters) + 1):
            if edged[i : i + len(letters)] == letters:
                for at, v in digits.items():
                    levels[i + at] = max(levels[i + at], v)
    return [k - 1 for k in range(1, len(edged)) if levels[k] % 2 and left <= k - 1 <= len(word) - right]


WORDS = ["hyphenation", "Table", "übertragung", "a", "", "quatre", "strength", "reading", "antidisestablishmentarianism", "niño", "table", "x" * 3000 + "ana" * 500]


@pytest.mark.parametrize("patterns", [["hy3ph", "he2n", "hena4", "hen5at", "1na", "n2at", "1tio", "2io", "o2n", ".re1a", "4ng.", "1d"], hyphenation.open_syllables(), ["zz9"]])
@pytest.mark.parametrize("edges", [(2, 2), (1, 1)])
def test_places_of_breaks(spark, patterns, edges):
    words = spark.createDataFrame([(w, 1) for w in WORDS + [None, "table"]], "word string, more int")
    got = {r.word: r.places for r in hyphenation.break_places(words, spark.createDataFrame([(p,) for p in patterns], "pattern string"), *edges).collect()}
    assert got == {w: plain_places(w, patterns, *edges) for w in WORDS}


def test_a_known_word(spark):
    patterns = ["hy3ph", "he2n", "hena4", "hen5at", "1na", "n2at", "1tio", "2io", "o2n"]
    rows = hyphenation.break_places(spark.createDataFrame([("hyphenation",)], "word string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    at = rows.first().places
    assert "-".join("hyphenation"[i:j] for i, j in zip([0, *at], [*at, 11])) == "hy-phen-ation"
    assert hyphenation.syllable_counts(rows.select("word"), spark.createDataFrame([], "pattern string")).first().syllables == 1


def test_lookup_is_the_same_beyond_its_bound(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else (f"k{i}" if i % 2 else None)) for i in range(300)], "i int, k string")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(100)], "k string, v int")
    small, large = (sorted(map(str, lookup.lookup(rows, table, "k", bound).select("i", "k", "v").collect())) for bound in (1000, 10))
    assert small == large and len(small) == 300


def test_readability_with_tables(spark):
    texts = {1: "The reading of hyphenation tables. The tables! Reading again?", 2: "", 3: None, 4: "...", 5: "the"}
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id bigint, text string, word string")
    easy = spark.createDataFrame([("the",), ("of",), ("the",), (None,), ("unused",)], "word string")
    syll = spark.createDataFrame([("reading", 2), ("hyphenation", 4), ("tables", 2), ("again", 2)], "word string, syllables int")
    counts = {r.doc_id: r.asDict() for r in word_lists.list_counts(docs, easy, syll).collect()}
    assert set(counts) == {1, 5}
    assert {k: counts[1][k] for k in ("w", "s", "syll", "mono", "poly", "long7", "new", "hard")} == {"w": 9, "s": 3, "syll": 17, "mono": 3, "poly": 1, "long7": 3, "new": 4, "hard": 4}
    values = {(r.doc_id, r.label): r.value for r in word_lists.list_readability(docs, easy, syll).collect()}
    assert values[1, "difficult_words"] == 4 and values[5, "difficult_words"] == 0
    assert values[1, "dale_chall_readability_score"] == pytest.approx(0.1579 * 100 * 4 / 9 + 0.0496 * 3 + 3.6365)
    assert values[5, "spache_readability"] == pytest.approx(0.141 + 0.839)
    assert word_lists.list_readability(docs.limit(0), easy, syll).count() == 0
    doubled = {r.doc_id: r.w for r in word_lists.list_counts(docs.union(docs), easy, syll).collect()}
    assert doubled[1] == 18


def test_rare_and_common_words_count_alike(spark):
    texts = [(1, "the cat the reading reading reading."), (1, "The tables. zzz!"), (None, "reading the"), (2, "unknown unknown"), (3, "# 1 2")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    easy = spark.createDataFrame([("the",), ("cat",)], "word string")
    syll = spark.createDataFrame([("reading", 2), ("tables", 2), ("unknown", 3)], "word string, syllables int")
    of = lambda bound, counts=None: sorted(map(str, word_lists.list_counts(docs, easy, syll, counts, bound).collect()))
    every = of(100)
    assert len(every) == 3 and of(0) == of(2) == of(3) == of(100, word_lists.occurrences(docs)) == every
    one = word_lists.list_counts(docs, easy, syll, bound=2).where("doc_id = 1").first().asDict()
    assert {k: one[k] for k in ("w", "s", "syll", "mono", "poly", "long7", "new", "hard")} == {"w": 9, "s": 3, "syll": 13, "mono": 5, "poly": 0, "long7": 3, "new": 3, "hard": 2}


def test_a_text_is_one_row_of_its_common_words_before_it_is_shuffled(spark):
    docs = spark.createDataFrame([(i, f"the reading of the tables {'abcdefgh'[i]}x") for i in range(8)], "doc_id bigint, text string")
    words = spark.createDataFrame([("the", 1)], "word string, syllables int")
    plan = word_lists.list_counts(docs, words, words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.count("BroadcastHashJoin") >= 1
    assert word_lists.word_counts(docs.repartition(5, "doc_id"))._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_words_are_dealt_over_many_tasks_before_they_are_cut(spark):
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    counts = hyphenation.syllable_counts(words, spark.createDataFrame([("1na",)], "pattern string"))
    assert counts.rdd.getNumPartitions() >= 16 * spark.sparkContext.defaultParallelism
    assert {r.word: r.syllables for r in counts.collect()} == {w: len(plain_places(w, ["1na"])) + 1 for w in WORDS}


def test_commonest_words(spark):
    docs = spark.createDataFrame([("b a b c.",), ("C b",), (None,)], "text string")
    assert [r.word for r in word_lists.commonest_words(docs, 2).collect()] == ["b", "c"]


def plain_osman(text):
    marks = "َُِ"
    words = text.split()

    def syllables(t):
        kept = re.sub(r"[^\w\s'ً-ْ]", "", t)
        long = len(re.findall(f"[{marks}](?=[اوي])", kept))
        short = len(re.findall(f"[{marks}]", kept)) - long
        stress = len(re.findall("[ًٌٍّ]", t))
        if short == 0:
            short = len(re.sub("[اى?.!,\\s*]", "", t)) - 2
        return short + 2 * (long + stress)

    bare = [re.sub(r"[^\w]", "", re.sub("[ً-ٓٗ٘]", "", w)) for w in words]
    hard = sum(len(b) > 5 for b in bare)
    complex_ = sum(len(re.findall("[ً-ّ]", w)) > 5 for w in words)
    faseeh = sum(syllables(w) > 5 and bool(re.search("[ئءؤذظ]|وا|ون", w)) for w in words)
    s = max(len(re.findall("[.!?]+", text)), 1)
    return 200.791 - 1.015 * (len(words) / s) - 24.181 * ((complex_ + hard + syllables(text) + faseeh) / len(words))


@pytest.mark.parametrize("text", ["كَتَبَ الوَلَدُ الدَّرْسَ. ذَهَبُوا!", "المدرسون يقرأون الكتب", "يَتَضَاءَلُونَ كَثِيراً جِدّاً", "plain words here.", "مَكتوب قَلَم."])
def test_osman(spark, text):
    got = text_measures.osman(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "  ")], "doc_id bigint, text string")).collect()
    assert [r.doc_id for r in got] == [1] and got[0].value == pytest.approx(plain_osman(text))
