"""Measures of documents stay in the partitions that their texts were dealt to."""

from pyspark.sql import functions as F

from spanweave.operators import cohesion, dependencies, spans, tagging
from spanweave.plans import measures

TEXTS = [(1, "They walked slowly and the red dogs barked. He is talking, not walking!\nWir gehen nicht"), (2, "1999. 7!"), (3, "walked Walked walking dogs dog"), (4, None)]
#: Plans are read as they are before they run.
EXCHANGE = "Exchange hashpartitioning"


def dealt(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string").repartition("doc_id")


def rows(df):
    return sorted((r.doc_id, r.label, r.error, None if r.value is None else round(r.value, 9)) for r in df.collect())


def test_word_information_of_sentence_rows_shuffles_nothing_and_equals_that_of_token_rows(spark):
    got = cohesion.word_information(tagging.rule_sentences(dealt(spark)))
    assert rows(got) == rows(cohesion.word_information(tagging.rule_tokens(dealt(spark)))) and len(rows(got)) == 26
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count(EXCHANGE) == 1
    assert [r.value for r in got.where("doc_id = 3 AND label = 'LDTTRa'").collect()] == [0.8]


def test_word_means_of_sentence_rows_equal_those_of_token_rows(spark):
    norms = spark.createDataFrame([("walked", 2.0), ("dogs", 4.0), ("talking", None)], "word string, x double")
    of = lambda tokens: cohesion.word_means(tokens, norms.select("word", F.col("x")), {"X": "x"})
    assert rows(of(tagging.rule_sentences(dealt(spark)))) == rows(of(tagging.rule_tokens(dealt(spark)))) == [(1, "X", None, 3.0), (3, "X", None, round(8 / 3, 9))]


def test_texts_are_dealt_before_they_are_cut(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    plan = spans.tokens(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(EXCHANGE) == 1 and plan.index("Generate") < plan.index(EXCHANGE)


def test_texts_of_the_queries_on_sentences_are_dealt_over_several_tasks_a_core(spark):
    docs = measures._docs(spark, "/root/testdata/sf0.001")
    assert docs.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_ratios_of_sentence_rows_shuffle_nothing_and_equal_those_of_word_rows(spark):
    into = {"id": "pos + 1", "head": measures._L2, "upos": "pos_coarse", "feats": measures._FEATS, "deprel": measures._REL}
    rooted = tagging.rule_sentences(dealt(spark), ("pos", "text", "pos_coarse", "tag", "dep_type"), into)
    sents = rooted.select("doc_id", F.expr("para * 100000 + sent").alias("sent"), F.col("toks").alias("ws"))
    got = dependencies.syntactic_complexity(sents)
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count(EXCHANGE) == 1
    value = lambda df: sorted((r.doc_id, r.label, r.value) for r in df.collect())
    assert value(got) == value(dependencies.syntactic_complexity(sents.select("doc_id", "sent", F.inline("ws")))) and got.count() == 28
    empty = spark.createDataFrame([(1, 0, [])], "doc_id bigint, sent bigint, ws array<struct<id int, head int, upos string, feats string, deprel string>>")
    assert {r.value for r in dependencies.syntactic_complexity(empty).collect()} == {0.0}


def test_all_pairs_of_sentence_rows_shuffle_nothing_and_equal_those_of_token_rows(spark):
    texts = [*TEXTS, (5, "Dogs barked. Cats ran and dogs walked! It barked, it ran.\nDogs. Cats saw it? They.\nRed dogs barked")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = cohesion.all_pairs(tagging.rule_sentences(docs))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == rows(cohesion.all_pairs(tagging.rule_tokens(docs))) == rows(cohesion.all_pairs(tagging.rule_sentences(docs), 1, 1))
    # seven sentences: dogs are in four, cats and ran in two each, in other pairs
    assert {r.label: round(r.value, 6) for r in got.where("doc_id = 5").collect()}["CRFNOa"] == round(8 / 21, 6)


def test_pairs_that_share_no_word_are_not_looked_at():
    import numpy as np

    from spanweave.operators.sentence_pairs import Pairs, distinct

    pick, size = np.random.default_rng(3), 60
    sets, firsts = pick.random((size, 12)) < 0.2, np.array([0, 1, 23])
    doc = np.repeat([0, 1, 2], [1, 22, 37])
    held = distinct(np.nonzero(sets.T)[0] * size + np.nonzero(sets.T)[1])
    common = (sets.astype(int) @ sets.T) * np.triu(doc[:, None] == doc, 1)
    either = np.maximum(sets.sum(1)[:, None] + sets.sum(1) - common, 1)
    of = lambda x: [x[doc == d].sum() for d in range(3)]
    for most in (1, 50, 1 << 20):
        pairs = Pairs(firsts, size, most)
        assert pairs.meeting(held, held).tolist() == of(common > 0)
        assert np.allclose(pairs.shares(held), [of(common / either), of((common / either) ** 2)])
        # what is held is words that are met, block by block
        assert sum(len(cell) for *_, cell in pairs._met(held, held)) == common.sum()
    assert pairs.pairs.tolist() == [0, 231, 666]


def test_neighbouring_sentences_stream_without_a_window(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    got = cohesion.adjacent(tagging.rule_sentences(docs))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan and plan.index("HashAggregate") < plan.index("MapInArrow")
    assert rows(got) == rows(cohesion.adjacent(tagging.rule_tokens(docs)))


def test_stretches_carry_a_row_or_keep_documents_whole():
    import pyarrow as pa

    from spanweave.operators.sentence_pairs import stretches

    batch = pa.RecordBatch.from_pydict({"n": [1, 2, 3, 1, 1, 2], "toks": [["a"]] * 6})
    batches = [batch.slice(0, 2), batch.slice(2, 0), batch.slice(2, 3), batch.slice(5)]
    of = lambda **k: [b.column("n").to_pylist() for b in stretches(iter(batches), 2, **k)]
    assert of() == [[1, 2, 3, 1], [1, 2]] and of(whole=False) == [[1, 2], [2, 3, 1, 1], [1, 2]]


def test_edit_distances_of_many_pairs_at_once(monkeypatch):
    import numpy as np

    from spanweave.operators import edits

    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            made = [i]
            for j, d in enumerate(b, 1):
                made.append(min(row[j] + 1, made[-1] + 1, row[j - 1] + (c != d)))
            row = made
        return row[-1]

    pick = np.random.default_rng(5)
    for few in (1, 1 << 20):
        monkeypatch.setattr(edits, "FEW", few)
        for letters in ("ab", "abc dé", [chr(0x4E00 + i) for i in range(300)] + ["😀"]):
            texts = ["".join(pick.choice(list(letters), n)) for n in (0, 1, 7, 63, 64, 65, 100, 127, 128, 129, 200, 600)]
            left, right = (x.ravel() for x in np.meshgrid(np.arange(12), np.arange(12)))
            got, sizes = edits.edit_distances(texts, left, right)
            assert sizes.tolist() == [len(t) for t in texts]
            assert got.tolist() == [brute(texts[i], texts[j]) for i, j in zip(left, right, strict=True)]


def test_common_words_meet_their_frequencies_where_sentences_lie(spark):
    listed = spark.createDataFrame([("walking", 9.0), ("dogs", 5.0), ("dog", None), ("walked", 2.0), ("#3", 7.0), ("they", 0.5)], "word string, f double")
    of = lambda tokens, **k: rows(cohesion.frequency_means(tokens, listed, **k))
    want = of(tagging.rule_tokens(dealt(spark)))
    for bound in (0, 1, 2, 100):
        assert of(tagging.rule_sentences(dealt(spark)), bound=bound) == want
    # of text 3: walked, walked, walking, dogs, dog; dog has no frequency
    assert [v for d, k, _, v in want if d == 3 and k == "WRDFRQc_wiki10000"] == [(2 + 2 + 9 + 5 + 0) / 5]
