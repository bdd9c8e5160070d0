"""Operators that no SQL checks: small fixtures and brute force."""

import gzip
import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.functions import values
from spanweave.operators import cohesion, dependencies, filters, graphs, grouping, matching, scoring, spans, tagging, text_measures
from spanweave.sources import documents
from spanweave.workspace import Workspace

_PICK = random.Random(3)
TEXTS = [
    (1, "The small dogs chased a cat in the garden, and it jumped. The cat was not happy! Dogs often run quickly.\nA musical box played. He wanted to broken dogs and the cat."),
    (2, "One sentence only"),
    (3, ""),
    (4, None),
    (5, " ".join(_PICK.choice("alpha beta gamma delta jumped playing slowly the he red of and".split()) + ("." if k % 9 == 8 else "") + ("\n" if k % 40 == 39 else "") for k in range(400))),
]


@pytest.fixture(scope="module")
def tokens(spark):
    return tagging.rule_tokens(spark.createDataFrame(TEXTS, "doc_id bigint, text string")).cache()


def sentences(tokens):
    out = {}
    for r in sorted(tokens.collect(), key=lambda r: (r.doc_id, r.para, r.sent, r.pos)):
        out.setdefault(r.doc_id, {}).setdefault((r.para, r.sent), []).append(r)
    return out


def values_of(df):
    return {(r.doc_id, r.label): (r.value, r.error) for r in df.collect()}


def test_all_pairs_of_sentences(spark, tokens):
    for block, dense in ((256, cohesion.DENSE), (3, cohesion.DENSE), (3, 0), (256, 40)):
        got = values_of(cohesion.all_pairs(tokens, block, dense))
        for doc, sents in sentences(tokens).items():
            found = {k: [] for k in ("CRFNOa", "CRFAOa", "CRFSOa", "CRFCWOa", "SYNSTRUTt")}
            for (_, a), (_, b) in combinations(sents.items(), 2):
                pick = lambda s, f, *c: {getattr(t, f) for t in s if t.pos_coarse in c}
                noun = [pick(s, "text", "NOUN") for s in (a, b)]
                stem, pron = [pick(s, "lemma", "NOUN") for s in (a, b)], [pick(s, "text", "PRON") for s in (a, b)]
                content = [pick(s, "lemma", "NOUN", "VERB", "ADJ", "ADV") for s in (a, b)]
                found["CRFNOa"].append(bool(noun[0] & noun[1]))
                found["CRFAOa"].append(bool(stem[0] & stem[1] or pron[0] & pron[1]))
                found["CRFSOa"].append(bool(stem[0] & content[1]))
                found["CRFCWOa"].append(len(content[0] & content[1]) / len(content[0] | content[1]) if content[0] | content[1] else 0)
            paras = {}
            for (p, _), s in sents.items():
                paras.setdefault(p, set()).update((t.dep_type, t.pos_coarse) for t in s if not t.is_punct)
            alike = [len(a & b) / len(a | b) for a, b in combinations(paras.values(), 2)]
            assert got[doc, "SYNSTRUTt"][0] == pytest.approx(np.mean(alike) if alike else 0.0, abs=1e-6)
            del found["SYNSTRUTt"]
            for k, v in found.items():
                value, error = got[doc, k]
                assert (value is None and error) if not v else value == pytest.approx(np.mean(v), abs=1e-6)
            if found["CRFCWOa"]:
                assert got[doc, "CRFCWOad"][0] == pytest.approx(np.std(found["CRFCWOa"]), abs=1e-6)
    assert {d for d, _ in got} == {1, 2, 5}


def test_ordered_diversity(spark, tokens):
    def factors(ws):
        n, types, size = 0.0, set(), 0
        for w in ws:
            types.add(w)
            size += 1
            if size >= 10 and len(types) / size < 0.72:
                n, types, size = n + 1, set(), 0
        return n + ((1 - len(types) / size) / 0.28 if size else 0)

    got = values_of(cohesion.ordered_diversity(tokens))
    for doc, sents in sentences(tokens).items():
        ws = [t.text for s in sents.values() for t in s if not t.is_punct]
        both = [len(ws) / f if (f := factors(x)) else len(ws) for x in (ws, ws[::-1])]
        assert got[doc, "LDMTLDa"][0] == pytest.approx(sum(both) / 2)
        if len(ws) < 50:
            assert got[doc, "LDVOCDa"] == (None, "no value")
    ws = [t.text for s in sentences(tokens)[5].values() for t in s if not t.is_punct]
    sizes, rng = np.arange(35.0, 51.0), np.random.default_rng(1)
    ratios = cohesion.expected_ratios(ws, sizes)
    sampled = [np.mean([len(set(rng.choice(ws, int(n), replace=False))) / n for _ in range(2000)]) for n in sizes[[0, -1]]]
    assert ratios[[0, -1]] == pytest.approx(sampled, abs=0.005)
    off = lambda d: ((d / sizes * (np.sqrt(1 + 2 * sizes / d) - 1) - ratios) ** 2).sum()
    d = got[5, "LDVOCDa"][0]
    assert off(d) <= min(off(x) for x in np.linspace(0.5, 100, 2000)) + 1e-9


def test_second_language_readability_is_null_if_a_part_is(spark):
    rows = [(1, "CRFCWO1", 0.1, None), (1, "SYNSTRUTa", 0.2, None), (1, "WRDFRQmc_wiki10000", 1.0, None), (2, "CRFCWO1", 0.1, None), (2, "SYNSTRUTa", None, "no value"), (2, "WRDFRQmc_wiki10000", 1.0, None)]
    got = values_of(cohesion.second_language(spark.createDataFrame(rows, "doc_id bigint, label string, value double, error string")))
    assert got[1, "RDL2_synstruta"][0] == pytest.approx(-45.032 + 5.223 + 12.2612 + 22.205) and got[2, "RDL2_synstruta"] == (None, "no value")


def test_ratio_of_incidences(spark):
    rows = [(1, "SMCAUSvp", 6.0), (1, "SMCAUSv", 3.0), (2, "SMCAUSvp", 6.0), (2, "SMCAUSv", 0.0)]
    got = values_of(cohesion.ratio(spark.createDataFrame(rows, "doc_id bigint, label string, value double"), "SMCAUSr", "SMCAUSvp", "SMCAUSv"))
    assert got == {(1, "SMCAUSr"): (2.0, None), (2, "SMCAUSr"): (None, "no value")}


def test_syntactic_complexity_of_one_sentence(spark):
    rows = [(1, 0, 1, 2, "NOUN", None, "nsubj"), (1, 0, 2, 0, "VERB", "VerbForm=Fin", "root"), (1, 0, 3, 4, "ADJ", None, "amod"), (1, 0, 4, 2, "NOUN", None, "obj"), (1, 0, 5, 2, "VERB", "VerbForm=Inf", "xcomp"), (1, 0, 6, 2, "PUNCT", None, "punct"), (2, 0, 1, 0, "NOUN", None, "root")]
    got = {(r.doc_id, r.label): r.value for r in dependencies.syntactic_complexity(spark.createDataFrame(rows, "doc_id bigint, sent bigint, id bigint, head bigint, upos string, feats string, deprel string")).collect()}
    assert len(got) == 28
    assert (got[1, "MLC"], got[1, "MLT"], got[1, "C/S"], got[1, "DC/C"], got[1, "CT/T"], got[1, "CN/C"], got[1, "VP/T"]) == (2.5, 5, 2, 0.5, 1, 0.5, 1)
    assert got[2, "MLC"] == 0 and got[2, "MLS"] == 1


def test_graph_of_a_document(spark):
    rows = [(1, "s1", "Sentence", 0, 20, "S"), (1, "t1", "Token", 0, 5, "a"), (1, "t2", "Token", 6, 12, "b"), (1, "t3", "Token", 25, 30, "a"), (1, "p1", "POS_X", 0, 3, "first"), (1, "p2", "POS_Y", 7, 9, "last"), (2, "t9", "Token", 0, 5, "c")]
    ann = spark.createDataFrame(rows, "doc_id bigint, ann_id string, type string, begin bigint, end bigint, label string")
    e = graphs.edges(ann, "Sentence", "Token", "POS")
    assert {(r.source, r.target, r.label, r.directed) for r in e.collect()} == {("s1_1", "t1_1", "last", True), ("s1_1", "t2_1", "last", True)}
    assert {r.id for r in graphs.nodes(ann.where("type = 'Token'"), unique=True).collect()} == {"a", "b", "c"}
    found = graphs.groups(Workspace(spark, "t"), e, graphs.nodes(ann), ["Sentence", "Token"], "x")
    assert {(r.id, r.group) for r in found.collect()} == {(i, "gxs1_1") for i in ("s1_1", "t1_1", "t2_1")}
    assert graphs.groups(Workspace(spark, "t"), e, graphs.nodes(ann), ["Token"]).collect() == []


def test_joins_of_spans(spark):
    mentions = spark.createDataFrame([(1, 0, 10, "m"), (1, 20, 30, "n")], "doc_id bigint, begin bigint, end bigint, name string")
    categories = spark.createDataFrame([(1, 0, 10, "x", 0.2, "geo;a"), (1, 2, 9, "y", 0.9, "geo"), (1, 2, 9, "z", 0.95, "b")], "doc_id bigint, begin bigint, end bigint, value string, score double, tags string")
    assert {(r.name, r.value) for r in graphs.disambiguate(mentions, categories, "geo").collect()} == {("m", "y"), ("n", None)}
    words = spark.createDataFrame([(1, 0, 4, "hi"), (1, 4, 12, "you"), (1, None, 3, "lost")], "doc_id bigint, begin bigint, end bigint, word string")
    turns = spark.createDataFrame([(1, 0, 5, "A"), (1, 5, 20, "B")], "doc_id bigint, begin bigint, end bigint, speaker string")
    assert {(r.word, r.speaker) for r in graphs.turns_with_speakers(words, turns).collect()} == {("hi", "A"), ("you", "B")}
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 10.0), (2, 0, 90.0, 5.0, 200.0, 90.0), (3, 0, 100.0, 10.0, 300.0, 20.0), (4, 1, 0.0, 0.0, 9.0, 9.0)], "id int, page int, x0 double, y0 double, x1 double, y1 double")
    met = graphs.overlapping_boxes(boxes, boxes).where("a_id < b_id").collect()
    assert {(r.a_id, r.b_id) for r in met} == {(1, 2), (2, 3)}


def test_entities_of_two_documents(spark):
    rows = [("p", 0, 1, "Berlin"), ("p", 0, 2, "Rom"), ("p", 1, 3, "berlin"), ("p", 1, 4, "Barlin"), ("q", 1, 5, "Berlin")]
    got = graphs.matched_documents(spark.createDataFrame(rows, "pipeline_id string, doc_index int, entity_id int, text string"), 0.8).collect()
    assert {(r.entity_a, r.entity_b, round(r.similarity, 3)) for r in got} == {(1, 3, 1.0), (1, 4, 0.833)}


def test_grouped_rows(spark):
    spans = spark.createDataFrame([(1, 0, 5, "a", 0.3, "x"), (1, 0, 5, "b", 0.9, "y"), (1, 0, 7, "c", 0.1, "x")], "doc_id bigint, begin bigint, end bigint, value string, score double, name string")
    assert {(r.end, tuple(t.value for t in r.topics)) for r in grouping.by_span(spans, "value", "score").collect()} == {(5, ("b", "a")), (7, ("c",))}
    merged = grouping.by_begin(spans, "name").first()
    assert (merged.end, merged.name) == (5, ["x", "y"])
    vectors = spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0]), (2, None)], "k int, v array<double>")
    assert {r.k: r["mean"] for r in grouping.vector_means(vectors, "k", "v", 2).collect()} == {1: [2.0, 4.0], 2: [0.0, 0.0]}


def test_filters(spark):
    one = spark.createDataFrame([("hello world", 6, 11, "VVFIN", "a1", "1", "- |")], "text string, b int, e int, tag string, w string, d string, p string")
    r = one.select(
        filters.window_checked(F.col("b"), F.col("e"), F.col("text")).alias("window"), filters.recomposed(F.col("text"), F.col("b"), F.col("e"), F.lit("there")).alias("new"), filters.function_word(F.col("tag")).alias("f"),
        filters.function_word(F.lit("APPR")).alias("g"), filters.checkable(F.col("w")).alias("c1"), filters.checkable(F.col("d")).alias("c2"), filters.punctuation(F.col("p")).alias("p"), filters.above(F.lit(None).cast("double"), None).alias("a"), filters.above(F.lit(0.4), 0.5).alias("b"),
    ).first()
    assert tuple(r) == ("world", "hello there", False, True, True, False, True, True, False)
    with pytest.raises(Exception, match="outside"):
        one.select(filters.window_checked(F.lit(3), F.lit(99), F.col("text"))).collect()
    layer = spark.createDataFrame([(1, 0, 5, "A"), (1, 6, 9, "A")], "doc_id bigint, begin bigint, end bigint, type string")
    assert filters.without_old(layer, layer.where("begin = 0")).count() == 1
    divs = spark.createDataFrame([("d1", "line"), ("d2", "page")], "id string, div_type string")
    assert [r.id for r in filters.by_ids(divs, "d2, d9,d1").orderBy("place").collect()] == ["d2", "d1"]
    assert [r.id for r in filters.of_div_type(divs, "line;page").collect()] == ["d2"] and filters.of_div_type(divs, "line").count() == 2
    sents = spark.createDataFrame([(1, [("VERB",)]), (2, [("NOUN",)]), (3, []), (4, [("AUX",)] * 151)], "id int, toks array<struct<pos_coarse:string>>")
    assert [r.id for r in filters.eligible(sents).collect()] == [1]
    claims, facts = spark.createDataFrame([(1, "c")], "claim_id int, text string"), spark.createDataFrame([(7, "f"), (8, "g")], "fact_id int, text string")
    pairs = filters.linked(claims, facts, spark.createDataFrame([(1, 7), (1, 8)], "claim_id int, fact_id int"))
    assert {(r.claim_text, r.fact_text) for r in pairs.collect()} == {("c", "f"), ("c", "g")}
    assert filters.pairs_within(spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "doc_id int, n int"), "doc_id", "n").count() == 3


def test_values(spark):
    row = spark.createDataFrame([(["a", "b", "a", "b"], "x</s> <y>\nz", "Dr. Ann (CDU)", " a ;b,c:", [0.5, 0.2], {"p": 0.1, "q": -1.0}, "POSITIVE", '"{\\"k\\": 3}"', '{"k": 4}')], "ws array<string>, m string, t string, tags string, s array<double>, d map<string,double>, l string, j string, i string")
    r = row.select(
        values.phrase_count(F.col("ws"), ["a", "b"]).alias("n"), values.clean_markup(F.col("m")).alias("m"), values.named_groups(F.col("t"), r"^(Dr\.)? ?(\w+) \((\w+)\)$", ["title", "name", "party"]).alias("g"), values.tag_list(F.col("tags")).alias("tags"),
        values.zipped(F.array(F.lit("u"), F.lit("v")), F.col("s")).alias("z"), values.positive_scores(F.col("d")).alias("d"), values.remapped(F.col("d"), {"p": "P"}).alias("e"), values.sign_label(F.col("l")).alias("sign"),
        values.tolerant_json(F.col("j"), "k int")["k"].alias("j"), values.tolerant_json(F.col("i"), "k int")["k"].alias("i"), values.json_tag(F.lit(0.5), F.lit(None).cast("string")).alias("tag"), values.known_type(F.lit("odd"), ["date"], "base").alias("type"),
        values.cross_entropy(F.array(F.lit(-1.0), F.lit(-3.0))).alias("h"), values.machine_written(F.lit(1.0), F.lit(2.0)).alias("mw"), values.stamped(F.timestamp_seconds(F.lit(5))).alias("at"),
    ).first()
    assert r.n == 2 and r.m == "x y z" and tuple(r.g) == ("Dr.", "Ann", "CDU") and r.tags == ["a", "b", "c"] and [tuple(z) for z in r.z] == [("u", 0.5), ("v", 0.2)]
    assert r.d == {"p": 0.1} and r.e == {"P": 0.1, "q": -1.0} and r.sign == 1 and (r.j, r.i) == (3, 4) and r.tag == '{"score":0.5}' and r.type == "base" and r.h == 2 and r.mw and r["at"] == 5


def test_parameters():
    p = values.Parameters({"n": "7", "bad": "x", "far": 99, "reference_time": "2020-01-01"})
    assert p.number("n", least=0, most=10) == 7 and p.number("missing", 3) == 3 and p.number("bad", 1) == 1 and p.number("far", 2, most=10) == 2 and p.number("seed") is None
    assert p.errors == ["bad is no number", "far lies outside of its bounds"] and p.reference_time() == ("2020-01-01", "Europe/Berlin")


def test_spanning_tree_and_dimension():
    assert values.spanning_length(np.array([[0.0, 0.0], [0.0, 1.0], [0.0, 3.0], [4.0, 0.0]])) == pytest.approx(7)
    line = np.random.default_rng(0).random((400, 1)) @ np.ones((1, 3))
    assert values.homology_dimension(line, [50, 100, 200, 400]) == pytest.approx(1.0, abs=0.25) and values.homology_dimension(line[:3], [50, 100]) is None


def test_ngrams_are_linear_and_selected(spark):
    docs = spark.createDataFrame([(1, "New York is new"), (2, ""), (3, None)], "doc_id bigint, text string")
    got = {(r.doc_id, r.pos, r.n, r.phrase) for r in matching.phrases(docs, 2).collect()}
    assert got == {(1, 0, 1, "new"), (1, 1, 1, "york"), (1, 2, 1, "is"), (1, 3, 1, "new"), (1, 0, 2, "new york"), (1, 1, 2, "york is"), (1, 2, 2, "is new")}
    dictionary = spark.createDataFrame([("New York", 5), ("new york", 3)], "phrase string, entry int")
    assert sorted(r.entry for r in matching.tag(docs, dictionary, 2).collect()) == [3, 5]
    assert [r.entry for r in matching.tag(docs, dictionary, 2, "first").collect()] == [3]


def test_differences_count_repeated_rows(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "y")], "doc_id bigint, word string")
    b = spark.createDataFrame([("x", 1), (None, 2), ("z", 3)], "word string, doc_id bigint")
    got = {(r.doc_id, r.word, r.side, r.n) for r in grouping.differences(a, b).collect()}
    assert got == {(1, "x", "first", 1), (3, "y", "first", 1), (3, "z", "second", 1)}
    assert grouping.differences(a, a).collect() == []


def test_fixed_chunks_cover_each_length(spark):
    lengths = spark.createDataFrame([(1, 25), (2, 20), (3, 0), (4, None), (5, 1)], "doc_id bigint, seconds bigint")
    got = {(r.doc_id, r.chunk, r.begin, r.end) for r in spans.fixed_chunks(lengths, F.col("seconds"), 10).collect()}
    assert got == {(1, 0, 0, 10), (1, 1, 10, 20), (1, 2, 20, 25), (2, 0, 0, 10), (2, 1, 10, 20), (5, 0, 0, 1)}


def test_compression_ratio(spark):
    texts = [(1, "ab " * 500), (2, "é"), (3, ""), (4, None)]
    got = {r.doc_id: r.value for r in text_measures.compression_ratio(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {i: round(len(t.encode()) / len(gzip.compress(t.encode())), 3) if t else None for i, t in texts}
    assert got[1] > 20 > 1 > got[2]


def test_loaded_models_evict_the_least_recent():
    loads, models = [], scoring.LoadedModels(2)
    for key in ("a", "b", "a", "c", "a", "b"):
        models.get(key, lambda k=key: loads.append(k))
    assert loads == ["a", "b", "c", "b"] and list(models.held) == ["a", "b"]


def test_dictionaries_of_gzipped_files(spark, tmp_path):
    for name, rows in (("a", "Haus;3\nhaus;2\n"), ("b", "Maus;1\n")):
        (tmp_path / name).mkdir()
        with gzip.open(tmp_path / name / "list.gz", "wt") as out:
            out.write(rows)
    assert {(r.word, r.n) for r in documents.read_dictionary(spark, f"{tmp_path}/*/*.gz", ";").collect()} == {("haus", 5), ("maus", 1)}


TOKEN_ROWS = "doc_id int, para int, sent int, pos int, text string, lemma string, pos_coarse string, tag string, dep_type string, is_punct boolean, tense string"


def token_rows(spark, sentences):
    """(doc, para, sent, [text/lemma/coarse/tag/dep ...]) as token rows."""
    rows = []
    for d, p, s, words in sentences:
        for i, w in enumerate(words.split()):
            text, lemma, coarse, tag, dep = w.split("/")
            rows.append((d, p, s, i, text, lemma, coarse, tag, dep, coarse == "PUNCT", None))
    return spark.createDataFrame(rows, TOKEN_ROWS)


def test_syntax_leaves_punctuation_out_and_compares_paragraphs(spark):
    a, b = "Dogs/dog/NOUN/N/NSUBJ ,/,/PUNCT/P/PUNCT bark/bark/VERB/V/ROOT", "Red/red/ADJ/A/AMOD ,/,/PUNCT/P/PUNCT cars/car/NOUN/N/OBJ"
    t = token_rows(spark, [(1, 0, 0, a), (1, 0, 1, b), (2, 0, 0, a), (2, 0, 1, b), (2, 1, 0, b), (2, 1, 1, a), (3, 0, 0, "Red/red/ADJ/A/AMOD")])
    near, far = values_of(cohesion.adjacent(t)), values_of(cohesion.all_pairs(t))
    assert near[1, "SYNSTRUTa"] == (0.0, None)
    assert far[2, "SYNSTRUTt"] == (1.0, None) and far[1, "SYNSTRUTt"] == (0.0, None)
    # a text of one sentence without a root
    assert all(near[3, k] == (0.0, None) for k in ("SYNLE", "SYNMEDpos", "SYNMEDwrd", "SYNMEDlem", "SYNSTRUTa")) and near[3, "CRFNO1"][0] is None
    assert near[1, "SYNLE"] == (1.0, None)  # words before the root of the sentence that has one


def test_german_passives_and_infinitives(spark):
    t = token_rows(spark, [(1, 0, 0, "Haus/Haus/NOUN/NN/SB wird/werden/AUX/VAFIN/ROOT"), (2, 0, 0, "Haus/Haus/NOUN/NN/SB wird/werden/AUX/VAFIN/ROOT gebaut/bauen/VERB/VVPP/OC"), (3, 0, 0, "Er/er/PRON/P/SB will/wollen/VERB/VM/ROOT es/es/PRON/P/OA bauen/bauen/VERB/VVINF/OC"),
                           (4, 0, 0, "will/wollen/VERB/VM/ROOT bauen/bauen/VERB/VVINF/OC"), (5, 0, 0, "Sie/sie/PRON/P/SB will/wollen/VERB/VM/ROOT es/es/PRON/P/OA nie/nie/ADV/A/MO bauen/bauen/VERB/VVINF/OC"), (6, 0, 0, "Er/er/PRON/P/SB hofft/hoffen/VERB/V/ROOT zu/zu/PART/T/PM bauen/bauen/VERB/VVINF/OC")])
    got = values_of(cohesion.densities(t, "de"))
    assert [got[d, "DRPVAL"][0] for d in (1, 2)] == [0.0, pytest.approx(1000 / 3)]
    assert [got[d, "DRINF"][0] for d in (3, 4, 5, 6)] == [250.0, 0.0, 0.0, 250.0]


def test_diversity_folds_case_and_keeps_letters(spark):
    t = token_rows(spark, [(1, 0, 0, "Dogs/dog/NOUN/N/X dogs/Dog/NOUN/N/X 2024/2024/NUM/C/X it's//PRON/P/X Zürich/Zürich/NOUN/N/X")])
    got = values_of(cohesion.word_information(t))
    assert got[1, "LDTTRa"][0] == pytest.approx(2 / 3) and got[1, "LDTTRc"][0] == pytest.approx(2 / 3)
    assert values_of(cohesion.descriptive(t))[1, "DESWLlt"][0] == pytest.approx((4 + 4 + 0 + 3 + 6) / 5)


def test_tokens_of_all_letters(spark):
    got = tagging.rule_tokens(spark.createDataFrame([(1, "Über die Größe 2024 niño.\n9. ")], "doc_id bigint, text string")).orderBy("pos").collect()
    assert [r.text for r in got] == ["über", "die", "größe", "2024", "niño"] and got[3].pos_coarse == "NUM"


def test_lexicons_of_many_labels(spark):
    t = token_rows(spark, [(1, 0, 0, "a/a/X/X/X b/b/X/X/X")])
    lexicon = spark.createDataFrame([(f"L{i}", "b" if i == 250 else "z") for i in range(300)], "label string, phrase string")
    got = values_of(cohesion.incidences(t, lexicon))
    assert len(got) == 300 and got[1, "L250"] == (500.0, None) and got[1, "L0"] == (0.0, None)


def test_situation_model_by_lemma_and_part_of_speech(spark):
    t = token_rows(spark, [(1, 0, 0, "made/make/VERB/V/ROOT make/make/NOUN/N/X so/so/ADV/A/X wants/Want/VERB/V/X"), (2, 0, 0, "so/so/ADV/A/X")])
    lexicon = spark.createDataFrame([("causal_verb", "make"), ("intentional_verb", "want"), ("causal_particle", "so"), ("intentional_particle", "so"), ("causal_verb", "so")], "kind string, word string")
    got = values_of(cohesion.situation(t, lexicon))
    assert [got[1, k][0] for k in ("SMCAUSv", "SMCAUSvp", "SMINTEp", "SMCAUSr", "SMINTEr")] == [250.0, 500.0, 250.0, 1.0, 1.0]
    assert [got[2, k][0] for k in ("SMCAUSv", "SMCAUSvp", "SMINTEp", "SMCAUSr", "SMINTEr")] == [0.0, 1000.0, 0.0, 0.0, 0.0]


def test_linsear_takes_the_first_hundred_words(spark):
    from spanweave.operators.text_measures import readability_rows

    head = "plain words here. " * 33 + "last"
    rows = readability_rows(spark.createDataFrame([(1, head), (2, head + " " + "complicated considerations" * 50)], "doc_id int, text string"), [], ["linsear_write_formula"]).collect()
    assert len({r.value for r in rows}) == 1 and rows[0].value == pytest.approx((100 / 33 - 2) / 2)


def test_tokens_and_sentences_are_made_without_a_shuffle(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    flat, rows = tagging.rule_tokens(docs), tagging.rule_sentences(docs)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (flat, rows, cohesion.ordered_diversity(rows))]
    assert not any("Exchange" in p or "Window" in p for p in plans)
    again = rows.selectExpr("doc_id", "para", "sent", "inline(toks)").select(*flat.columns)
    assert sorted(map(repr, flat.collect())) == sorted(map(repr, again.collect()))


def test_sentence_rows_give_what_token_rows_give(spark, tokens):
    rows = tagging.rule_sentences(spark.createDataFrame(TEXTS, "doc_id bigint, text string"))
    lexicon = spark.createDataFrame([("L", "the"), ("L", "red of"), ("M", "jumped")], "label string, phrase string")
    for f in (cohesion.ordered_diversity, cohesion.adjacent, lambda t: cohesion.incidences(t, lexicon)):
        assert values_of(f(rows)) == values_of(f(tokens))


def test_words_that_are_no_verbs_are_not_looked_up(spark, tokens):
    """The rows that a lookup of verbs shuffles have a lemma, so no task gets all the others."""
    lexicon = spark.createDataFrame([("causal_verb", "jumped")], "kind string, word string")
    plan = cohesion.situation(tokens, lexicon)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan
