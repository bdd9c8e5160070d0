"""The annotation engine on small fixtures, and every SQL-expressible query against DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from spanweave.functions import metrics
from spanweave.operators import matching, scoring, spans
from spanweave.plans import indices, lexical, measures, relations  # noqa: F401 - they register their queries
from spanweave.plans.queries import ORACLE, QUERIES
from spanweave.sources import documents
from spanweave.streaming import events

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)

    def rows(df):
        return sorted(tuple(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False))

    assert rows(got) == rows(want)


def doc(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id bigint, text string")


def test_two_sentences(spark):
    d = doc(spark, "This is a very great example sentence! I absolutely hate this example. ")
    s = spans.sentences(d).orderBy("pos").collect()
    assert [r.piece.strip() for r in s if r.piece.strip()] == ["This is a very great example sentence!", "I absolutely hate this example."]
    assert spans.sentences(doc(spark, "")).collect() == []


def test_close_gaps_and_clip(spark):
    layer = spark.createDataFrame([(1, 0, 5), (1, 39, 50), (1, 60, 99)], "doc_id bigint, begin bigint, end bigint")
    assert [r.end for r in spans.close_gaps(layer, F.lit(71)).orderBy("begin").collect()] == [38, 59, 70]
    assert [(r.begin, r.end) for r in spans.clip(layer, F.lit(45)).orderBy("begin").collect()] == [(0, 5), (39, 45)]


def test_redaction(spark):
    df = spark.createDataFrame([("Alice called Bob.", [(0, 5), (13, 16), (14, 17)])], "text string, spans array<struct<begin:int,end:int>>")
    assert df.select(spans.redact(F.col("text"), F.col("spans")).alias("t")).first().t == "<REDACTED> called <REDACTED>."


def test_longest_of_overlaps(spark):
    layer = spark.createDataFrame([(1, 0, 5, "DATE", 0.3), (1, 0, 5, "DATE", 0.9), (1, 3, 12, "TIME", 0.2), (1, 20, 25, "SET", 0.5)], "doc_id bigint, begin bigint, end bigint, type string, score double")
    got = spans.longest_of_overlaps(layer).orderBy("begin").collect()
    assert [(r.begin, r.end, r.type) for r in got] == [(3, 12, "TIME"), (20, 25, "SET")]


def test_pack_consecutive(spark):
    layer = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([5, 5, 20, 3, 3, 3])], "doc_id bigint, pos int, piece string")
    assert [r.chunk for r in spans.pack_consecutive(layer, 10).orderBy("pos").collect()] == [0, 0, 1, 2, 2, 2]


def test_overlap_and_first_container(spark):
    turns = spark.createDataFrame([(1, 0, 10, "A"), (1, 10, 30, "B")], "doc_id bigint, begin bigint, end bigint, who string")
    words = spark.createDataFrame([(1, 8, 14, "w")], "doc_id bigint, begin bigint, end bigint, word string")
    best = spans.overlapping(words, turns).groupBy("a_word").agg(F.max_by("b_who", "overlap").alias("who")).first()
    assert best.who == "B"
    outer = spark.createDataFrame([(1, 0, 9000), (1, 8, 20)], "doc_id bigint, begin bigint, end bigint")
    assert [(r.o_begin, r.o_end) for r in spans.first_container(outer, words).collect()] == [(0, 9000)]


def test_matching(spark):
    words = spark.createDataFrame([("schon",), ("house",), ("",)], "word string")
    other = spark.createDataFrame([("schön",), ("mouse",), ("houses",), ("tree",)], "word string")
    assert {(r.a, r.b) for r in matching.fuzzy(words, other).collect()} == {("schon", "schön"), ("house", "mouse"), ("house", "houses")}
    tags = matching.tag(doc(spark, "The Ammophila arenaria grows."), spark.createDataFrame([("ammophila arenaria", 7)], "phrase string, entry int")).collect()
    assert [(r.pos, r.n, r.entry) for r in tags] == [(1, 2, 7)]


def test_metrics(spark):
    row = spark.range(1).select(metrics.timestamp_seconds(F.lit("01:02:03.456")).alias("t"), metrics.softmax(F.array(F.lit(1.0), F.lit(1.0))).alias("s"), metrics.positive_int(F.lit("x"), 9).alias("n"), metrics.truthy(F.lit(" Yes ")).alias("b"), metrics.safe_ratio(F.lit(1), F.lit(0)).alias("r")).first()
    assert (row.t, row.s, row.n, row.b, row.r) == (3723.46, [0.5, 0.5], 9, True, 0.0)


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"_referenced_fss": {"12": {"sofaString": "hello"}}, "_views": {"_InitialView": {"DocumentMetaData": [{"language": "en", "sofa": 12}]}}}')
    row = documents.read_json_cas(spark, str(tmp_path / "a.json")).first()
    assert (row.lang, row.text) == ("en", "hello")
    vtt = doc(spark, "WEBVTT\n\n00:00:01.000 --> 00:00:02.500\nhello there\n\n00:01:00.000 --> 00:01:02.000\nagain")
    assert [(r.start, r.stop, r.caption) for r in documents.parse_vtt(vtt).orderBy("pos").collect()] == [(1.0, 2.5, "hello there"), (60.0, 62.0, "again")]
    chars = spark.createDataFrame([(1, 0, 0, 0, "H"), (1, 0, 0, 1, "i"), (1, 0, 1, 0, "x")], "page int, para int, word int, pos int, ch string")
    assert documents.assemble_characters(chars).first().text == "Hi x"
    lines = documents.graphml(spark.createDataFrame([("a", "<b>")], "id string, label string"), spark.createDataFrame([("a", "c", "d")], "source string, target string, label string"))
    assert lines.where("kind = 'node'").first().line == '<node id="a"><data key="label">&lt;b&gt;</data></node>'


def test_scorer(spark):
    ann = scoring.Annotator("length", "1", lambda: lambda texts: [{"short": 1.0 / (1 + len(t)), "long": len(t) / 10} for t in texts], ("en",))
    df = spark.createDataFrame([(1, "en", "hi"), (2, "fr", "bon"), (3, "en", "a longer text")], "doc_id bigint, lang string, text string")
    got = {r.doc_id: (r.label, r.error, r.provenance.annotator) for r in scoring.annotate(df, ann).collect()}
    assert got == {1: ("short", None, "length"), 2: (None, "unsupported language", "length"), 3: ("long", None, "length")}


def test_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    want = {(r.window.start, r.event_type, r.n) for r in events.tumbling(table).collect()}
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = events.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.window.start, r.event_type, r.n) for r in spark.table("tumbled").collect()} == want
    assert os.path.exists(tmp_path / "cp")


def test_dependencies(spark):
    from spanweave.operators import dependencies as D

    words = spark.createDataFrame([(1, 0, 1, 0, "VERB", "root"), (1, 0, 2, 1, "NOUN", "obj"), (1, 0, 3, 2, "VERB", "acl"), (1, 0, 4, 3, "NOUN", "obj"), (1, 0, 5, 2, "DET", "det")], "doc_id long, sent long, id long, head long, upos string, deprel string")
    assert {r["id"] for r in D.having_child(words, ["obj"]).collect()} == {1, 3}
    assert {(r["id"], r["n_dependents"]) for r in D.n_dependents(words).collect()} == {(1, 1), (2, 2), (3, 1), (4, 0), (5, 0)}
    assert {(r["id"], r["head_upos"]) for r in D.with_heads(words).collect()} == {(1, None), (2, "VERB"), (3, "NOUN"), (4, "VERB"), (5, "NOUN")}
    reached = {(r["root"], r["id"]) for r in D.closures(words).collect()}
    assert reached == {(1, 1), (1, 2), (1, 5), (2, 2), (2, 5), (3, 3), (3, 4), (4, 4), (5, 5)}


def test_selection(spark):
    import pytest

    from spanweave.operators.selection import select_spans, shared_items

    docs = spark.createDataFrame([(1, "One two. Three four.")], "doc_id long, text string")
    assert {r["type"]: r["count"] for r in select_spans(docs, "text,sentence").groupBy("type").count().collect()} == {"text": 1, "sentence": 2}
    with pytest.raises(ValueError):
        select_spans(docs, "stanza")
    sets = spark.createDataFrame([(1, ["a", "b"]), (1, ["a"]), (1, ["a", "b", "b"]), (2, ["a"])], "doc_id long, ws array<string>")
    assert {r["doc_id"]: r["shared_mean"] for r in shared_items(sets).collect()} == {1: 4 / 3, 2: None}


def test_two_stage_finds_every_similar_name(spark):
    import difflib
    import random

    rng = random.Random(3)
    names = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 16))) for _ in range(60)] + ["wolfgangmeier", "annalena"]
    probes = ["wolfgxngmexer", "annaelna", "zz", ""]
    for name in names:
        cut = list(name)
        for _ in range(rng.randrange(1, 4)):
            cut[rng.randrange(len(cut))] = rng.choice(["", "x", "ab"])
        probes.append("".join(cut))
    right = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, value int")
    left = spark.createDataFrame([(p,) for p in set(probes)], "name string")
    for cutoff in (0.8, 0.55):
        got = {r.name: (r.value, r.stage) for r in matching.two_stage(left, right, cutoff).collect()}
        want = {}
        for p in set(probes):
            ratios = {n: difflib.SequenceMatcher(None, n, p).ratio() for n in names}
            near = sorted((-r, n) for n, r in ratios.items() if r >= cutoff)
            if p in names:
                want[p] = (names.index(p), "exact")
            elif near:
                want[p] = (names.index(near[0][1]), "fuzzy")
        assert got == want


def test_two_stage_match_edits(spark):
    import difflib

    names = {r.n_name: r.n_nationkey for r in spark.read.parquet(f"{SF}/nation.parquet").collect()}
    want = {}
    for probe in {n[:1] + "q" + n[1:] + "q" for n in names}:
        near = sorted((-r, n) for n in names if (r := difflib.SequenceMatcher(None, n.lower(), probe.lower()).ratio()) >= 0.8)
        if near:
            want[probe] = names[near[0][1]]
    got = {r.name: r.value for r in QUERIES["two_stage_match_edits"](spark, SF).collect()}
    assert got == want and len(got) > 0


def test_whole_texts_are_looked_up(spark, tmp_path):
    texts = ["Ärger im großen Haus, Cioñ!", "the mice: a mouse", "99 große Häuser", None, "", "house of the mouse"]
    items = ["A Mouse in the house", "Cioñ", "grosse häuser", ""]
    spark.createDataFrame(list(enumerate(texts)), "conv_id long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def words(t):
        return "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()

    def grams(t):
        ws = words(t)
        return [" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, was = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(was[j] + 1, row[-1] + 1, was[j - 1] + (x != y)))
        return row[-1]

    got = {(r.a, r.b, r.distance) for r in QUERIES["fuzzy_dictionary_words"](spark, str(tmp_path)).collect()}
    assert got == {(a, b, d) for t in texts for a in words(t) for i in items for b in words(i) if (d := edits(a, b)) <= 1}
    entry = {}
    for k, i in enumerate(items):
        for p in grams(i):
            entry.setdefault(p, k)
    hits = {}
    for k, t in enumerate(texts):
        for p in grams(t):
            if p in entry:
                hits[k, entry[p]] = hits.get((k, entry[p]), 0) + 1
    assert {(r.doc_id, r.entry): r.hits for r in QUERIES["gazetteer_phrases"](spark, str(tmp_path)).collect()} == hits


def test_every_word_and_chunk_is_returned(spark, tmp_path):
    spark.createDataFrame([(1, "a b. " + "c" * 790 + " d. b e."), (2, "x" * 900 + ". y.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.word, r.n) for r in QUERIES["all_word_frequencies"](spark, str(tmp_path)).collect()} == {("a", 1), ("b", 2), ("c" * 790, 1), ("d", 1), ("e", 1), ("x" * 900, 1), ("y", 1)}
    got = {(r.doc_id, r.chunk): (r.n_sentences, r.n_chars) for r in QUERIES["chunk_packing_chunks"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): (2, 798), (1, 1): (1, 5), (2, 0): (1, 901), (2, 1): (1, 3)}
