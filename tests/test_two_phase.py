"""Two-phase matching: the stream equals the batch equals brute force, over a restart too."""

import itertools
import json
import random

import pytest

from spanweave.operators.matching import near_texts
from spanweave.streaming import matching as M

EVENTS = "pipeline_id string, seq bigint, event string, selection string, entities array<struct<entity_id: bigint, text: string>>, clear boolean"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(rng, n):
    stems = ["berlin", "paris", "rom", "a", "aa", "saarbrücken", "abcabcabc", "new york"]
    out = []
    for _ in range(n):
        w = list(rng.choice(stems))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", "x", "a", "b"])
        out.append("".join(w))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.75, 0.8, 1.0])
def test_near_texts_loses_no_pair(spark, threshold):
    rng = random.Random(7)
    rows = [(g, w) for g in "pq" for w in words(rng, 150)]
    got = {(r.group, r.a, r.b): r.similarity for r in near_texts(spark.createDataFrame(rows, "group string, text string"), threshold).collect()}
    want = {}
    for g in "pq":
        for a, b in itertools.combinations_with_replacement(sorted({w for x, w in rows if x == g and w}), 2):
            sim = 1 - edits(a, b) / max(len(a), len(b))
            if sim >= threshold - 1e-12:
                want[g, a, b] = sim
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    with pytest.raises(ValueError):
        near_texts(spark.createDataFrame(rows, "group string, text string"), 0.0)


def events(seed):
    """Rows of three pipelines: documents, a finalising event each, one more document behind it."""
    rng = random.Random(seed)
    out, seq = [], itertools.count()
    for p in ("p", "q", "r"):
        for _ in range(4):
            ws = words(rng, 12)
            out.append({"pipeline_id": p, "seq": next(seq), "event": "process", "selection": "Token", "entities": [{"entity_id": i, "text": w.title() if rng.random() < 0.3 else w} for i, w in enumerate(ws)]})
        out.append({"pipeline_id": p, "seq": next(seq), "event": "process", "selection": "Token", "entities": [{"entity_id": 0, "text": None}]})
        out.append({"pipeline_id": p, "seq": next(seq), "event": "finalize", "clear": True})
        out.append({"pipeline_id": p, "seq": next(seq), "event": "process", "selection": "Entity", "entities": []})
    return out


def brute(rows, threshold):
    out = set()
    for p in {r["pipeline_id"] for r in rows}:
        mine = [r for r in rows if r["pipeline_id"] == p]
        end = next(r["seq"] for r in mine if r["event"] == "finalize")
        docs = [r["entities"] for r in mine if r["event"] == "process" and r["seq"] < end]
        for (i, a), (j, b) in itertools.combinations(enumerate(docs), 2):
            for x, y in itertools.product(a, b):
                if x["text"] and y["text"]:
                    s, t = x["text"].lower(), y["text"].lower()
                    if 1 - edits(s, t) / max(len(s), len(t)) >= threshold - 1e-12:
                        out.add((p, end, i, j, x["entity_id"], y["entity_id"]))
    return out


def put(folder, name, rows):
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def found(spark, out):
    return {(r.pipeline_id, r.seq, r.doc_a, r.doc_b, r.entity_a, r.entity_b) for r in spark.read.parquet(f"{out}/matches").collect()}


def test_stream_equals_batch_equals_brute_force_over_a_restart(spark, tmp_path):
    rows = events(3)
    want = brute(rows, 0.8)
    batch = M.matches(M.stored_batch(spark.createDataFrame([(r["pipeline_id"], r["seq"], r["event"], r.get("selection"), r.get("entities"), r.get("clear")) for r in rows], EVENTS)), 0.8)
    assert {(r.pipeline_id, r.seq, r.doc_a, r.doc_b, r.entity_a, r.entity_b) for r in batch.collect()} == want and len(want) > 50
    inputs, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inputs.mkdir()

    def run():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(inputs))
        q = M.start(spark, stream, out, state, 0.8)
        q.awaitTermination(240)
        assert q.exception() is None

    # three documents of p and q come before the restart, the rest behind it
    put(inputs, "1.json", [r for r in rows if r["seq"] < 3 or r["pipeline_id"] == "q"][:9])
    run()
    first = {(r["pipeline_id"], r["seq"]) for r in [r for r in rows if r["seq"] < 3 or r["pipeline_id"] == "q"][:9]}
    put(inputs, "2.json", [r for r in rows if (r["pipeline_id"], r["seq"]) not in first and r["pipeline_id"] != "r"])
    put(inputs, "3.json", [r for r in rows if r["pipeline_id"] == "r"])
    run()
    assert found(spark, out) == want
    told = [(r.pipeline_id, r.kind, r.doc_index, r.message) for r in spark.read.parquet(f"{out}/rows").orderBy("seq").collect() if r.kind != "entity"]
    assert sorted({t[:3] for t in told if t[1] == "stored" and t[0] == "p"}) == [("p", "stored", i) for i in range(5)]  # the last event began anew at 0


def test_selection_and_missing_pipelines_are_told(spark, tmp_path):
    rows = [
        {"pipeline_id": "a", "seq": 0, "event": "finalize"}, {"pipeline_id": "a", "seq": 1, "event": "process", "selection": "Token", "entities": [{"entity_id": 1, "text": "x"}]},
        {"pipeline_id": "a", "seq": 2, "event": "process", "selection": "Lemma", "entities": [{"entity_id": 2, "text": "x"}]}, {"pipeline_id": "a", "seq": 3, "event": "finalize", "clear": False},
        {"pipeline_id": "a", "seq": 4, "event": "finalize", "clear": True}, {"pipeline_id": "a", "seq": 5, "event": "other"}, {"pipeline_id": "a", "seq": 6, "event": "finalize"},
        {"pipeline_id": "b", "seq": 7, "event": "process", "selection": "Token"},
    ]
    inputs = tmp_path / "in"
    inputs.mkdir()
    put(inputs, "1.json", rows)
    q = M.start(spark, spark.readStream.schema(EVENTS).json(str(inputs)), str(tmp_path / "out"), str(tmp_path / "state"), 0.5)
    q.awaitTermination(240)
    got = [(r.seq, r.kind, r.doc_index, r.entity_id, r.message) for r in spark.read.parquet(str(tmp_path / "out/rows")).orderBy("seq").collect()]
    assert got == [
        (0, "error", None, None, "pipeline not found"), (1, "stored", 0, 1, None), (2, "error", None, None, "selection mismatch: expected Token, got Lemma"), (3, "entity", 0, 1, None),
        (4, "entity", 0, 1, None), (5, "error", None, None, "unknown event other"), (6, "error", None, None, "pipeline not found"), (7, "stored", 0, 0, None),
    ]


def test_equal_texts_are_told_without_a_join_and_only_near_ones_are_shuffled(spark):
    """Of 40 documents with the same five words and a word of their own all pairs come; what is joined and shuffled is the distinct texts, not their entities."""
    entities = [("p", 9, d, i, w) for d in range(40) for i, w in enumerate(["one", "two", "three", "four", "FIVE", f"single{d:04d}"])]
    df = spark.createDataFrame(entities, "pipeline_id string, seq bigint, doc_index bigint, entity_id bigint, text string")
    told = M.matches(df, 0.8)
    got = [tuple(r) for r in told.select("doc_a", "doc_b", "entity_a", "entity_b").collect()]
    want = [(a, b, i, i) for a, b in itertools.combinations(range(40), 2) for i in range(6) if i < 5 or edits(f"{a:04d}", f"{b:04d}") <= 2]
    assert sorted(got) == sorted(want)
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 7
