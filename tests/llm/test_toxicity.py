import random
import zlib

import numpy as np
import pyarrow as pa

from spanweave.llm import toxicity as tx


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    bad = ["vile", "awful", "idiot", "rotten"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 120))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randrange(1, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((i, int(toxic)))
    return rows, labels


def tables(spark, as_tables, rows, labels):
    docs = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id bigint, text string, codes string, toxic int")
    return as_tables(documents=docs, labels=spark.createDataFrame(labels, "doc_id bigint, toxic int"))


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    examples = []
    for _ in range(700):
        codes = np.sort(rng.choice(50, rng.integers(0, 9), replace=False))
        w = rng.random(len(codes))
        examples.append((codes, w / np.sqrt((w * w).sum()) if len(w) else w))
    examples += examples[:40]
    index = tx.BlockMaxIndex(examples, 50, block=16)
    dense = np.zeros((len(examples), 50))
    for row, (codes, w) in zip(dense, examples, strict=True):
        row[codes] = w
    for codes, w in examples[:200]:
        full = np.zeros(50)
        full[codes] = w
        want = dense @ full
        order = np.lexsort((np.arange(len(want)), -np.round(want, 9)))[:15]
        found, cosines = index.nearest(codes, w, 15)
        assert np.allclose(cosines, want[order][want[order] > 1e-12])
        assert np.allclose(np.sort(want[found])[::-1], cosines)


def test_scores_separate_held_out_labels_and_never_read_them(spark, as_tables):
    rows, labels = corpus(5, 900)
    folder = tables(spark, as_tables, rows, labels)
    got = {r["doc_id"]: r for r in tx.op11_toxicity(spark, folder).collect()}
    assert len(got) == len(rows) and all(got[i]["held_out"] == (fold(i) == 0) and 0 <= got[i]["score"] <= 1 for i in got)
    held = [(got[i]["score"], y) for i, y in labels if fold(i) == 0]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.97
    assert np.mean([s >= 0.5 for s in pos]) > 0.9 and np.mean([s >= 0.5 for s in neg]) < 0.05
    brier = np.mean([(s - y) ** 2 for s, y in held])
    assert brier < 0.04
    # other labels for the held-out rows change nothing
    other = tables(spark, as_tables, rows, [(i, 1 - y if fold(i) == 0 else y) for i, y in labels])
    assert {(r["doc_id"], r["score"]) for r in tx.op11_toxicity(spark, other).collect()} == {(i, r["score"]) for i, r in got.items()}
    # evidence are training examples with their cosines, the nearest first
    known = dict(labels)
    for r in got.values():
        cosines = [e["cosine"] for e in r["evidence"]]
        assert cosines == sorted(cosines, reverse=True) and all(e["toxic"] == known[e["doc_id"]] and fold(e["doc_id"]) for e in r["evidence"])


def test_odd_rows(spark, as_tables):
    rows, labels = corpus(6, 300)
    rows += [(None, "vile idiot"), (1000, None), (1001, ""), (1002, "vile " * 30_000), (5, "vile again"), (1003, "퟿ xé " * 50)]
    labels += [(None, 1), (1001, None), (5000, 1), (1, 1), (1, 0)]
    got = tx.op11_toxicity(spark, tables(spark, as_tables, rows, labels)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 5}
    assert by[None]["held_out"] and by[1000]["evidence"] == [] and by[1000]["score"] == by[1001]["score"] < 0.5 <= by[1002]["score"]


def test_tables_without_rows_or_labels(spark, as_tables):
    rows, _ = corpus(7, 20)
    assert {r["score"] for r in tx.op11_toxicity(spark, tables(spark, as_tables, rows, [])).collect()} == {0.0}
    assert {r["score"] for r in tx.op11_toxicity(spark, tables(spark, as_tables, rows, [(i, 1) for i in range(20)])).collect()} == {1.0}
    assert tx.op11_toxicity(spark, tables(spark, as_tables, [], [(1, 1)])).count() == 0


def test_bare_words():
    assert tx.bare(pa.array([b"vile,", b"...", b"it's", "é!".encode()], pa.binary())) == [b"vile", b"", b"it's", "é".encode()]
