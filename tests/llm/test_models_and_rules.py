"""Decontamination, chat, quality rules, sharding, classifier and language model against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanweave.llm import chat, decontaminate, language_model, near_dedup, quality_classifier, quality_rules, sharding


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_ends():
    rng = random.Random(1)
    for _ in range(200):
        item, text = [rng.randrange(6) for _ in range(rng.randrange(1, 12))], [rng.randrange(6) for _ in range(rng.randrange(1, 15))]
        want = min(edit_distance(item, text[a:b]) for a in range(1) for b in range(len(text) + 1))
        shifted, end = decontaminate.edit_ends(item, text)
        assert shifted <= want
        assert shifted == min(edit_distance(item, text[a:b]) for a in range(len(text) + 1) for b in range(a, len(text) + 1)) or shifted == len(item)


def leak_fixture(rng):
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(10, 50)))) for i in range(60)]
    docs, planted = [], set()
    for d in range(150):
        words = [rng.choice(vocab) for _ in range(200)]
        if d % 3 == 0:
            i, text = rng.choice(items)
            part = text.split()
            for _ in range(rng.randrange(0, int(len(part) * 0.2) + 1)):
                at = rng.randrange(len(part))
                part[at] = rng.choice(vocab)
            words[50:50] = part
            planted.add((d, i))
        docs.append((d, " ".join(words)))
    return items, docs, planted


def test_decontamination(spark, as_tables):
    items, docs, planted = leak_fixture(random.Random(3))
    docs += [(900, None), (901, ""), (None, items[0][1].upper() + "!")]
    folder = as_tables(documents=spark.createDataFrame(docs, "doc_id bigint, text string"), benchmark=spark.createDataFrame([*items, (700, None), (701, "too short")], "item_id bigint, text string"))
    found = rows_of(decontaminate.op2_decontaminate(spark, folder))
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert (None, 0) in got and len(planted - got) <= 1 and got - {(None, 0)} <= planted
    words = dict(items)
    texts = dict(docs)
    for r in found:
        item, stretch = words[r["item_id"]].split(), (texts[r["doc_id"]].lower().strip("!")).split()[r["first_word"] : r["end_word"]]
        assert edit_distance(item, stretch) == r["distance"] <= len(item) * 0.2
    kept = decontaminate.without_leaks(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert Counter(r["doc_id"] for r in rows_of(kept)) == Counter(d for d, _ in docs if d not in {x for x, _ in got})


def test_short_items_are_found_exactly(spark):
    items = [(1, "Which colour is it?"), (2, "北京的首都是哪里"), (3, "yes"), (4, "!?"), (5, "colour is"), (6, None), (None, "no id here")]
    docs = [(1, "he asked: which COLOUR, is it then"), (2, "昨天他问：北京的首都是哪里呢"), (3, "which color is it"), (4, "No."), (5, "Yes!"), (6, "which colour"), (7, "北京的首都是")]
    found = rows_of(decontaminate.leaks(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")))
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (1, 5), (2, 2), (5, 3)}
    assert next((r["first_word"], r["end_word"], r["distance"]) for r in found if r["item_id"] == 1) == (2, 6, 0)


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "some text", 3)], "doc_id bigint, text string, item_id int"), spark.createDataFrame([(1, "some text")], "item_id bigint, text string")
    assert decontaminate.leaks(spark, docs.limit(0), items).collect() == [] and decontaminate.leaks(spark, docs, items.limit(0)).collect() == []
    assert decontaminate.without_leaks(spark, docs, items.limit(0)).collect() == docs.collect()
    assert decontaminate.without_leaks(spark, docs, items).collect() == []
    assert decontaminate.without_leaks(spark, docs.limit(0), items).columns == docs.columns


def test_recall_at_largest_distance():
    rng = random.Random(7)
    items, _, _ = leak_fixture(rng)
    found = decontaminate.Items([(i, t.split()) for i, t in items], 0.2)
    texts, want = [], []
    for _ in range(5):
        for i, t in items:
            part = t.split()
            for _ in range(int(len(part) * 0.2)):
                at, kind = rng.randrange(len(part)), rng.randrange(3)
                part[at : at + (kind != 1)] = [f"w{rng.randrange(400)}"] if kind else []
            texts.append(" ".join([f"w{rng.randrange(400)}" for _ in range(30)] + part + [f"w{rng.randrange(400)}" for _ in range(30)]))
            want.append(i)
    hits = [any(found.ids[x] == i for x, *_ in f) for f, i in zip(decontaminate.find_leaks(texts, found), want, strict=True)]
    assert np.mean(hits) > 0.95


@pytest.mark.parametrize(("n", "texts_of"), [(50, 60), (121, 40), (200, 40), (400, 24), (1000, 12), (2000, 8)])
def test_recall_of_long_items_at_largest_distance(n, texts_of):
    rng = random.Random(n)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, [word() for _ in range(n)]) for i in range(4)]
    ready = decontaminate.Items(items, 0.2)
    texts, want = [], []
    for j in range(texts_of):
        part = items[j % 4][1].copy()
        for _ in range(int(n * 0.2)):
            at, kind = rng.randrange(len(part)), rng.randrange(3)
            part[at : at + (kind != 1)] = [word()] if kind else []
        texts.append(" ".join([word() for _ in range(40)] + part + [word() for _ in range(40)]))
        want.append((j % 4, len(part)))
    found = decontaminate.find_leaks([*texts, " ".join(items[0][1][: n // 2]), ""], ready)
    assert found[-1] == [] and (n <= 40 or found[-2] == [])  # half an item is no leak
    hits = [[x for x in f if ready.ids[x[0]] == i] for f, (i, _) in zip(found, want, strict=False)]
    assert np.mean([bool(h) for h in hits]) >= 0.95
    for h, (_, size) in zip(hits, want, strict=True):
        for _, first, end, distance in h:
            assert distance <= int(n * 0.2) and abs(first - 40) <= 0.05 * n + 3 and abs(end - 40 - size) <= 0.05 * n + 3


def test_whole_long_item_is_found_where_it_stands():
    words = [f"w{i}" for i in range(700)]
    ready = decontaminate.Items([(9, words)], 0.2)
    got = decontaminate.find_leaks([" ".join(["x"] * 33 + words + ["y"] * 5), " ".join(words[:500])], ready)
    assert [[(ready.ids[i], a, b, d) for i, a, b, d in f] for f in got] == [[(9, 33, 733, 0)], []]


CONVERSATIONS = [
    (1, 0, "system", "be nice"), (1, 1, "user", None), (1, 2, "assistant", "<turn user>\nhi</turn>\n \\l \\\\ #"), (2, 0, None, "x"), (2, 0, "assistant", "tie"),
    (2, None, "user", "first"), (None, 0, "user", "no id"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok"),
]


def test_chat(spark, as_tables):
    schema = "conv_id bigint, turn bigint, role string, text string"
    folder = as_tables(conversations=spark.createDataFrame([(*r[:4],) for r in CONVERSATIONS if r[0] != -7], schema))
    got = {r["conv_id"]: r for r in rows_of(chat.op6_chat(spark, folder))}
    groups = defaultdict(list)
    for c, n, r, t in CONVERSATIONS:
        groups[c].append((n is not None, n or 0, r or "", t or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        row = got[c]
        assert row["n_turns"] == len(turns) and row["loss_chars"] == len(loss)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert row["formatted_chars"] == sum(len(f"<turn {chat.escape(r)}>\n{chat.escape(t)}</turn>\n") for *_, r, t in turns)
    empty = as_tables(conversations=spark.createDataFrame([], schema))
    assert [r["conv_id"] for r in rows_of(chat.op6_chat(spark, empty))] == [-7]


def test_chat_parts(spark):
    content = '[{"type":"text","text":"see <image 0>"},{"type":"image","ref":"a.png","width":100,"height":29},{"type":"audio","ref":"b.wav","seconds":3},{"type":"document","ref":"c.pdf","pages":2}]'
    rows = rows_of(chat.format_turns(spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", '[{"type":"image","ref":"d.png"}]')], "conv_id bigint, turn int, role string, text string"), parts_json=True))
    assert rows[0]["formatted"] == "<turn user>\nsee \\limage 0\\g<image 0><audio 1><document 2></turn>\n"
    assert [(a["number"], a["kind"], a["ref"], a["tokens"]) for r in rows for a in r["attachments"]] == [(0, "image", "a.png", 8), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 512), (3, "image", "d.png", 1)]
    odd = [None, "", "plain", '{"type":"text"}', "[1]", "[]", '[{"type":"text"}]']
    rows = rows_of(chat.format_turns(spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(odd)], "conv_id bigint, turn int, role string, text string"), parts_json=True))
    assert [r["formatted"] for r in rows] == [f"<turn user>\n{chat.escape(t)}</turn>\n" for t in ("", "", "plain", '{"type":"text"}', "[1]", "", "")]
    with pytest.raises(ValueError):
        chat.PartVisitor().visit([{"type": "video"}])


def test_parts_that_cannot_be_taken_are_plain_text_with_an_error(spark):
    bad = ["[" * 100_000, '[{"type":"text","text":"\\ud800"}]', '[{"type":"text","text":5}]', '[{"type":"video"}]', '[{"type":"image","width":"wide"}]', '[{"type":"image","ref":"\\ud800"}]']
    rows = rows_of(chat.format_turns(spark.createDataFrame([(1, i, "user", t) for i, t in enumerate([*bad, "fine"])], "conv_id bigint, turn int, role string, text string"), parts_json=True))
    assert [r["formatted"] for r in rows] == [f"<turn user>\n{chat.escape(t)}</turn>\n" for t in [*bad, "fine"]]
    assert [bool(r["error"]) for r in rows] == [True] * len(bad) + [False]


def test_turns_are_read_from_the_string_whatever_its_pieces():
    turns = [("user", "a </turn>\n<turn x>"), ("assistant", ""), ("", "\\ <b>"), ("assistant", "é" * 9)]
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, content = f"<turn {chat.escape(role)}>\n", chat.escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(content)))
        parts.append(f"{head}{content}</turn>\n")
        at += len(parts[-1])
    whole = "".join(parts)
    for size in (1, 3, 17, 1000):
        reader = chat._Reader(7)
        reader.mask.extend(mask)
        for k in range(0, len(whole), size):
            reader.feed(whole[k : k + size], None, None)
        got = reader.closed()
        assert got["n_turns"] == 4 and got["loss_chars"] == 9 and got["formatted_chars"] == len(whole)
        assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    reader = chat._Reader(8)
    reader.feed(whole + "<turn user>\nnever ended", None, None)
    with pytest.raises(ValueError):
        reader.closed()


def brute_measures(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, nasty, as_tables):
    repeated = " ".join(["one two three four five six seven eight nine"] * 5 + ["end"])
    more = spark.createDataFrame([(500, repeated + "\nline\nline\n \n ", "en", "s0", 1, "x")], nasty.schema)
    docs = nasty.unionByName(more)
    rows = rows_of(quality_rules.op7_quality_rules(spark, as_tables(documents=docs)))
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
    assert got == Counter((r.doc_id, *brute_measures(r.text)) for r in docs.collect())
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and not r["failed"])
    assert quality_rules.quality_rules(spark.createDataFrame([], nasty.schema)).collect() == []


def test_rules_pass_clashing_columns_through(spark, nasty):
    named = {"m": "id", "_base_failed": "n_chars", "quality": "doc_id", "r": "doc_id", "group": "source"}
    docs = nasty.select("*", *[nasty[c].alias(k) for k, c in named.items()])
    out = quality_rules.quality_rules(docs)
    assert out.columns == [*docs.columns, "quality_"]
    assert Counter(tuple(r)[:-1] for r in out.collect()) == Counter(tuple(r) for r in docs.collect())


def test_adaptive_thresholds(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        source = "loud" if i % 3 == 0 else "plain"
        words = [f"word{rng.randrange(5000)}" + ("#" if source == "loud" and rng.random() < 0.5 else "") for _ in range(60)]
        if i % 50 == 1:
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words), "en", source))
    out = {r["doc_id"]: r["quality"]["failed"] for r in rows_of(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")))}
    assert {i for i, f in out.items() if f} == {i for i in range(600) if i % 50 == 1}


def test_thresholds_do_not_depend_on_order_or_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["en", "de"]), rng.choice("ab"), rng.lognormvariate(1, 1), rng.random() * rng.choice([0, 1]), 0.0, rng.random()) for _ in range(3000)]
    schema = "lang string, source string, " + ", ".join(f"{r} double" for r in quality_rules.RULES)
    found = []
    for n in (1, 7, 3):
        rng.shuffle(rows)
        found.append(sorted(map(tuple, quality_rules.thresholds(spark.createDataFrame(rows, schema).repartition(n)).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 4
    q = quality_rules.quartiles(quality_rules.sketches(spark.createDataFrame(rows, schema))).where("level = 2 and rule = 'mean_word'").first()["q"]
    exact = np.quantile([r[2] for r in rows], [0.25, 0.5, 0.75], method="inverted_cdf")
    assert np.allclose(q, exact, rtol=0.0011)


def test_sharding(spark, nasty, as_tables):
    rows = rows_of(sharding.op8_sharding(spark, as_tables(documents=nasty)))
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in nasty.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    counts = [len(slots.get(s, [])) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    order = [r["hilbert"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    assert sharding.op8_sharding(spark, as_tables(documents=nasty.limit(0))).collect() == []


def test_strings_are_cut_at_their_quantiles(spark):
    """Values that differ only behind a long common beginning, one of them hot."""
    values = [f"https://example.org/{i:04d}" for i in range(1000)] + ["https://example.org/0500"] * 1000 + [None] * 5
    rows = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    cuts = sharding.string_cuts(sharding.Workspace(spark, "t"), rows, "v", 8)
    whole = sorted(v for v in values if v)
    assert cuts == sorted({whole[-(-len(whole) * k // 8) - 1] for k in range(1, 8)})
    assert sharding.string_cuts(sharding.Workspace(spark, "t"), rows.where("v is null"), "v", 8) == []


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 4), (4, 3)])
def test_hilbert_curve_is_continuous(dims, bits):
    table = sharding.hilbert_table(dims, bits)
    assert sorted(table) == list(range(1 << dims * bits))
    cells = sorted(range(len(table)), key=table.__getitem__)
    split = [[c >> bits * (dims - 1 - d) & (1 << bits) - 1 for d in range(dims)] for c in cells]
    assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for x, y in zip(split, split[1:], strict=False))


def corpus(n=700):
    rng = random.Random(11)
    vocab = [a + b + c for a in ("an", "re", "tion", "the", "or", "ble", "is") for b in ("ing", "ed", "ou", "er", "st", "nd", "of", "wh", "ha", "ti") for c in ("ly", "al", "ic", "on", "um", "as", "ek")]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(60, 300))]
        junk, toxic = i % 7 == 0, i % 9 == 1
        if toxic:
            for k in range(0, len(words), 40):
                words[k] = rng.choice(["vileword", "badterm", "slurry"])
        if junk:
            words = [w + "%%%" for w in words] if i % 2 else ["spam", "offer"] * (len(words) // 2)
        docs.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def test_classifier_held_out(spark):
    docs, labels = corpus()
    known = [x for x in labels if x[0] % 2]
    nasty = [(9001, None), (9002, ""), (None, "words without an id"), (0, docs[0][1])]
    df = spark.createDataFrame([(*d, "x") for d in docs + nasty], "doc_id bigint, text string, classified string")
    out = quality_classifier.classify(spark, df, spark.createDataFrame(known, "doc_id bigint, quality int, toxic int"))
    assert out.columns == ["doc_id", "text", "classified", "classified_"]
    rows = rows_of(out)
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in docs + nasty)
    kept = {r["doc_id"]: r["classified_"]["kept"] for r in rows}
    held = [x for x in labels if x[0] % 2 == 0]
    assert np.mean([kept[i] == bool(q and not t) for i, q, t in held]) > 0.97
    empty = quality_classifier.classify(spark, df.limit(0), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert empty.collect() == []


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.2
    right = np.array([[0.97, 0.6], [0.95, 0.8], [0.99, 0.4]])
    bad = np.where(truth[:, None], rng.random((20_000, 3)) < right[:, 1], rng.random((20_000, 3)) > right[:, 0]).astype(int)
    patterns, counts = np.unique(bad, axis=0, return_counts=True)
    post, table = quality_classifier.expectation_maximisation(patterns, counts.astype(float))
    assert np.allclose(table[0, :, 1], right[:, 0], atol=0.03) and np.allclose(table[1, :, 2], right[:, 1], atol=0.06)
    assert abs((post * counts).sum() / counts.sum() - 0.2) < 0.02


def brute_base(rows):
    tokens = {k: [*(t or "").encode().lower().split(), b"\n"] for k, (_, t) in enumerate(rows)}
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(w for k, h in enumerate(held) if not h for w in tokens[k])
    n, v = sum(counts.values()), len(counts)
    return Counter((i, held[k], len(tokens[k]), sum(counts[w] > 0 for w in tokens[k]), n, round(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[k]), 4)) for k, (i, _) in enumerate(rows))


def test_lm_scoring(spark, nasty, as_tables, monkeypatch):
    monkeypatch.setattr(language_model, "HOT", 8)
    monkeypatch.setattr(language_model, "FIRST_EPOCHS", 2)  # a text of 20,000 words is one lane: 1,250 steps an epoch
    folder = as_tables(documents=nasty)
    rows = rows_of(language_model.op10_lm_scoring(spark, folder))
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows)
    assert got == brute_base([(r.doc_id, r.text) for r in nasty.collect()])
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert language_model.op10_lm_scoring(spark, as_tables(documents=nasty.limit(0))).collect() == []


def test_lm_learns(spark):
    docs, _ = corpus(300)
    two = [(i, t if i % 2 else " ".join(w[::-1] for w in t.split())) for i, t in docs]
    rows = rows_of(language_model.score_texts(spark, spark.createDataFrame(two, "doc_id bigint, text string")))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_gradients_and_distribution():
    rng = np.random.default_rng(0)
    net = language_model.Recurrent()
    net = language_model.Recurrent({k: v.astype(np.float64) for k, v in net.p.items()})
    ids, before = rng.integers(0, language_model.OUTPUTS, (5, 3)), rng.integers(0, language_model.OUTPUTS + 1, (5, 3))
    h = np.zeros((3, language_model.HIDDEN))
    grad, _, _ = net.gradients(h, before, ids)
    for k in net.NAMES:
        g = grad[k].ravel()
        at = int(np.argmax(np.abs(g)))
        flat, eps = net.p[k].reshape(-1), 1e-5
        was = flat[at]
        flat[at] = was + eps
        up = net.gradients(h, before, ids)[2]
        flat[at] = was - eps
        down = net.gradients(h, before, ids)[2]
        flat[at] = was
        assert abs(-(up - down) / (2 * eps) - g[at]) < 1e-5
    state = rng.normal(size=(1, language_model.HIDDEN))
    every = net.log_probs(np.repeat(state, language_model.OUTPUTS, 0), np.arange(language_model.OUTPUTS))[0]
    assert abs(np.exp(every).sum() - 1) < 1e-6


def lm_docs(rng, *sizes):
    docs = [rng.integers(0, language_model.OUTPUTS, n).astype(np.int16) for n in sizes]
    return [np.append(d[d != language_model.END_ID], language_model.END_ID).astype(np.int16) for d in docs]


def test_lm_lanes_do_not_mix_documents():
    net = language_model.Recurrent()
    docs = lm_docs(np.random.default_rng(1), 0, 700, 3, 40, 41, 2, 90)
    alone = [language_model.score_documents(net, [d])[0] for d in docs]
    assert np.allclose(language_model.score_documents(net, docs), alone, rtol=1e-4)


def test_lm_words_and_buckets():
    import pyarrow as pa

    found = pa.array([b"a", b"ab", b"abc", "é".encode(), b"\xff"], pa.large_binary())
    for part in (found, found.slice(2)):
        assert language_model.buckets(part).tolist() == [language_model.bucket(w) for w in part.to_pylist()]
    vocabulary = language_model.Vocabulary([(b"abc", 9), (b"zz", 4)], 3, 40, 7, [(5, 2)] * 64)
    hot, ids = vocabulary.find(found)
    assert hot.tolist() == [-1, -1, 0, -1, -1] and ids[2] == 0 and ids[0] == language_model.OUTPUTS - 64 + language_model.bucket(b"a")


def test_lm_trains_on_every_token_of_whole_documents(monkeypatch):
    rng = np.random.default_rng(2)
    docs = lm_docs(rng, 0, 700, 3, 40, 41, 2, 90, 5000, *[12] * 300)
    seen, real = [], language_model.Recurrent.gradients

    def gradients(net, h, before, ids):
        seen.extend(zip(before[ids >= 0].tolist(), ids[ids >= 0].tolist(), strict=True))
        grad, after, mean = real(net, h, before, ids)
        assert len(after) == len(h)
        return grad, after, mean

    monkeypatch.setattr(language_model.Recurrent, "gradients", gradients)
    trainer = language_model.Trainer(language_model.Recurrent(), 0.003)
    trainer.stream(docs)
    every = Counter(p for d in docs for p in zip([language_model.OUTPUTS, *d[:-1].tolist()], d.tolist(), strict=True))
    assert Counter(seen) == every
    assert not hasattr(language_model, "STEP")


def test_pipeline(spark, as_tables):
    docs, labels = corpus(400)
    good = [i for i, q, t in labels if q and not t]
    base = docs[good[5]][1].split()
    near = base.copy()
    near[20] = "different"
    item = " ".join(f"leak{k}" for k in range(20))
    extra = [(1000, " ".join(near)), (1001, docs[good[6]][1]), (1002, docs[good[7]][1] + " " + item), (1003, None), (1004, "")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs + extra]
    folder = as_tables(documents=spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), benchmark=spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert len(corpus_pipeline.STAGES) == 5
    packed = rows_of(corpus_pipeline.run(spark, folder))
    out = {r["doc_id"] for r in packed}
    rejected = {i for i, q, t in labels if not q or t}
    assert not out & {1000, 1002} and len(out & rejected) <= 0.03 * len(rejected) and len(set(good) - out) <= 0.03 * len(good) + 1
    assert len(out & {1001, 1003, 1004}) <= 1  # emptied by line dedup or empty: one group


def hard_names(df):
    """Columns that clash with names in use, and one with a dot."""
    return df.withColumns({"id": F.lit("clash"), "a.b": F.lit(1), "kept": F.lit(2), "component": F.lit("x")})


def test_pipeline_stages_pass_any_column_names(spark, nasty, as_tables):
    docs = hard_names(nasty)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id bigint, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "alpha beta nothing like this is in any text of the table at all")], "item_id bigint, text string")
    folder = as_tables(documents=nasty, labels=labels, benchmark=benchmark)
    for name, stage in corpus_pipeline.STAGES[1:-1]:  # the classifier is tested by itself
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count(), name
    out = corpus_pipeline.quality(spark, docs, folder)
    assert out.columns == docs.columns and out.count() <= docs.count()
    assert near_dedup.without_near_duplicates(spark, docs.limit(0)).columns == docs.columns


def test_pipeline_on_an_empty_table(spark, as_tables):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    folder = as_tables(documents=spark.createDataFrame([], schema), labels=spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id bigint, text string"))
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_samples_count_distinct_ids(spark):
    from spanweave.llm.support import hashed_sample

    ids = spark.range(10_000).selectExpr("id", "explode(sequence(1, if(id % 100 = 0, 900, 1))) AS k").select("id")
    ids = ids.unionByName(spark.createDataFrame([(None,)] * 3, "id bigint"))
    got = [r.id for r in hashed_sample(ids, 2000, 3).collect()]
    assert len(got) == len(set(got)) == 2000 and got == [r.id for r in hashed_sample(spark.range(10_000).repartition(7), 2000, 3).collect()]
