import random
import re
import zlib
from collections import Counter, defaultdict

from spanweave.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = defaultdict(list)
    words = sorted(n)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w in words}


def texts(seed, n):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcaéÀx") for _ in range(rng.randrange(4, 12))) for _ in range(40)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(1, 60)):
            w = rng.choice(stems[: rng.randrange(1, 40)])
            k = rng.randrange(len(w))
            words.append(rng.choice([w, w, w.upper(), w[:k] + w[k + 1 :], w[:k] + rng.choice("abc") + w[k:], w[:k] + rng.choice("ab") + w[k + 1 :]]))
        out.append(rng.choice([" ", ", ", "-", "7"]).join(words))
    return out


def rows_of(df):
    return {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def test_query_equals_brute_force(spark, as_tables):
    rows = list(enumerate(texts(3, 400))) + [(None, "aaaaaa aaaaaa aaaaaa aaaaa aaaaa aaaaa aaaaaaa"), (7, None), (8, ""), (9, "øøøøø " * 4 + "öøøøø " * 8)]
    rows += [(1000, "longest " * 20_000)] + rows[:5]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, word string, n int")
    got = rows_of(spelling.op12_spelling_variants(spark, as_tables(documents=docs)))
    want = brute(rows)
    assert got == want
    assert any(r[3] and r[5] != r[3] for r in want)  # chains of two and more


def test_crowded_keys_lose_no_pair(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(5, 10))) for _ in range(700)})
    v = spark.createDataFrame([(w,) for w in words], "word string")
    want = {tuple(sorted((a, b), key=lambda w: (len(w), w))) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}
    for crowd in (0, 4, 10_000):
        assert {tuple(r) for r in spelling.near_pairs(v, crowd).collect()} == want


def test_empty_and_rare_words_give_nothing(spark, as_tables):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.op12_spelling_variants(spark, as_tables(documents=none)).count() == 0
    rare = spark.createDataFrame([(1, "seldom word"), (2, None)], "doc_id bigint, text string")
    assert spelling.op12_spelling_variants(spark, as_tables(documents=rare)).count() == 0
