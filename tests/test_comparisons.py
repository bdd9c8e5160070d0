"""Distances against their definitions, ROUGE-L against the quadratic table, direct speech and chains of messages on fixtures."""

import itertools
import random

import numpy as np
import pytest

from spanweave.operators import comparisons as C
from spanweave.operators import prompting


def slow_correlation(x, y):
    def centred(s):
        d = np.abs(np.subtract.outer(s, s))
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    a, b = centred(np.array(x, float)), centred(np.array(y, float))
    spread = (a * a).mean() * (b * b).mean()
    return np.sqrt((a * b).mean() / np.sqrt(spread)) if spread > 0 else 0.0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 101])
def test_distance_correlation(n):
    rng = np.random.default_rng(n)
    for make in (lambda: rng.normal(size=n), lambda: rng.integers(0, 4, n).astype(float), lambda: np.full(n, 3.0)):
        x, y = make(), make() * 5 + 1e4
        assert C.distance_correlation(x, y) == pytest.approx(slow_correlation(x, y), abs=1e-6)
        assert C.distance_correlation(x, x * x) == pytest.approx(slow_correlation(x, x * x), abs=1e-6)
    assert np.isnan(C.distance_correlation(np.zeros(2), np.zeros(3)))


def test_wasserstein():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (5, 5), (7, 3), (20, 33)):
        u, v = rng.normal(size=n), rng.integers(-2, 3, m).astype(float)
        # each value of u as often as m, of v as often as n: equal sizes, so sorted values are matched
        want = np.abs(np.sort(np.repeat(u, m)) - np.sort(np.repeat(v, n))).mean()
        assert C.wasserstein(u, v) == pytest.approx(want)
    assert np.isnan(C.wasserstein(u, np.zeros(0)))


def test_compared(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], [2.0, 4.0, 7.0]), (2, None, [1.0]), (3, [1.0], [1.0, 2.0]), (4, [], [])], "id int, u array<float>, v array<double>")
    got = {r.id: (r.wasserstein, r.distance_correlation) for r in C.compared(df, "u", "v").collect()}
    assert got[1][0] == pytest.approx(7 / 3) and got[1][1] == pytest.approx(slow_correlation([1, 2, 3], [2, 4, 7])) and got[2] == got[4] == (None, None) and got[3] == (0.5, None)


def table_length(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i, j] = t[i - 1, j - 1] + 1 if x == y else max(t[i - 1, j], t[i, j - 1])
    return int(t[-1, -1])


def test_homogenisation_equals_the_quadratic_table(spark):
    rng = random.Random(2)
    assert all(C.common_length(a, b) == table_length(a, b) for a, b in (([rng.randrange(6) for _ in range(rng.randrange(30))], [rng.randrange(6) for _ in range(rng.randrange(30))]) for _ in range(200)))
    rows = [(d, p, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 12))) + "!") for d in range(4) for p in range(d * 9 + 1)]
    for block in (256, 4):
        got = {r.doc_id: (r.homogenisation, r.pairs) for r in C.homogenisation(spark.createDataFrame(rows, "doc_id int, pos int, piece string"), block).collect()}
        for d in range(4):
            texts = [t.strip("!").split() for i, _, t in rows if i == d]
            want = [2 * table_length(a, b) / (len(a) + len(b)) if a and b else 0.0 for a, b in itertools.combinations(texts, 2)]
            assert got[d][1] == len(want) and (got[d][0] == pytest.approx(np.mean(want)) if want else got[d][0] is None)


SPEECH = [
    ('He said "come in now" and left', ["come in now"]), ("Er sagte „komm herein“ und ging", ["komm herein"]), ("“I heard ‘no’ twice,” she said", ["I heard ‘no’ twice,"]), ("»Ja«, rief er, „nie“", ["Ja", "nie"]),
    ("“It never ends\nnew paragraph", ["It never ends"]), ("„offen bis zum Schluss", ["offen bis zum Schluss"]), ("it’s the dogs’ bone", []), ("closing” only", []), ("‚innen „tief“ weiter‘ aus", ["innen „tief“ weiter"]), ("", []),
]


def test_direct_speech(spark):
    for text, want in SPEECH:
        assert [text[a:b] for a, b in C.quoted(text)] == want, text
    got = {r.doc_id: (r.words, r.quoted_words, r.directspeech_ratio) for r in C.direct_speech(spark.createDataFrame([(0, SPEECH[0][0]), (1, None), (2, "no quotes")], "doc_id int, text string")).collect()}
    assert got == {0: (7, 3, 3 / 7), 1: (0, 0, None), 2: (2, 0, 0.0)}


def test_messages_use_earlier_ones(spark):
    schema = "prompt_id int, position int, role string, content string, fillable boolean, context_name string, args map<string,string>"
    rows = [
        (1, 0, "system", "You rate {{texts}} of {who}.", False, None, {"who": "Ann"}), (1, 1, "user", "First.", False, "one", None), (1, 2, "assistant", "", True, "answer", None), (1, 3, "user", "Was {answer} for {one}?", False, None, None), (1, 4, "assistant", None, True, None, None),
        (2, 0, "user", "{gone}", False, "x", None), (2, 1, "user", "and {x}", False, None, None), (2, 2, "assistant", None, True, None, None), (3, 0, "assistant", "given", True, "n", None), (3, 1, "user", "{n}", False, "n", {"n": "old"}), (3, 2, "user", None, None, None, None),
        (4, 0, "assistant", None, True, None, None),
    ]

    def load():
        def score(said):
            if not said:
                raise RuntimeError("nothing said")
            return f"<{len(said)}:{said[-1][1]}>"

        return score

    got = {(r.prompt_id, r.position): (r.text, r.filled, r.error) for r in prompting.answered(spark.createDataFrame(rows, schema), load).collect()}
    assert got == {
        (1, 0): ("You rate {texts} of Ann.", False, None), (1, 1): ("First.", False, None), (1, 2): ("<2:First.>", True, None), (1, 3): ("Was <2:First.> for First.?", False, None), (1, 4): ("<4:Was <2:First.> for First.?>", True, None),
        (2, 0): (None, False, "unknown name gone"), (2, 1): (None, False, "unknown name x"), (2, 2): (None, True, "scorer: RuntimeError('nothing said')"), (3, 0): ("given", False, None), (3, 1): ("given", False, None), (3, 2): ("", False, None),
        (4, 0): (None, True, "scorer: RuntimeError('nothing said')"),
    }
