"""Frames cut into ranges, equal parts, subtotals and nodes of arcs against plain loops."""

import random

import pytest

from spanweave.operators import dependencies, frames


@pytest.mark.parametrize("ranges", [1, 7])
def test_running_values_of_a_hot_group(spark, ranges):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.choice([None, rng.randrange(100)])) for i in range(900)] + [("single", 1000, None)]
    df = spark.createDataFrame(rows, "place_of string, at int, v bigint").repartition(5)
    got = {r.at: r for r in frames.equal_parts(frames.running(df, ["place_of"], ["at"], "v", ranges), 4).collect()}
    assert len(got) == len(rows)
    for key in ("hot", "a", None, "single"):
        group = [r for r in rows if r[0] == key]
        seen, quarter = [], [len(group) // 4 + (k < len(group) % 4) for k in range(4)]
        parts = [k + 1 for k, n in enumerate(quarter) for _ in range(n)]
        for place, (_, at, v) in enumerate(group, 1):
            seen += [v] if v is not None else []
            r = got[at]
            assert (r.place, r.group_size, r.running_sum, r.running_max, r.running_count, r.part) == (place, len(group), sum(seen) if seen else None, max(seen, default=None), len(seen), parts[place - 1])
            assert r.share == pytest.approx((place - 1) / (len(group) - 1) if len(group) > 1 else 0.0)
    assert frames.running(df.limit(0), ["place_of"], ["at"], "v").count() == 0


def test_subtotals(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), (None, "x", 4)], "k string, l string, v int")
    by = lambda every: {(r.k, r.l, r.level): r.v for r in frames.subtotals(df, ["k", "l"], {"v": "v"}, every).collect()}
    left = {("a", "x", 0): 1, ("a", "y", 0): 2, (None, "x", 0): 4, ("a", None, 1): 3, (None, None, 1): 4, (None, None, 3): 7}
    assert by(False) == left
    assert by(True) == left | {(None, "x", 2): 5, (None, "y", 2): 2}


def test_nodes_of_arcs(spark):
    tokens = spark.createDataFrame([(1, 0, 1, "she"), (1, 0, 2, "reads"), (1, 1, 1, "no")], "doc_id bigint, sent int, id int, text string")
    arcs = spark.createDataFrame([(1, 0, 2, 1, "nsubj"), (1, 0, 0, 2, "root"), (1, 1, None, 1, "root")], "doc_id bigint, sent int, governor int, dependent int, deprel string")
    text = lambda node: {(r.sent, r.dependent): r.node_text for r in dependencies.arc_nodes(arcs, tokens, node).collect()}
    assert text("governor") == {(0, 1): "reads", (0, 2): None, (1, 1): None}
    assert text("dependent") == {(0, 1): "she", (0, 2): "reads", (1, 1): "no"}
