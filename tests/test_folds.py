"""Ordered folds and binned overlaps against plain loops."""

import random

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from spanweave.operators import folds, spans


def plain_longest(found):
    best = {}
    for b, e, t, s in found:
        best[b, e, t] = max(best.get((b, e, t), s), s)
    kept = []
    for (b, e, t), s in sorted(best.items(), key=lambda x: (x[0][0], -x[0][1], x[0][2], x[1])):
        if not kept or b >= kept[-1][1]:
            kept.append((b, e, t, s))
        elif e - b > kept[-1][1] - kept[-1][0]:
            kept[-1] = (b, e, t, s)
    return kept


def test_longest_of_many_overlaps(spark):
    rng = random.Random(5)
    layers = {d: [(b := rng.randrange(400), b + rng.randrange(1, 12), rng.choice("xy"), float(rng.randrange(5))) for _ in range(300)] for d in (1, 2, None)}
    layer = spark.createDataFrame([(d, *s) for d, v in layers.items() for s in v], "doc_id bigint, begin bigint, end bigint, type string, score double")
    got = [tuple(r) for r in spans.longest_of_overlaps(layer).collect()]
    assert sorted(got, key=str) == sorted(((d, *s) for d, v in layers.items() for s in plain_longest(v)), key=str)
    assert spans.longest_of_overlaps(layer.limit(0)).count() == 0


def test_packing_of_a_long_document(spark):
    rng = random.Random(6)
    lengths = {1: [rng.randrange(0, 90) for _ in range(20000)], 2: [500, 1, 99, 1], None: [3]}
    layer = spark.createDataFrame([(d, p, "x" * n) for d, v in lengths.items() for p, n in enumerate(v)], "doc_id bigint, pos int, piece string")
    want = []
    for d, v in lengths.items():
        chunk = held = 0
        for p, n in enumerate(v):
            if p and held + n > 100:
                chunk, held = chunk + 1, 0
            held += n
            want.append((d, p, chunk))
    assert sorted(map(tuple, spans.pack_consecutive(layer, 100).collect()), key=str) == sorted(want, key=str)


def test_overlaps_over_many_bins(spark):
    rng = random.Random(7)
    make = lambda: [(rng.choice([1, 2, None]), b := rng.randrange(30000), b + rng.choice([0, 1, 50, 9000])) for _ in range(120)] + [(1, 5, None)]
    a, b = make(), make()
    layers = [spark.createDataFrame(x, "doc_id bigint, begin bigint, end bigint") for x in (a, b)]
    got = sorted(tuple(r) for r in spans.overlapping(*layers).collect())
    full = [[r for r in x if None not in r] for x in (a, b)]
    assert got == sorted((*x, *y, min(x[2], y[2]) - max(x[1], y[1])) for x in full[0] for y in full[1] if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])


def test_fold_over_small_batches(spark):
    class Running:
        def __init__(self):
            self.sum = 0

        def take(self, v):
            self.sum += v or 0
            return [(v, self.sum)]

        def end(self):
            return [(-1, self.sum)]

    rows = spark.createDataFrame([(k, v) for k in ("a", "b", None) for v in (3, None, 1, 2)], "k string, v int")
    out = StructType([StructField("v", IntegerType()), StructField("sum", IntegerType())])
    got = folds.ordered_fold(rows, ["k"], ["v"], ["v"], Running, out, batch=2).groupBy("k").agg(F.collect_list(F.struct(F.coalesce("v", F.lit(0)), "sum")).alias("x")).collect()
    assert {r.k: [tuple(x) for x in r.x] for r in got} == {k: [(0, 0), (1, 1), (2, 3), (3, 6), (-1, 6)] for k in ("a", "b", None)}
