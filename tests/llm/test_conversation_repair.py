import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from spanweave.llm import conversation_repair as cr
from spanweave.llm.support import Workspace


def shown(x):
    return " " if x is None else x


def brute(rows):
    """{conv_id: digest} straight from the contract, by a search over (row, state) from the back."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = shown(role), shown(text)
            kind = zlib.crc32(f"{shown(c)}:{shown(turn)}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.md5(r[2].encode()).hexdigest()))
        out[conv] = judged(kept)
    return out


def judged(kept):
    faults, seen = [], set()
    for _, role, text in kept:
        said = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    cost, audit, said = solve_back(kept, faults, step)
    turns = [r[0] for r in kept if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:], strict=False)]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())


def solve_back(kept, faults, step):
    """Least (cost, audit, turns), from the last row to the first; inserts are followed to a fixed point at each row."""
    states = ("", "s", "u", "a")
    now = {"": (0, "", ()), "a": (0, "", ())}

    def inserted(table):
        for _ in range(4):
            for state in states:
                for role in ("user", "assistant"):
                    to = step.get((state, role[0]))
                    if to in table:
                        cost, audit, said = table[to]
                        new = cost + 2, "I" + audit, ((role, ""), *said)
                        table[state] = min(table.get(state, new), new)
        return table

    now = inserted(now)
    for (_, role, text), fault in zip(reversed(kept), reversed(faults), strict=True):
        new = {}
        for state in states:
            found = [(now[state][0] + 3, "D" + now[state][1], now[state][2])] if state in now else []
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                for cost, letter, r in ((more, "K", role), (2 + more, "R", "user"), (2 + more, "R", "assistant")):
                    to = step.get((state, r[:1]))
                    if to in now:
                        found.append((cost + now[to][0], letter + now[to][1], ((r, text), *now[to][2])))
            if found:
                new[state] = min(found)
        now = inserted(new)
    return now[""]


def rows_of(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


def some_rows(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "u", "sys", "Assistant"]
    texts = ["Yes.", "no", "Why?", "", " \t", "cut off", "Done! ", None, "...", "x\x1c", "é?\n", "long " * 3000 + "end."]
    rows = []
    for conv in [*range(150), None]:
        n = rng.choice([0, 1, 2, 3, 5, 8, 13])
        for turn in range(n):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, turn + 1, None]), rng.choice(roles), rng.choice(texts)))
    return rows + rows[:9]


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_query_equals_brute_force(spark, as_tables):
    rows = some_rows(4)
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", letters string, place int")
    got = rows_of(cr.op13_conversation_repair(spark, as_tables(conversations=turns)))
    assert got == brute(rows)
    assert {"", "D"} & {x[6] for x in got.values()} and any("R" in x[6] for x in got.values()) and any("I" in x[6] for x in got.values())


def test_one_conversation_over_many_ranges_equals_brute_force(spark, as_tables):
    rng = random.Random(8)
    long = [(5, t, rng.choice(["user", "user", "assistant", "assistant", "system", "tool"]), rng.choice(["a.", "b?", "c", "d!", ""]) + str(rng.randrange(400)) * rng.choice([0, 1]) + rng.choice(["", "."])) for t in range(1500)]
    rows = long + [(c, t, r, f"{t}.") for c in (4, 6) for t, r in enumerate(["system", "user", "assistant"])] + [(5, 7, "user", "again.")] * 900
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        turns = spark.createDataFrame(rows, SCHEMA)
        folder = as_tables(conversations=turns)
        got = rows_of(cr.op13_conversation_repair(spark, folder))
        segs = cr.coded(cr.damaged(turns), Workspace(spark, "t")).where("conv_id = 5").select("seg").distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert segs > 5
    assert got == brute(rows)


def test_matrices_compose_to_the_whole():
    rng = random.Random(1)
    for _ in range(300):
        turns = [(i, rng.choice([0, 1, 2, 3]) + rng.choice([0, 0, 0, 4, 8, 16]), rng.choice([1, 1, 1, 2, 3])) for i in range(rng.randrange(1, 14))]
        cuts = sorted(rng.sample(range(1, len(turns)), min(len(turns) - 1, rng.randrange(4))))
        parts = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, len(turns)], strict=True)]
        whole = cr.solve(turns)[0]
        ways = cr.compose([cr.matrix(p) for p in parts])
        assert {k: v for p, (a, b) in zip(parts, ways, strict=True) for k, v in cr.solve(p, a, b)[0].items()} == whole


def test_repaired_rows_are_legal_and_kept_texts_whole(spark):
    rows = [r for r in some_rows(11) if r[0] is not None]
    got = cr.repaired_conversations(spark.createDataFrame(rows, SCHEMA))
    by = {}
    for r in got.orderBy("conv_id", "place", "part").collect():
        by.setdefault(r["conv_id"], []).append(r)
    for said in by.values():
        assert re.fullmatch("s?(ua)+", "".join(r["role"][0] for r in said))
        assert all(r["text"] == "" for r in said if r["edit"] == "I")
    assert {r["edit"] for said in by.values() for r in said} == {"K", "R", "I"}


def test_empty_table(spark, as_tables):
    assert cr.op13_conversation_repair(spark, as_tables(conversations=spark.createDataFrame([], SCHEMA))).count() == 0


def test_all_rows_dropped_give_zeros(spark, as_tables):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = cr.op13_conversation_repair(spark, as_tables(conversations=spark.createDataFrame([(conv, 0, "user", "a.")], SCHEMA))).select(F.struct("*")).collect()
    assert list(got[0][0])[1:] == [0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]
