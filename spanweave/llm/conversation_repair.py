"""Conversation structure repair: the cheapest edits that turn a conversation's roles into `(s?(ua)+)?`.

A retained-subsequence dynamic programme chooses which turns stay, with their role or another; what lies between two retained turns is
deleted. Its parts:

- Prefix deletion sums price a gap: with D the cost of deleting everything so far, retaining turn i after turn j costs D[i-1] - D[j] for
  the gap. For each role of the last retained turn one running minimum of f[j] - D[j] is held, so a turn takes constant time however long
  the gap before it.
- The pair of roles at both ends of a gap determines the inserts in it (none or one; after the last turn, up to two).
- Of equally cheap edits the least audit wins, the string of edits' initials in order. Two audits over the same turns are never one the
  other's prefix (each ends in a turn's letter), so the running minima hold their audits' order alone, as ranks.

A conversation of any length is dealt over tasks. The rows are dealt by ranges of (conversation, turn), and what a range holds of a
conversation is a segment. A segment is summed up as a matrix: for each role before it and each role at its end the least cost and the
audit's rank. Such matrices compose, which gives each segment its roles at both ends; then each is solved by itself. Only conversations that
range borders cut, at most one a border, take that way. Identical rows are one row with a number of copies, whose further copies are
deletions, so they can't crowd a task either. The digests alone read a conversation in order in one task, as SHA-256 must, as a stream of
rows that holds one hash and the audit.

Defined results: a null role or text is one space, which no pattern takes, so such a turn is reroled, or deleted as blank; an empty role has no
initial and is treated alike; roles count by their first letter, so `s`, `u` and `a` with anything behind them may be kept; null
turns come first; rows that tie on turn are in order of role, the text's first 32 code points and its hash; null conversation ids are one
conversation; repeated rows are duplicates; an empty table gives an empty result; very long texts are passed through whole; further columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.support import ASCII_SPACE, Workspace, tidied
from spanweave.session import ship_package

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The role of the last retained turn, by its initial; NONE before the first.
NONE, SYSTEM, USER, ASSISTANT = range(4)
_STATES = (NONE, SYSTEM, USER, ASSISTANT)
_CLASS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: (role before, role after): inserts between them. A system turn comes first or not at all.
_INSERTS = {(NONE, SYSTEM): 0, (NONE, USER): 0, (NONE, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1, (USER, ASSISTANT): 0, (USER, USER): 1, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1}
_TAIL = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: A turn's code: its role's class, and these.
BLANK, LATER, CUT = 4, 8, 16
#: A null role before a segment.
_FIRST = -1

Turn = tuple[int, int, int]  # place, code, copies


class Minima:
    """Running minima over the turns of one segment, from one role before it."""

    def __init__(self, before: int):
        self.deleted = 0
        #: role of the last retained turn: (f[j] - D[j], rank of its audit, the retained turns as a chain)
        self.low: dict[int, tuple[int, int, tuple | None]] = {before: (0, 0, None)}

    def add(self, turn: Turn) -> None:
        place, code, copies = turn
        before = self.deleted
        self.deleted += DELETE * copies
        if code & (BLANK | LATER):
            return
        role, extra = code & 3, TRUNCATED if code & CUT else 0
        after = DELETE * (copies - 1)
        # the turn deleted: each minimum goes on, its audit grown by D
        found = {state: (low, rank, "D", chain) for state, (low, rank, chain) in self.low.items()}
        for to in (SYSTEM, USER, ASSISTANT):
            if to == role:
                letter, price = "K", extra
            elif to == SYSTEM:
                continue
            else:
                letter, price = "R", REROLE + extra
            for state, (low, rank, chain) in self.low.items():
                if (state, to) in _INSERTS:
                    n = _INSERTS[state, to]
                    cost = low + before + INSERT * n + price + after - self.deleted
                    letters = "I" * n + letter
                    if to not in found or (cost, rank, letters) < found[to][:3]:
                        found[to] = cost, rank, letters, (chain, place, letters, to)
        order = sorted(found, key=lambda s: found[s][1:3])
        self.low = {s: (found[s][0], order.index(s), found[s][3]) for s in found}

    def ended(self) -> dict[int, tuple[int, int]]:
        """Role of the last retained turn: (cost, rank) with all turns so far dealt with."""
        return {s: (low + self.deleted, rank) for s, (low, rank, _) in self.low.items()}


def best_end(ends: dict[int, tuple[int, int]]) -> int:
    """The role to end with: the least cost with the inserts behind it, then the least audit."""
    return min(ends, key=lambda s: (ends[s][0] + INSERT * _TAIL[s], ends[s][1]))


def solve(turns: list[Turn], before: int = NONE, end: int | None = None) -> tuple[dict[int, tuple[str, int]], int]:
    """({place: (letters, role)} of the retained turns, the role of the last one) between two roles; end None: the end of a conversation."""
    minima = Minima(before)
    for turn in turns:
        minima.add(turn)
    end = best_end(minima.ended()) if end is None else end
    chain, kept = minima.low[end][2], {}
    while chain:
        chain, place, letters, to = chain
        kept[place] = letters, to
    return kept, end


def matrix(turns: list[Turn]) -> list[int]:
    """(cost, rank) for each role before and each at the end, row by row; -1 where there is no way."""
    out = []
    for before in _STATES:
        minima = Minima(before)
        for turn in turns:
            minima.add(turn)
        ends = minima.ended()
        out += [x for s in _STATES for x in ends.get(s, (-1, -1))]
    return out


def compose(matrices: list[list[int]]) -> list[tuple[int, int]]:
    """The roles before and at the end of each segment of one conversation, in order."""
    ends, came = {NONE: (0, 0)}, []
    for m in matrices:
        found: dict[int, tuple] = {}
        for before, (cost, rank) in ends.items():
            for s in _STATES:
                more, local = m[8 * before + 2 * s : 8 * before + 2 * s + 2]
                if more >= 0 and (s not in found or (cost + more, rank) < found[s][:2]):
                    found[s] = cost + more, rank, local, before
        order = sorted(found, key=lambda s: found[s][1:3])
        ends = {s: (found[s][0], order.index(s)) for s in found}
        came.append({s: found[s][3] for s in found})
    state, out = best_end(ends), []
    for step in reversed(came):
        out.append((step[state], state))
        state = step[state]
    return out[::-1]


def coded(turns: DataFrame, space: Workspace) -> DataFrame:
    """(conv_id, turn, role, text, copies, code, seg, place) of (conv_id, turn, role, text, copies): distinct rows, dealt by ranges, in order
    of place. Written."""
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    rows = space.write(rows.select("*", F.md5("text").alias("h")), "rows")
    # what a conversation says again, by its first turn; a null turn is before all others
    again = rows.groupBy("conv_id", "role", "h").agg(F.count("*").alias("n"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("null_first")).where("n > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("x"), "first", "null_first")
    rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("x")), "left")
    later = F.col("turn").isNotNull() & (F.col("null_first") | (F.col("turn") > F.col("first")))
    said = F.rtrim(F.col("text"), F.lit(ASCII_SPACE))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(NONE)
    code += F.when(said == "", BLANK).when(F.coalesce(later, F.lit(False)), LATER).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)
    rows = rows.select("conv_id", "turn", "role", "text", "copies", "h", code.cast("int").alias("code"))
    order = ["conv_id", "turn", "role", F.substring("text", 1, 32), "h"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return space.write(dealt.drop("h").withColumn("seg", F.shiftright("place", 33).cast("int")), "turns")


def _turns_of(rows: list[dict]) -> list[Turn]:
    return [(r["place"], r["code"], r["copies"]) for r in rows]


def _summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            turns = _turns_of(row["rows"])
            yield pa.RecordBatch.from_pylist([{"conv_id": row["conv_id"], "seg": row["seg"], "matrix": matrix(turns), "last": turns[-1][1] & 3}], pa.schema([("conv_id", pa.int64()), ("seg", pa.int32()), ("matrix", pa.list_(pa.int64())), ("last", pa.int32())]))


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("c", pa.int64()), ("s", pa.int32()), ("before", pa.int32()), ("end", pa.int32()), ("closes", pa.bool_()), ("role_before", pa.int32())])
    for batch in batches:
        for row in batch.to_pylist():
            ways = compose([x["matrix"] for x in row["segs"]])
            yield pa.RecordBatch.from_pylist([{"c": row["conv_id"], "s": x["seg"], "before": a, "end": b, "closes": i + 1 == len(ways), "role_before": row["segs"][i - 1]["last"] if i else _FIRST} for i, (x, (a, b)) in enumerate(zip(row["segs"], ways, strict=True))], schema)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("at", pa.int64()), ("letters", pa.string()), ("to", pa.int32()), ("tail", pa.int32()), ("illegal", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            turns = _turns_of(row["rows"])
            alone = row["end"] is None
            kept, end = solve(turns) if alone else solve(turns, row["before"], row["end"])
            last = _FIRST if alone else row["role_before"]
            out = []
            for place, code, copies in turns:
                letters, to = kept.get(place, ("D", None))
                wrong = copies - 1 + (last != _FIRST and (last, code & 3) not in _LEGAL)
                out.append({"at": place, "letters": letters, "to": to, "tail": 0, "illegal": wrong})
                last = code & 3
            if alone or row["closes"]:
                out[-1]["tail"] = _TAIL[end]
            yield pa.RecordBatch.from_pylist(out, schema)


def edits(turns: DataFrame, space: Workspace) -> DataFrame:
    """The rows of coded() with letters (D, K, IK, R or IR; further copies are deleted), to (the role's class where it stays), tail (inserts after
    a conversation's last row) and illegal (pairs of initials, this row's second)."""
    spark = turns.sparkSession
    ship_package(spark)
    rows = coded(turns, space)
    segs = space.write(rows.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list(F.struct("place", "code", "copies"))).alias("rows")), "segments")
    # a border between ranges cuts one conversation at most: these are fewer than the ranges, and their segments fewer than twice as many
    several = segs.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("c"))
    summed = segs.join(F.broadcast(several), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").mapInArrow(_summed_up, "conv_id bigint, seg int, matrix array<bigint>, last int")
    ways = summed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "matrix", "last"))).alias("segs")).mapInArrow(_composed, "c bigint, s int, before int, end int, closes boolean, role_before int")
    ways = space.write(ways, "ways")
    dealt = segs.join(F.broadcast(ways), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s")), "left").select("rows", "before", "end", "closes", "role_before")
    made = dealt.mapInArrow(lambda batches: tidied(_edited(batches)), "at bigint, letters string, to int, tail int, illegal bigint")
    return rows.join(made, F.col("place") == F.col("at")).drop("at", "seg")


class _Digest:
    """What is told of one conversation, row by row."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns = conv_id, (None, None, 0)
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.sha, self.started = hashlib.sha256(), False

    def say(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.started else ''}{role}:{text}".encode())
        self.started = True

    def add(self, r: dict) -> None:
        low, high, n = self.turns
        turn, code, copies = r["turn"], r["code"], r["copies"]
        if turn is not None and turn != high:
            self.turns = turn if low is None else low, turn, n + 1
        self.blank += copies if code & BLANK else 0
        self.duplicate += 0 if code & BLANK else copies - 1 + bool(code & LATER)
        self.truncated += bool(code & CUT)
        self.illegal += r["illegal"]
        letters, to = r["letters"], r["to"]
        tail = "I" * r["tail"]
        self.audit.append(letters + "D" * (copies - 1) + tail)
        self.cost += DELETE * (copies - 1 + (letters == "D")) + INSERT * (letters.count("I") + len(tail))
        if to is not None:
            self.cost += REROLE * ("R" in letters) + TRUNCATED * bool(code & CUT)
            if "I" in letters:
                self.say(_ROLE[USER if to == ASSISTANT else ASSISTANT], "")
            self.say(r["role"] if "K" in letters else _ROLE[to], r["text"])
        for role in ("user", "assistant")[2 - len(tail) :]:
            self.say(role, "")

    def row(self) -> dict:
        low, high, n = self.turns
        return {"c": self.conv_id, "gaps": high - low + 1 - n if n else 0, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


_LONGS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def digests(edited: DataFrame) -> DataFrame:
    """(c, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) a conversation, from a stream of sorted rows."""
    schema = pa.schema([("c", pa.int64()), *[(k, pa.int64()) for k in _LONGS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Digest | None = None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if held is None or held.conv_id != r["conv_id"]:
                    done += [held.row()] if held else []
                    held = _Digest(r["conv_id"])
                held.add(r)
            yield pa.RecordBatch.from_pylist(done, schema)
        if held:
            yield pa.RecordBatch.from_pylist([held.row()], schema)

    columns = ["conv_id", "place", "turn", "role", "text", "copies", "code", "letters", "to", "tail", "illegal"]
    ordered = edited.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(lambda batches: tidied(run(batches)), "c bigint, " + ", ".join(f"{k} bigint" for k in _LONGS) + ", audit string, repaired_sha256 string")


def plain(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of the rows as they are, a null role or text one space."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *texts, F.lit(1).alias("copies"))


def damaged(turns: DataFrame) -> DataFrame:
    """plain() with the damage that the hash of `conv_id:turn` modulo 20 names: 0 the row goes, 1 its text is emptied, 2 loses [.!?], 3 the row is
    there twice, 4 its role is user. A null is one space in the hash too."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    rows = plain(turns).withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def repaired_conversations(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, place, part, role, text, edit) of the repaired conversations of (conv_id, turn, role, text), in order of place and part within
    a conversation; inserted turns have an empty text."""
    e = edits(plain(turns), Workspace(turns.sparkSession, "repair"))
    named = lambda to: F.when(to == USER, "user").otherwise("assistant")
    empty = F.lit("")

    def said(part: int, role: Column, text: Column, edit: str | Column) -> Column:
        return F.struct(F.lit(part).alias("part"), role.alias("role"), text.alias("text"), (F.lit(edit) if isinstance(edit, str) else edit).alias("edit"))

    inserted = F.when(F.startswith("letters", F.lit("I")), said(0, F.when(F.col("to") == USER, "assistant").otherwise("user"), empty, "I"))
    kept = F.when(F.col("to").isNotNull(), said(1, F.when(F.endswith("letters", F.lit("K")), F.col("role")).otherwise(named(F.col("to"))), F.col("text"), F.right("letters", F.lit(1))))
    tails = F.when(F.col("tail") == 2, said(2, F.lit("user"), empty, "I")), F.when(F.col("tail") > 0, said(3, F.lit("assistant"), empty, "I"))
    return e.select("conv_id", "place", F.explode(F.array_compact(F.array(inserted, kept, *tails))).alias("x")).select("conv_id", "place", "x.*")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    ids = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = digests(edits(damaged(turns), Workspace(spark, "repair")))
    zeros = [F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in _LONGS]
    nothing = hashlib.sha256(b"").hexdigest()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return joined.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
