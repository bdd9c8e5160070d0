"""Near-dedup of documents by shingle sets, on SimHash fingerprints with deletion-variant signatures.

Documents of equal shingle sets are one class. A class has a fingerprint of N_WORDS 64-bit words over its distinct shingles, the first
INDEXED of which are cut into segments of WIDTH bits: at similarity 0.8 about 15 % of the bits differ, and one of the 19 segments differs by at most one bit
with probability 0.97 (0.99 from 0.85). Candidates come in three ways, each verified on the exact shingle sets:

1. Exact segments: every class is compared with the smallest classes of its segments' buckets, and tried with the NEAREST
   of those within the radius. This joins groups of near copies early, at a few rows a member.
2. One-wildcard variants: each segment is indexed once for every bit with that bit left out. The variants whose wildcards lie in
   one HALF of a segment share its other bits; by these the class is dealt, once a half and with its whole fingerprint, and the
   task joins the half's variants on equality. Classes that meet are candidates if they lie in different components so far, their
   sizes allow the similarity and their fingerprints lie within the radius; a pair comes up once, under the first of its segments.
   Of the pairs between two components a batch of keys gives SOME and marks the two; where they are still
   apart afterwards, all pairs of their classes are taken by a second run over the index. So no pair is left out, and a group of copies
   costs rows as its members.
3. Short sets, of at most SHORT shingles, whose fingerprints have few votes a bit: prefix filter on their rarest shingles, which
   finds every pair.

Keys are grouped by one shuffle and a sort; a task reads its groups as a stream and holds one group at a time. A group of variants
holds all classes that agree in half a segment, 1 in 1024 of unrelated ones at some 100 bytes each: beyond some 10^9 classes WIDTH and
INDEXED must grow, with a smaller HALF.

Defined results: a null or empty text has no shingles and all such texts are one class; a text of fewer words than a shingle
has its whole sequence as one shingle; a null id is not grouped by near_duplicate_groups and kept by without_near_duplicates;
rows that repeat an id are documents of their own; very long texts are taken whole; an empty table gives an empty result; other
columns are passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanweave.llm.simhash import SPREAD, radius_of, shingle_hashes, with_fingerprints
from spanweave.llm.support import Workspace, components, spare_name, tidied, words
from spanweave.session import ship_package

N_WORDS, INDEXED, WIDTH, HALF = 8, 6, 20, 10
#: Pairs that two components give in a batch of keys of the first run over the index.
SOME = 2
#: Classes of a bucket that others are compared with, and of those the ones a class is tried with; what they leave apart is found
#: by the variants.
LEADERS, NEAREST = 16, 4
SHORT = 24
#: A key's low bits: a half's value and a size.
_VALUE, _GROUP = 32, 32 + HALF


def bits_of(fp: str, low: int, width: int) -> Column:
    """`width` bits of an array of 64-bit words from place `low`."""
    word, at = divmod(low, 64)
    found = F.shiftrightunsigned(F.col(fp)[word], at)
    if at + width > 64:
        found = found.bitwiseOR(F.shiftleft(F.col(fp)[word + 1], 64 - at))
    return found.bitwiseAND(F.lit((1 << width) - 1))


def segment_lows(n_words: int) -> list[int]:
    return list(range(0, 64 * min(n_words, INDEXED) - WIDTH + 1, WIDTH))


def exact_index(classes: DataFrame, n_words: int) -> DataFrame:
    """(key, node, fp): a row for every segment."""
    cut = F.array(*[bits_of("fp", low, WIDTH).bitwiseOR(F.lit(s << WIDTH)) for s, low in enumerate(segment_lows(n_words))])
    return classes.select(F.explode(cut).alias("key"), "node", "fp")


def variant_index(classes: DataFrame, n_words: int) -> DataFrame:
    """(key, node, comp, fp): a row for every half of every segment. From above, the key holds segment, half, the segment without
    the half (together the group), the half's value and the size of the set."""
    cut = F.array(*[bits_of("fp", low, WIDTH) for low in segment_lows(n_words)])
    each = classes.select("node", "comp", "fp", "n", F.posexplode(cut).alias("s", "seg"))
    each = each.select("node", "comp", "fp", "n", "s", "seg", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - HALF), F.lit(HALF))).alias("low"))
    rest = f"((seg & (shiftleft(1L, low) - 1)) | shiftleft(shiftrightunsigned(seg, low + {HALF}), low))"
    value = f"(shiftrightunsigned(seg, low) & {(1 << HALF) - 1}L)"
    place = f"shiftleft(cast(s * {WIDTH // HALF} + low div {HALF} as bigint), {WIDTH - HALF})"
    return each.select(F.expr(f"shiftleft({place} | {rest}, {_GROUP}) | shiftleft({value}, {_VALUE}) | least(n, {(1 << _VALUE) - 1}L)").alias("key"), "node", "comp", "fp")


def whole_groups(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[pa.Table]:
    """The rows of sorted batches, cut where key >> shift changes; a group is never cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("key").to_numpy() >> shift
        if held and (held[-1].column("key")[-1].as_py() >> shift) != group[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = int(np.searchsorted(group, group[-1]))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _numpy(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def leader_pairs(batches: Iterator[pa.RecordBatch], n_words: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Sorted (key, node, fp) -> (a, node, d): each node with the smallest of its group within the radius that isn't within that of a
    smaller one itself, for LEADERS such a group."""
    for table in whole_groups(batches, 0):
        key, node = _numpy(table, "key"), _numpy(table, "node")
        fps = table.column("fp").combine_chunks().flatten().to_numpy().reshape(-1, n_words)
        for _ in range(LEADERS):
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, int)
            sizes = np.diff(np.append(first, len(key)))
            left = np.repeat(sizes > 1, sizes)
            if not left.any():
                break
            lead = np.repeat(first, sizes)[left]
            here = np.flatnonzero(left)
            d = np.bitwise_count(fps[here] ^ fps[lead]).sum(axis=1)
            near = (d <= radius) & (here != lead)
            if near.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[lead[near]]), pa.array(node[here[near]]), pa.array(d[near].astype(np.int32))], ["a", "node", "d"])
            rest = here[d > radius]
            key, node, fps = key[rest], node[rest], fps[rest]


def _some(a: np.ndarray, b: np.ndarray, comp: np.ndarray, some: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of places, `some` for any two components, and whether these had more."""
    if some is None or not len(a):
        return a, b, np.zeros(len(a), bool)
    low, high = np.minimum(comp[a], comp[b]), np.maximum(comp[a], comp[b])
    order = np.lexsort((high, low))
    first = np.append(True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]))
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(order)))
    rank = np.arange(len(order)) - np.repeat(starts, sizes)
    kept = rank < some
    cut = np.repeat(sizes > some, sizes)[kept]
    order = order[kept]
    return a[order], b[order], cut


def _met(group: np.ndarray, comp: np.ndarray, test: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of one group, in different components, that pass the test; groups lie together."""
    if not len(group):
        return
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    mixed = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
    few = mixed & (sizes <= 32)
    here = np.flatnonzero(np.repeat(few, sizes))
    for step in range(1, int(sizes[few].max(initial=1))):
        here = here[here + step < len(group)]
        here = here[group[here] == group[here + step]]
        some = here[comp[here] != comp[here + step]]
        ok = test(some, some + step)
        yield some[ok], some[ok] + step
    for start, size in zip(starts[mixed & (sizes > 32)], sizes[mixed & (sizes > 32)], strict=True):
        at = np.arange(start, start + size)
        values, times = np.unique(comp[at], return_counts=True)
        large = values[times.argmax()]
        outside = at[comp[at] != large]
        block = max(1, (1 << 16) // size)
        for k in range(0, len(outside), block):
            a, b = np.repeat(outside[k : k + block], size), np.tile(at, len(outside[k : k + block]))
            ok = (comp[a] != comp[b]) & ((comp[b] == large) | (a < b))
            a, b = a[ok], b[ok]
            ok = test(a, b)
            yield a[ok], b[ok]


def _rows(node: np.ndarray, comp: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]], some: int | None) -> Iterator[pa.RecordBatch]:
    """(a, b, ca, cb, cut) of the places found: all of them, or `some` of those between two components."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out(a: np.ndarray, b: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
        columns = (np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), np.minimum(comp[a], comp[b]), np.maximum(comp[a], comp[b]), cut)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "b", "ca", "cb", "cut"])

    for a, b in found:
        if not len(a):
            continue
        if some is None:
            yield out(a, b, np.zeros(len(a), bool))
        else:  # one more than are given, so that the mark can be made below
            a, b, _ = _some(a, b, comp, some + 1)
            held.append((a, b))
    if held:
        yield out(*_some(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]), comp, some))


def _comps(table: pa.Table, node: np.ndarray) -> np.ndarray:
    column = table.column("comp").combine_chunks()
    return np.where(column.is_null().to_numpy(zero_copy_only=False), node, column.fill_null(0).to_numpy(zero_copy_only=False))


def variant_pairs(batches: Iterator[pa.RecordBatch], n_words: int, similarity: float, some: int | None) -> Iterator[pa.RecordBatch]:
    """Sorted rows of variant_index -> (a, b, ca, cb, cut): pairs of different components of which a segment differs by at most one bit
    and the whole fingerprints by no more than the sizes and the similarity allow; each pair under the first such segment only."""
    lows, share, bits = segment_lows(n_words), similarity / (1 + similarity), 64 * n_words
    for table in whole_groups(batches, _GROUP):
        key, node = _numpy(table, "key"), _numpy(table, "node")
        comp, fps = _comps(table, node), table.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, n_words)
        group, value = key >> _GROUP, key >> _VALUE & ((1 << HALF) - 1)
        n = (key & ((1 << _VALUE) - 1)).astype(np.float64)
        place = group >> (WIDTH - HALF)
        segment, half = place // (WIDTH // HALF), place % (WIDTH // HALF)

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            x = fps[a] ^ fps[b]  # noqa: B023
            # shingles shared at least, over the geometric mean of the sizes, is the least cosine
            root = np.sqrt(n[a] * n[b])  # noqa: B023
            p = np.arccos(np.clip(np.divide(share * (n[a] + n[b]), root, out=np.ones(len(a)), where=root > 0), 0, 1)) / np.pi  # noqa: B023
            ok = np.minimum(n[a], n[b]) >= (similarity - 1e-9) * np.maximum(n[a], n[b])  # noqa: B023
            ok &= np.bitwise_count(x).sum(axis=1) <= np.ceil(bits * p + SPREAD * np.sqrt(bits * p * (1 - p)))
            at = np.flatnonzero(ok)
            x, own = x[at], segment[a[at]]  # noqa: B023
            earlier = np.zeros(len(at), bool)
            for s, low in enumerate(lows):
                word, shift = divmod(low, 64)
                part = x[:, word] >> np.uint64(shift)
                if shift + WIDTH > 64:
                    part = part | (x[:, word + 1] << np.uint64(64 - shift))
                earlier |= (s < own) & (np.bitwise_count(part & np.uint64((1 << WIDTH) - 1)) <= 1)
            ok[at[earlier]] = False
            return ok

        def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            same = np.flatnonzero(half == 0)  # noqa: B023  equal segments meet under either half
            whole = (group << HALF | value)[same]  # noqa: B023
            for a, b in _met(whole, comp[same], lambda a, b: near(same[a], same[b])):  # noqa: B023
                yield same[a], same[b]
            for bit in range(HALF):
                wild = group << HALF | value & ~(1 << bit)  # noqa: B023
                order = np.argsort(wild, kind="stable")
                own = (value >> bit & 1)[order]  # noqa: B023

                def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                    ok = own[a] != own[b]  # noqa: B023
                    ok[ok] = near(order[a[ok]], order[b[ok]])  # noqa: B023
                    return ok

                for a, b in _met(wild[order], comp[order], apart):  # noqa: B023
                    yield order[a], order[b]

        yield from _rows(node, comp, each(), some)


def key_pairs(batches: Iterator[pa.RecordBatch], some: int | None) -> Iterator[pa.RecordBatch]:
    """Sorted (key, node, comp) -> (a, b, ca, cb, cut): the pairs of one key and different components."""
    for table in whole_groups(batches, 0):
        node = _numpy(table, "node")
        comp = _comps(table, node)
        yield from _rows(node, comp, _met(_numpy(table, "key"), comp, lambda a, b: np.ones(len(a), bool)), some)


PAIRS = "a bigint, b bigint, ca bigint, cb bigint, cut boolean"


def _dealt(rows: DataFrame, group: Column) -> DataFrame:
    """One shuffle by the group and a sort."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), group).sortWithinPartitions("key", "node")


def met_under_variants(classes: DataFrame, n_words: int, similarity: float, some: int | None) -> DataFrame:
    dealt = _dealt(variant_index(classes, n_words), F.shiftright("key", _GROUP))
    return dealt.mapInArrow(lambda batches: tidied(variant_pairs(batches, n_words, similarity, some)), PAIRS)


def met_under_keys(rows: DataFrame, some: int | None) -> DataFrame:
    """rows (key, node, comp) -> distinct (a, b, ca, cb), and whether the two components had more."""
    found = _dealt(rows, F.col("key")).mapInArrow(lambda batches: key_pairs(batches, some), PAIRS)
    return found.groupBy("a", "b", "ca", "cb").agg(F.max("cut").alias("cut"))


class Finder:
    """The classes of one corpus, and the links found between them."""

    def __init__(self, space: Workspace, docs: DataFrame, shingle: int, similarity: float, n_words: int):
        self.space, self.docs, self.shingle, self.similarity, self.n_words = space, docs, shingle, similarity, n_words
        self.radius = radius_of(similarity, 64 * n_words)
        made = with_fingerprints(docs, "id", "text", shingle, n_words, once=True).withColumn("row", F.monotonically_increasing_id())
        self.prints = space.write(made, "prints")
        self.classes = space.write(self.prints.groupBy("same").agg(F.min_by(F.struct("row", "id", "n", "fp"), "row").alias("f")).select(F.col("f.row").alias("node"), "f.id", "f.n", "f.fp", "same"), "classes")
        self.sets: list[DataFrame] = []
        self.links: list[DataFrame] = []

    def _sets_of(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles) of distinct nodes; each class's set is made once, from one document of it."""
        wanted = self.classes.select("node", "id", "same").join(nodes, "node", "left_semi")
        for held in self.sets:
            wanted = wanted.join(held.select("node"), "node", "left_anti")
        # written first, so that the planner knows its size and does not shuffle the texts for a few ids
        wanted = self.space.write(wanted, "wanted")
        some = self.docs.join(wanted.select("id"), "id", "left_semi")
        made = with_fingerprints(some, "id", "text", self.shingle, 0, sets=True, once=True).join(wanted.select("node", "same"), "same")
        self.sets.append(self.space.write(made.select("node", "shingles"), "sets"))
        sets = self.sets[0]
        for held in self.sets[1:]:
            sets = sets.unionByName(held)
        return sets.dropDuplicates(["node"])

    def verify(self, pairs: DataFrame) -> None:
        """Keep the links among a written table of pairs (a, b)."""
        sets = self._sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        passed = both.where(shared >= F.lit(self.similarity - 1e-12) * (F.size("sa") + F.size("sb") - shared)).select("a", "b")
        self.links.append(self.space.write(passed, "links"))

    def reached(self) -> DataFrame:
        """(node, comp) of the linked nodes."""
        links = self.links[0]
        for more in self.links[1:]:
            links = links.union(more)
        return self.space.write(components(self.space, links).select("node", F.col("component").alias("comp")), "reached")

    def placed(self, *columns: str) -> DataFrame:
        """(node, ..., comp): comp null in a component of one."""
        return self.classes.select("node", *columns).join(self.reached(), "node", "left")

    def by_exact_segments(self) -> None:
        n_words, radius = self.n_words, self.radius
        found = _dealt(exact_index(self.classes, n_words), F.col("key")).mapInArrow(lambda batches: tidied(leader_pairs(batches, n_words, radius)), "a bigint, node bigint, d int")
        near = found.groupBy("node").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "a"))), 1, NEAREST).alias("near"))  # at most one a segment
        self.verify(self.space.write(near.select(F.explode("near.a").alias("a"), F.col("node").alias("b")), "nearest"))

    def by_variants(self) -> None:
        met = self.space.write(met_under_variants(self.placed("fp", "n"), self.n_words, self.similarity, SOME), "met")
        self.verify(met.select("a", "b"))
        self._finish(met, ["fp", "n"], lambda rest: met_under_variants(rest, self.n_words, self.similarity, None))

    def _finish(self, met: DataFrame, columns: list[str], again: Callable) -> None:
        """All pairs of the components that had more than SOME pairs and are still apart."""
        cut = met.where("cut").select("ca", "cb").distinct()
        if cut.isEmpty():
            return
        comp = self.reached()
        of = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_now"))
        apart = cut.join(of("ca"), "ca", "left").join(of("cb"), "cb", "left").withColumns({f"{c}_now": F.coalesce(f"{c}_now", c) for c in ("ca", "cb")}).where("ca_now <> cb_now")
        apart = self.space.write(apart.select(F.col("ca_now").alias("c")).union(apart.select("cb_now")).distinct(), "apart")
        if apart.isEmpty():
            return
        placed = self.classes.select("node", *columns).join(comp, "node", "left")
        rest = placed.join(apart, F.coalesce("comp", "node") == F.col("c"), "left_semi")
        self.verify(self.space.write(again(rest).select("a", "b"), "candidates"))

    def by_short_sets(self) -> None:
        """Two sets of sizes n <= m that pass share similarity * m or more, so both hold a shared shingle among their first
        n - ceil(similarity * n) + 1 by any one order; rarest first."""
        most = int(SHORT / self.similarity)
        short = self.classes.where(F.col("n").between(1, most))
        sets = self._sets_of(short.select("node"))
        each = sets.join(short.select("node"), "node", "left_semi").select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
        counts = each.groupBy("key").agg(F.count("*").alias("df"))
        place = F.row_number().over(W.partitionBy("node").orderBy("df", "key"))
        ordered = each.join(counts, "key").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.lit(self.similarity - 1e-9) * F.col("n")) + 1)
        keys = self.space.write(ordered.where("df > 1").select("key", "node"), "prefixes")
        met = self.space.write(met_under_keys(keys.join(self.reached(), "node", "left"), SOME), "met")
        self.verify(met.select("a", "b"))
        self._finish(met, [], lambda rest: met_under_keys(keys.join(rest, "node"), None))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, n_words: int = N_WORDS) -> DataFrame:
    """(id, component, same, kept): component is the smallest id reached over pairs of Jaccard similarity of `similarity` or
    more, same the 128-bit hash of the document's shingle set, and kept is true for the rows that stand for their component: those of
    its smallest id (where rows repeat that id, those of one shingle set)."""
    ship_package(spark)
    space = Workspace(spark, "neardup")
    texts = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    finder = Finder(space, texts, shingle, similarity, n_words)
    finder.by_exact_segments()
    finder.by_variants()
    finder.by_short_sets()
    found = finder.classes.select("node", "same").join(finder.reached(), "node", "left").select("same", F.coalesce("comp", "node").alias("comp"))
    rows = finder.prints.select("id", "same").join(found, "same")
    first = rows.groupBy("comp").agg(F.min(F.struct("id", "same")).alias("f"))
    out = rows.join(first, "comp").select("id", F.col("f.id").alias("component"), "same", ((F.col("id") == F.col("f.id")) & (F.col("same") == F.col("f.same"))).alias("kept"))
    done = space.write(out, "groups")
    space.drop(*[t for t in space.made if t is not done])
    return done


def without_near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies; rows without an id stay."""
    groups = near_duplicate_groups(spark, docs, id_col, text_col, shingle, similarity)
    # no column of docs has these names
    kept_id, kept_same, spare = (spare_name(docs, x) for x in ("kept_id", "kept_same", "same_set"))
    held = groups.groupBy("id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    key = F.col(f"`{id_col}`").cast("long")
    chosen = held.where("kept").select(F.col("id").alias(kept_id), "n")
    once = docs.join(chosen.where("n = 1").select(kept_id), key == F.col(kept_id), "left_semi")
    out = once.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
    many = chosen.where("n > 1").select(kept_id)
    if many.isEmpty():
        return out

    def same(texts: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh3_128_digest(np.unique(shingle_hashes(words(t.as_py()), shingle)).tobytes()) for t in texts], pa.binary())

    again = docs.join(many, key == F.col(kept_id), "left_semi").withColumn(spare, F.arrow_udf(same, "binary")(F.col(f"`{text_col}`").cast("string")))
    ours = groups.where("kept").select(F.col("id").alias(kept_id), F.col("same").alias(kept_same)).distinct()
    again = again.join(ours, (key == F.col(kept_id)) & (F.col(spare) == F.col(kept_same)), "left_semi")
    return out.unionByName(again.dropDuplicates([id_col, spare]).drop(spare))
