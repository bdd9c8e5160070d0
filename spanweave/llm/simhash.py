"""SimHash near-dedup by deletion-variant signatures.

A fingerprint of 64-bit words is cut into so few segments that of two fingerprints within the radius one segment differs
by at most one bit (64 bits, radius 3: two segments of 32). Each segment is indexed once for every bit position with that
bit a wildcard; fingerprints that meet under one key are verified over all bits. A pair may meet under several variants; the pairs
that pass are made distinct. Equal fingerprints are one class, linked through the class, and the members of a key through its
smallest one where that holds, so neither copies nor groups of near copies are expanded into pairs.

Defined results: a null or empty text has no words and fingerprint zero, linked like any other; a null id keeps its
fingerprint and gets its component's smallest id (null if there is none); repeated rows come back as often as they came;
very long texts are hashed whole, in blocks; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.support import Workspace, components, tidied, words
from spanweave.session import ship_package
from spanweave.workspace import dealt

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
#: Hashes handled at once: bounds the memory a very long text takes.
_BLOCK = 1 << 18


def shingle_hashes(found: list[bytes], size: int) -> np.ndarray:
    """XXH64, seed 42, of the space-joined shingles of `size` words; the whole sequence if there are fewer."""
    if not found:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(found) <= size:
        return np.array([h(b" ".join(found), 42)], np.uint64)
    join = b" ".join
    return np.array([h(join(x), 42) for x in zip(*(found[i:] for i in range(size)), strict=False)], np.uint64)


def spread(hashes: np.ndarray, word: int) -> np.ndarray:
    """The hash itself for word 0, else a 64-bit mix of it for the further words of a longer fingerprint."""
    if word == 0:
        return hashes
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * word) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, n_words: int = 1) -> list[int]:
    """Signed 64-bit words; a bit is 1 if set in over half the hashes."""
    if not n_words:
        return []
    ones = np.zeros((8 * n_words, 8))
    offsets = (np.arange(8 * n_words, dtype=np.uint16) * 256).reshape(n_words, 1, 8)
    for at in range(0, len(hashes), _BLOCK):
        part = np.array([spread(hashes[at : at + _BLOCK], word) for word in range(n_words)], "<u8")
        lanes = part.view(np.uint8).reshape(n_words, -1, 8) + offsets
        ones += np.bincount(lanes.ravel(), minlength=2048 * n_words).reshape(-1, 256) @ _BITS
    return np.packbits(ones * 2 > len(hashes), axis=1, bitorder="little").ravel().view("<i8").tolist()


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, n_words: int = 1, sets: bool = False, once: bool = False) -> DataFrame:
    """(id, fp array<bigint>). With once, repeats of a shingle don't weigh, and there are `same`, a 128-bit hash of the set of shingles,
    and n, its size; with sets, `shingles` array<bigint> holds the sorted distinct hashes."""
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, found, same, sizes = [], [], [], []
            for text in batch.column("text"):
                h = shingle_hashes(words(text.as_py()), shingle)
                if once or sets:
                    h = np.unique(h)
                fps.append(fingerprint(h, n_words))
                if once:
                    same.append(xxhash.xxh3_128_digest(h.tobytes()))
                    sizes.append(len(h))
                if sets:
                    found.append(h.view(np.int64))
            columns = {"id": batch.column("id"), "fp": pa.array(fps, pa.list_(pa.int64()))}
            if once:
                columns |= {"same": pa.array(same, pa.binary()), "n": pa.array(sizes, pa.int64())}
            if sets:
                columns["shingles"] = pa.array(found, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(columns)

    return kept.mapInArrow(lambda batches: tidied(run(batches)), "id bigint, fp array<bigint>" + ", same binary, n bigint" * once + ", shingles array<bigint>" * sets)


def segments_of(n_words: int, per_word: int) -> list[tuple[int, int, int]]:
    """(word, low bit, width) of every segment."""
    cuts = [round(64 * i / per_word) for i in range(per_word + 1)]
    return [(w, cuts[i], cuts[i + 1] - cuts[i]) for w in range(n_words) for i in range(per_word)]


def _segment(fp: str, part: tuple[int, int, int]) -> Column:
    word, low, width = part
    return F.shiftrightunsigned(F.col(fp)[word], low).bitwiseAND(F.lit((1 << width) - 1))


def variant_index(classes: DataFrame, parts: list[tuple[int, int, int]], *kept: Column | str) -> DataFrame:
    """The kept columns and `key`, once for every one-wildcard key of column fp: segment and wildcard place above, the segment
    without that bit below. Two explodes keep the plan's code small."""
    cut = F.array(*[F.struct(_segment("fp", p).alias("seg"), F.lit(p[2]).alias("width")) for p in parts])
    names = [*classes.select(*kept).columns]
    each = classes.select(*kept, F.posexplode(cut).alias("s", "part"))
    each = each.select(*names, "s", "part.seg", F.explode(F.sequence(F.lit(0), F.col("part.width") - 1)).alias("wild"))
    bare = F.expr("seg & ~shiftleft(1L, wild)")
    return each.select(*names, bare.bitwiseOR(F.expr("shiftleft(cast(s * 64 + wild as bigint), 33)")).alias("key"))


#: Deviations above its mean to which the number of differing bits of a pair is allowed for: one pair in 44 at the limit exceeds it, one in 200 at similarity 0.82.
SPREAD = 2.0


def radius_of(similarity: float, bits: int) -> int:
    """Differing bits of `bits` that a pair of Jaccard similarity `similarity` has at most, but for the chance that SPREAD leaves: each
    bit differs with probability acos(c) / pi, c = 2 s / (1 + s) being the cosine of two sets of one size."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + SPREAD * math.sqrt(bits * p * (1 - p)))


def apart_pairs(rows: DataFrame, prints: DataFrame, n_words: int, radius: int) -> DataFrame:
    """rows (key, node, comp), prints (node, fp) -> distinct pairs (a, b) of one key, of different components and within `radius`.

    Keys of one component are left out, and in the others only members outside the component of the smallest node look for
    partners, so a large component costs nothing by itself.
    """
    tops = rows.groupBy("key").agg(F.min(F.struct("node", "comp"))["comp"].alias("top"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    mixed = rows.join(dealt(tops.where("low <> high").select("key", "top")), "key").join(dealt(prints), "node")
    apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.comp") != F.col("b.comp"))
    once = (F.col("b.comp") == F.col("b.top")) | (F.col("a.node") < F.col("b.node"))
    met = mixed.where("comp <> top").alias("a").join(dealt(mixed.alias("b")), apart & once & (distance("a.fp", "b.fp", n_words) <= radius))
    return met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def distance(a: str, b: str, n_words: int) -> Column:
    return sum((F.bit_count(F.col(a)[w].bitwiseXOR(F.col(b)[w])) for w in range(n_words)), F.lit(0))


def near_links(space: Workspace, classes: DataFrame, n_words: int, per_word: int, radius: int) -> DataFrame:
    """classes: a written table of distinct (node, fp) -> links (a, b) with the components of all pairs that agree in a segment but for
    one bit and differ in at most `radius` bits.

    The index carries nodes alone; fingerprints are joined to the rows of keys that several nodes share. The members of a key
    are first compared with its smallest node. Pairs left are those of different components so far, under the same keys. So a group
    of near copies costs rows as its members, not as its pairs, and no pair that could join two components is left out.
    """
    # dealt out anew: the classes are small and their index is not
    classes = classes.repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")
    index = variant_index(classes, segments_of(n_words, per_word), "node")
    prints = classes.select("node", "fp")
    held = index.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    shared = space.write(index.join(dealt(held), "key"), "shared")
    met = shared.where("node > hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    met = met.join(dealt(prints.select(F.col("node").alias("a"), F.col("fp").alias("fa"))), "a").join(dealt(prints.select(F.col("node").alias("b"), F.col("fp").alias("fb"))), "b")
    links = space.write(met.where(distance("fa", "fb", n_words) <= radius).select("a", "b"), "links")
    placed = space.write(components(space, links).select("node", F.col("component").alias("comp")), "placed")
    rest = shared.where("n > 2").select("key", "node").join(dealt(placed), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    pairs = space.write(apart_pairs(rest, prints, n_words, radius), "pairs")
    space.drop(shared)
    return links.union(pairs)


def simhash_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, component): 64-bit fingerprints, linked at `radius` differing bits, radius at most 3."""
    if not 0 <= radius <= 3:
        raise ValueError("two segments with one wildcard bit find every pair up to radius 3")
    ship_package(spark)
    space = Workspace(spark, "simhash")
    prints = space.write(with_fingerprints(docs, id_col, text_col, shingle).select("id", F.col("fp")[0].alias("fp")), "prints")
    classes = space.write(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    links = near_links(space, classes.select(F.col("fp").alias("node"), F.array("fp").alias("fp")), 1, 2, radius)
    reached = components(space, links)
    placed = classes.join(dealt(reached.withColumnRenamed("node", "fp")), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    found = placed.join(dealt(least), "component").select("fp", "component_id")
    return prints.join(dealt(found), "fp").select("id", "fp", F.col("component_id").alias("component"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = simhash_components(spark, docs)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
