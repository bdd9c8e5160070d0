"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised at approximate quantiles, so that a hot value takes as many cells as it has
rows; the rows are ordered by the Hilbert index of their cell and cut into runs, each of which is compact in every
dimension, so that per-file minima and maxima prune files on any of them. The global order needs no global sort: counts of
cells (at most 2**12, each salted 16-fold by a hash of the id) are prefix-summed, and rows are ranked within their salted
cell.

Numbers are quantised at percentile_approx, strings at exact quantiles of the whole strings: counts of distinct values are sorted by
range and prefix-summed, and only the cuts reach the driver.

Defined results: null texts have size 1; nulls sort before all in each dimension; repeated rows get a place each, and rows that tie in
every column of the order may swap places; very long texts are read whole for their size and checksum and not shuffled; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanweave.llm.support import Workspace

SALTS = 16
CELL_BITS = 12


def hilbert_table(dims: int, bits: int) -> list[int]:
    """Hilbert index of every cell, cells numbered with dimension 0 in the high bits; built by walking the curve."""
    out = [0] * (1 << dims * bits)
    for index in range(len(out)):
        # transpose the index's bits over the dimensions, then undo Gray code and rotations from the coarsest level down
        x = [0] * dims
        for b in range(dims * bits):
            x[b % dims] |= (index >> (dims * bits - 1 - b) & 1) << (bits - 1 - b // dims)
        carry = x[-1] >> 1
        for i in range(dims - 1, 0, -1):
            x[i] ^= x[i - 1]
        x[0] ^= carry
        level = 2
        while level != 1 << bits:
            below = level - 1
            for i in range(dims - 1, -1, -1):
                if x[i] & level:
                    x[0] ^= below
                else:
                    swap = (x[0] ^ x[i]) & below
                    x[0] ^= swap
                    x[i] ^= swap
            level <<= 1
        cell = 0
        for v in x:
            cell = cell << bits | v
        out[cell] = index
    return out


def string_cuts(space: Workspace, rows: DataFrame, dim: str, n: int) -> list[str]:
    """n - 1 values of a string column that cut its rows into n parts of near equal size."""
    counts = rows.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("v")).agg(F.count("*").alias("c"))
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the counts are written before they are read twice, so that a range keeps its number
    counts = space.write(counts.repartitionByRange(spread, "v").select("v", "c", F.spark_partition_id().alias("part")), "values")
    base, wanted, total = 0, [], 0
    parts = sorted(((r["low"], r["part"], r["c"]) for r in counts.groupBy("part").agg(F.min("v").alias("low"), F.sum("c").alias("c")).collect()))  # one row a range
    total = sum(c for *_, c in parts)
    for _, part, c in parts:
        wanted += [(part, total * k / n - base) for k in range(1, n) if base < total * k / n <= base + c]
        base += c
    if not wanted:
        return []
    running = F.sum("c").over(W.partitionBy("part").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    placed = counts.where(F.col("part").isin([p for p, _ in wanted])).select("v", "part", running.alias("reach"))
    found = placed.agg(*[F.min(F.when((F.col("part") == p) & (F.col("reach") >= r), F.col("v"))).alias(f"k{k}") for k, (p, r) in enumerate(wanted)]).first()
    return sorted({v for v in found if v is not None})


def hilbert_index(space: Workspace, rows: DataFrame, dims: list[str], bits: int) -> Column:
    texts = [d for d in dims if rows.schema[d].dataType.typeName() == "string"]
    shares = [(i + 1) / (1 << bits) for i in range((1 << bits) - 1)]
    numbers = [d for d in dims if d not in texts]
    cuts = rows.agg(F.lit(0), *[F.percentile_approx(d, shares, 2000).alias(d) for d in numbers]).first().asDict()
    cuts |= {d: string_cuts(space, rows, d, 1 << bits) for d in texts}
    cell = F.lit(0)
    for d in dims:
        level = sum((F.when(F.col(d) > F.lit(c), 1).otherwise(0) for c in sorted(set(cuts[d] or []))), F.lit(0))
        cell = cell * (1 << bits) + level
    listed = ",".join(map(str, hilbert_table(len(dims), bits)))
    return F.expr(f"array({listed})")[cell]


def hilbert_shards(rows: DataFrame, dims: list[str], shards: int, salt: str, tie: list[str]) -> DataFrame:
    """rows plus hilbert, shard and slot, without the strings among the dims: row counts at most one apart, slots gapless along the
    curve. The dims are numbers or strings."""
    bits, space = CELL_BITS // len(dims), Workspace(rows.sparkSession, "sharding")
    texts = [d for d in dims if rows.schema[d].dataType.typeName() == "string"]
    placed = rows.withColumn("hilbert", hilbert_index(space, rows, dims, bits)).drop(*texts).withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    # at most 2**12 cells * 16 salts = 65,536 rows of 24 bytes, whatever the input
    counts = placed.groupBy("hilbert", "_salt").agg(F.count("*").alias("_n"))
    order = W.orderBy("hilbert", "_salt")
    bases = counts.select("hilbert", "_salt", (F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_base"), F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_all"))
    ranked = placed.withColumn("_rank", F.row_number().over(W.partitionBy("hilbert", "_salt").orderBy(*tie)) - 1).join(F.broadcast(bases), ["hilbert", "_salt"])
    rank = (F.col("_rank") + F.col("_base")).cast("long")
    ranked = ranked.withColumn("_rank", rank).withColumn("shard", F.expr(f"cast((_rank * {shards}) div _all as int)"))
    return ranked.withColumn("slot", F.expr(f"_rank - (shard * _all + {shards - 1}) div {shards}")).drop("_rank", "_base", "_all", "_salt")


def document_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, hilbert, shard, slot); no text is shuffled."""
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
    )
    return hilbert_shards(rows, ["lang", "source", "size"], shards, "doc_id", ["doc_id", "text_crc32", "size"])


def write_shards(docs: DataFrame, placed: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id") -> None:
    """The documents as one folder a shard, each file sorted along the curve. Ids must be unique."""
    joined = docs.join(placed.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    joined.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    out = document_shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
