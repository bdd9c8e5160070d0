"""Token counts by separator scan of flat, unindexed token files.

A token file is nothing but ids, document after document, each closed by the end-of-document id. Files are read in blocks
that start and stop anywhere. Each block is searched by vector comparison and summarised as (separators, ids before the
first, ids after the last, lengths between); a prefix scan over the summaries, first within groups of blocks and then over
the groups, gives every block the number of documents closed before it and the ids of the document open at its start.

Defined results: a null or empty text counts 0; a null id is passed through; repeated rows are counted each; an empty
table gives an empty result; ids after a file's last separator are one unfinished document (closed = false); empty
documents count 0; very long texts are encoded whole, in slices; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanweave.llm.support import Workspace
from spanweave.llm.tokens import encoder, tokenizer_path
from spanweave.session import ship_package

END_OF_DOCUMENT = 49407  # <|endoftext|> of word_bpe_49k.json; its string in a text is encoded as ordinary text
BLOCK_IDS = 1 << 16
GROUP_BLOCKS = 256
DTYPE = "<u2"  # of word_bpe_49k.json: the vocabulary has under 65,536 ids


def id_type(tokenizer: str, eod: int) -> str:
    """The narrowest of two types that holds every id of the tokenizer and the end of a document."""
    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(True) - 1, eod) < 1 << 16 else "<u4"


def write_token_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, eod: int = END_OF_DOCUMENT, block_ids: int = BLOCK_IDS) -> DataFrame:
    """A partition becomes one flat file of ids of id_type(), given as blocks (file, block, data), and rows (file, first, docs) that list
    which documents went into it in order."""
    path = tokenizer or tokenizer_path()
    dtype = id_type(path, eod)
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = encoder(path, True).encode_slices, TaskContext.get().partitionId()
        held, size, block, count = [], 0, 0, 0
        end = np.array([eod], np.uint32)

        def row(block: int | None, data: bytes | None, first: int | None, listed: pa.Array | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int64()), "block": pa.array([block], pa.int64()), "data": pa.array([data], pa.binary()), "first": pa.array([first], pa.int64()), "docs": pa.array([listed], pa.list_(pa.int64()))})

        for batch in batches:
            yield row(None, None, count, batch.column("id").to_pylist())
            count += batch.num_rows
            for ids, bounds, _ in encode(batch.column("text")):
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    held += [ids[a:b], end]
                size += len(ids) + len(bounds) - 1
                while size >= block_ids:
                    flat = np.concatenate(held)
                    yield row(block, flat[:block_ids].astype(dtype).tobytes(), None, None)
                    held, size, block = [flat[block_ids:]], size - block_ids, block + 1
        if size:
            yield row(block, np.concatenate(held).astype(dtype).tobytes(), None, None)

    return kept.mapInArrow(run, "file bigint, block bigint, data binary, first bigint, docs array<bigint>")


def read_token_files(spark: SparkSession, path: str, block_bytes: int = 1 << 20) -> DataFrame:
    """Blocks (file, block, data) of binary token files by any path Spark reads; one file at a time is in a worker's memory."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file"), batch.column("content"), strict=True):
                data = content.as_buffer()
                for block, at in enumerate(range(0, data.size, block_bytes)):
                    yield pa.RecordBatch.from_pydict({"file": pa.array([file.as_py()], pa.int64()), "block": pa.array([block], pa.int64()), "data": pa.array([data.slice(at, min(block_bytes, data.size - at)).to_pybytes()], pa.binary())})

    return files.mapInArrow(run, "file bigint, block bigint, data binary")


def scan_blocks(blocks: DataFrame, eod: int, dtype: str = DTYPE) -> DataFrame:
    """(file, block, seps, head, tail, inner) of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {"seps": [], "head": [], "tail": [], "inner": []}
            for data in batch.column("data"):
                ids = np.frombuffer(data.as_buffer(), dtype)
                at = np.flatnonzero(ids == eod)
                found["seps"].append(len(at))
                found["head"].append(int(at[0]) if len(at) else 0)
                found["tail"].append(len(ids) - int(at[-1]) - 1 if len(at) else len(ids))
                found["inner"].append(np.diff(at) - 1)
            yield pa.RecordBatch.from_pydict({"file": batch.column("file"), "block": batch.column("block"), **{k: pa.array(found[k], pa.int64()) for k in ("seps", "head", "tail")}, "inner": pa.array(found["inner"], pa.list_(pa.int64()))})

    return blocks.select("file", "block", "data").mapInArrow(run, "file bigint, block bigint, seps bigint, head bigint, tail bigint, inner array<bigint>")


def _scan(df: DataFrame, keys: list[str], order: str, seps: str, tail: str, out: str) -> DataFrame:
    """Exclusive prefix scan: {out}_base separators before the row, {out}_carry ids since the last of them, {out}_seen if any."""
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_sum", F.coalesce(F.sum(tail).over(before), F.lit(0))).withColumn(f"{out}_base", F.coalesce(F.sum(seps).over(before), F.lit(0)))
    last = F.max(F.when(F.col(seps) > 0, F.col("_sum"))).over(before)
    return df.withColumn(f"{out}_carry", F.col("_sum") - F.coalesce(last, F.lit(0))).withColumn(f"{out}_seen", last.isNotNull()).drop("_sum")


def count_tokens(blocks: DataFrame, eod: int = END_OF_DOCUMENT, dtype: str = DTYPE) -> DataFrame:
    """(file, ordinal, n_tokens, closed) of every document in the files."""
    found = scan_blocks(blocks, eod, dtype).withColumn("part", F.floor(F.col("block") / GROUP_BLOCKS))
    local = _scan(found, ["file", "part"], "block", "seps", "tail", "l")
    groups = local.groupBy("file", "part").agg(
        F.sum("seps").alias("seps"),
        F.max_by(F.col("tail") + F.when(F.col("seps") > 0, 0).otherwise(F.col("l_carry")), "block").alias("tail"),
    )
    groups = _scan(groups, ["file"], "part", "seps", "tail", "g").select("file", "part", "g_base", "g_carry", F.lead("part").over(W.partitionBy("file").orderBy("part")).isNull().alias("g_last"))
    placed = local.join(groups, ["file", "part"])
    placed = placed.withColumn("carry", F.col("l_carry") + F.when(F.col("l_seen"), 0).otherwise(F.col("g_carry"))).withColumn("base", F.col("l_base") + F.col("g_base"))
    closed = placed.where("seps > 0").select("file", "base", F.posexplode(F.concat(F.array(F.col("carry") + F.col("head")), "inner")).alias("k", "n_tokens"))
    ends = placed.where("g_last").groupBy("file").agg(F.max_by(F.struct((F.col("base") + F.col("seps")).alias("ordinal"), (F.col("tail") + F.when(F.col("seps") > 0, 0).otherwise(F.col("carry"))).alias("n_tokens")), "block").alias("open"))
    unfinished = ends.where("open.n_tokens > 0").select("file", "open.ordinal", "open.n_tokens", F.lit(False).alias("closed"))
    return closed.select("file", (F.col("base") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed")).unionByName(unfinished)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    space = Workspace(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    written = space.write(write_token_blocks(docs), "files")
    counts = space.write(count_tokens(written.where("block is not null"), END_OF_DOCUMENT, id_type(tokenizer_path(), END_OF_DOCUMENT)), "counts")
    listed = written.where("docs is not null").select("file", "first", F.posexplode("docs").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return listed.join(counts.where("closed"), ["file", "ordinal"]).select("doc_id", "n_tokens")
