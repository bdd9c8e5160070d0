"""Packing by order-preserving dynamic programming.

The documents of a partition form one stream of ids in their order. Windows of at most `size` ids are cut at document
ends, sentence ends or, where neither comes for a while, inside a sentence. The cuts minimise padding plus a penalty for
each truncation: best(j) = penalty(j) + min over i of best(i) + padding(i, j), where padding is linear in i, so a monotone
queue gives the minimum in constant time; windows that are full at a power of two are a few extra transitions. The stream
is handled in blocks of bounded size; the last windows of a block are decided again with the next. No shuffle: a partition
is one task, recomputed alike if its executor is lost.

Defined results: a null or empty text has the end id alone; a null document id is passed through; repeated rows are packed
as often as they come; an empty table gives an empty result; columns that are not named are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.tokens import encoder, tokenizer_path
from spanweave.session import ship_package

DOCUMENT, SENTENCE, INSIDE = 0.0, 8.0, 64.0
#: Candidates are never farther apart than this.
STRIDE = 64
BLOCK = 1 << 19
#: Windows at a block's end that are decided again with the next block.
LOOKBACK = 8
SCHEMA = "doc_id bigint, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def candidates(ends: np.ndarray, sentences: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions from 0 to total, ascending, and their penalties."""
    penalty = np.full(total + 1, np.inf)
    penalty[sentences] = SENTENCE
    penalty[ends] = DOCUMENT
    penalty[0] = 0
    at = np.flatnonzero(np.isfinite(penalty))
    gaps = np.diff(np.append(at, total))
    for p, gap in zip(at[gaps > STRIDE], gaps[gaps > STRIDE], strict=True):
        inner = np.arange(p + STRIDE, p + gap, STRIDE)
        penalty[inner] = INSIDE
    if not np.isfinite(penalty[total]):
        penalty[total] = INSIDE
    at = np.flatnonzero(np.isfinite(penalty))
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """The positions, from the first to the last candidate, at which the windows of least cost meet."""
    full = []
    p = size // 2
    while p >= max(size // 8, 1):
        i = np.searchsorted(at, at - p)
        full.append(np.where(at[np.minimum(i, len(at) - 1)] == at - p, i, -1))
        p //= 2
    extra = {int(j): [int(f[j]) for f in full if f[j] >= 0] for j in np.flatnonzero(np.max(full, axis=0) >= 0)} if full else {}
    pos, pen, best, back = at.tolist(), penalty.tolist(), [0.0], [0]
    queue: deque[tuple[float, int]] = deque([(float(pos[0]), 0)])
    for j in range(1, len(pos)):
        here = pos[j]
        low = here - size
        while pos[queue[0][1]] < low:
            queue.popleft()
        cost, i = queue[0]
        cost += size - here
        for k in extra.get(j, ()):
            if best[k] < cost:
                cost, i = best[k], k
        cost += pen[j]
        best.append(cost)
        back.append(i)
        cost += here
        while queue and queue[-1][0] >= cost:
            queue.pop()
        queue.append((cost, j))
    cuts, j = [pos[-1]], len(pos) - 1
    while j:
        j = back[j]
        cuts.append(pos[j])
    return cuts[::-1]


class Packer:
    """Takes documents in order, gives pieces block by block."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.sequence = size, first_sequence
        self.docs: list[tuple] = []  # (doc_id, ids left to place, ids before them, all ids, sentence ends among those left)
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray, sentences: np.ndarray) -> Iterator[dict]:
        self.docs.append((doc_id, ids, 0, len(ids), sentences))
        self.held += len(ids)
        if self.held >= BLOCK + LOOKBACK * self.size:
            yield self._cut(False)

    def close(self) -> Iterator[dict]:
        if self.docs:
            yield self._cut(True)

    def _cut(self, last: bool) -> dict:
        ends = np.cumsum([len(d[1]) for d in self.docs])
        begins = ends - [len(d[1]) for d in self.docs]
        stream = np.concatenate([d[1] for d in self.docs])
        sentences = np.concatenate([d[4] + b for d, b in zip(self.docs, begins, strict=True)]).astype(np.int64)
        cuts = best_cuts(*candidates(ends, sentences, len(stream)), self.size)
        if not last:
            cuts = cuts[:-LOOKBACK]
        done = cuts[-1]
        breaks = np.union1d(cuts, ends[ends < done])
        starts, stops = breaks[:-1], breaks[1:]
        doc = np.searchsorted(ends, starts, "right")
        window = np.searchsorted(cuts, starts, "right") - 1
        cut = np.asarray(cuts)
        raw = np.ascontiguousarray(stream, dtype="<u4")
        out = {
            "doc_id": [self.docs[i][0] for i in doc],
            "start": [int(s - begins[i]) + self.docs[i][2] for s, i in zip(starts, doc, strict=True)],
            "ids": [raw[a:b].tobytes() for a, b in zip(starts, stops, strict=True)],
            "doc_tokens": [self.docs[i][3] for i in doc],
            "sequence_id": (self.sequence + window).tolist(),
            "offset": (starts - cut[window]).tolist(),
        }
        self.sequence += len(cuts) - 1
        rest = []
        for d, a, b in zip(self.docs, begins, ends, strict=True):
            if b > done:
                gone = max(0, int(done - a))
                rest.append((d[0], d[1][gone:], d[2] + gone, d[3], d[4][d[4] > gone] - gone))
        self.docs, self.held = rest, len(stream) - done
        return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, size: int = 2048) -> DataFrame:
    """One row a piece, ids as little-endian unsigned 32-bit integers."""
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    path = tokenizer or tokenizer_path()
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    types = [("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_slices
        packer = Packer(size, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], np.uint32)

        def made(blocks: Iterator[dict]) -> Iterator[pa.RecordBatch]:
            for block in blocks:
                yield pa.RecordBatch.from_arrays([pa.array(block[n], t) for n, t in types], [n for n, _ in types])

        for batch in batches:
            names = iter(batch.column("doc_id").to_pylist())
            for ids, bounds, sentences in encode(batch.column("text")):
                inside = np.searchsorted(sentences, bounds, "right")
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    yield from made(packer.add(next(names), np.concatenate([ids[a:b], end]), sentences[inside[k] : inside[k + 1]] - a))
        yield from made(packer.close())

    return kept.mapInArrow(run, SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
