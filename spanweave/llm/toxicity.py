"""Toxicity by the nearest labelled examples.

1. A bounded sample of training documents of either label (the rows whose hashed ids come first) is read; its words are counted by label, and
   the terms are those that chi-squared and a ratio of odds set apart, best first. Only the sample's ids are broadcast; no text is shuffled.
2. Every text is read once for the terms it holds. Document frequencies come from all documents, and vectors are (1 + ln tf) * idf,
   scaled to length one, so that the dot product is the TF-IDF cosine over the terms.
3. The first of the sample are the examples. Their vectors lie in an inverted index whose postings
   are cut into blocks of examples, with each term's largest weight in each block. A query's bound for a block is the sum of its weights
   times those maxima. Blocks are scored exactly from the largest bound down, until the next bound is below the K-th best cosine:
   the K nearest are exact.
4. Neighbours vote by cosine ** SHARPNESS, weighed back to the labels' shares among training documents, against a prior worth PRIOR votes; a
   logistic curve fitted to the examples' own votes, each left out of its own neighbours, turns the vote into a probability.

The nearest examples and their cosines are given as evidence. Neither language, source nor id enters a score.

Defined results: a null or empty text, and one without any of the terms, has no neighbour and gets the calibrated prior, and no evidence; a
document with several labels is toxic if any says so, labels of no document and null labels teach nothing, a document without a label teaches
no label; ties in cosine go to the smaller example id, then to the smaller place in the sample; repeated rows are scored each; very long
texts are read whole; without a training row of either label the score is that of the other, 0 without any; an empty table gives an
empty result; further columns are not read, whatever their names. A null id counts as held out and can't carry a label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.support import Workspace, tidied, word_slices
from spanweave.session import ship_package

#: Bounds: terms; documents read for them, of either label; examples, of either label. A vector has at most TERMS entries, so the examples that
#: are sent to the workers are bounded too.
TERMS, SAMPLE, EXAMPLES = 2048, 12_000, 4000
#: A term needs this chi-squared, this ratio of odds either way, and so many training documents.
CHI_SQUARED, ODDS, LEAST_DOCS = 20.0, 3.0, 5
K, SHARPNESS, PRIOR = 15, 2.0, 1.0
#: Examples of a block.
BLOCK = 64
#: One training document in so many is held out.
FOLDS = 5
#: Words a task counts before it hands the counts on.
COUNTED = 400_000
_EDGES = re.compile(rb"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$")


def bare(words: pa.Array) -> list[bytes]:
    """Words without ASCII punctuation at their ends."""
    edge = _EDGES.sub
    return [w if w.isalnum() else edge(b"", w) for w in words.to_pylist()]


def _coded(texts: pa.Array, code) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the texts: (first text, the texts' numbers in the slice, codes, counts) of distinct (text, code) with code >= 0."""
    first = 0
    for dictionary, indices, offsets in word_slices(texts):
        codes = np.fromiter(map(code, bare(dictionary)), np.int64, len(dictionary))
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        mine = codes[indices]
        some = mine >= 0
        pairs, counts = np.unique(owner[some] << 32 | mine[some], return_counts=True)
        yield first, pairs >> 32, pairs & 0xFFFFFFFF, counts
        first += len(offsets) - 1


def term_counts(labelled: DataFrame) -> DataFrame:
    """(word, n, toxic): in how many rows of (text, toxic) a word is, and in how many toxic ones."""

    class Numbers(dict):
        def __missing__(self, word: bytes) -> int:
            n = self[word] = len(self) if word else -1
            return n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held = Numbers(), np.zeros((2, 1024), np.int64)

        def counted() -> pa.RecordBatch:
            words = [w for w, n in numbers.items() if n >= 0]
            at = np.array([numbers[w] for w in words], np.int64)
            good = np.array([_utf8(w) for w in words], bool) if words else np.zeros(0, bool)
            keep = np.flatnonzero(good)
            return pa.RecordBatch.from_arrays([pa.array([words[i].decode() for i in keep], pa.string()), pa.array(held[0][at[keep]]), pa.array(held[1][at[keep]])], ["word", "n", "toxic"])

        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            for first, rows, codes, _ in _coded(batch.column("text"), numbers.__getitem__):
                if len(numbers) > held.shape[1]:
                    held = np.pad(held, ((0, 0), (0, len(numbers))))
                held[0] += np.bincount(codes, minlength=held.shape[1])
                held[1] += np.bincount(codes, toxic[first + rows], held.shape[1]).astype(np.int64)
                if len(numbers) > COUNTED:
                    yield counted()
                    numbers.clear()
                    held[:] = 0
        yield counted()

    found = labelled.select("text", "toxic").mapInArrow(lambda b: tidied(run(b)), "word string, n bigint, toxic bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def _utf8(word: bytes) -> bool:
    try:
        word.decode()
        return True
    except UnicodeDecodeError:
        return False


def terms(counts: DataFrame, n_toxic: int, n_clean: int, most: int = TERMS) -> list[str]:
    """At most so many words, by chi-squared and then by code point."""
    a, b = F.col("toxic").cast("double"), (F.col("n") - F.col("toxic")).cast("double")
    c, d = n_toxic - a, n_clean - b
    chi = (a * d - b * c) * (a * d - b * c) * float(n_toxic + n_clean) / ((a + b) * (c + d) * float(max(n_toxic, 1)) * float(max(n_clean, 1)))
    odds = F.abs(F.log((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))))
    chosen = counts.where(F.col("n") >= LEAST_DOCS).where((F.col("n") < n_toxic + n_clean) & (odds >= float(np.log(ODDS)))).select("word", chi.alias("chi")).where(F.col("chi") >= CHI_SQUARED)
    return [r["word"] for r in chosen.orderBy(F.desc("chi"), "word").limit(most).collect()]


def vectors(texts: DataFrame, words: list[str]) -> DataFrame:
    """The columns of texts other than text, and codes array<int> and counts array<int> of the terms in the text, by code."""
    sent = texts.sparkSession.sparkContext.broadcast(words)
    others = [f for f in texts.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w.encode(): i for i, w in enumerate(sent.value)}
        for batch in batches:
            sizes, codes, counts = np.zeros(batch.num_rows, np.int64), [], []
            for first, rows, c, n in _coded(batch.column("text"), lambda w: number.get(w, -1)):
                sizes += np.bincount(first + rows, minlength=len(sizes))
                codes.append(c)
                counts.append(n)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            held = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else [], pa.int32())) for x in (codes, counts)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in others], *held], [*[f.name for f in others], "codes", "counts"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], "codes array<int>", "counts array<int>"])
    return texts.mapInArrow(lambda b: tidied(run(b)), schema)


def weighed(codes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of a vector of length one; zeros where no term weighs anything."""
    w = (1 + np.log(counts)) * idf[codes]
    length = np.sqrt((w * w).sum())
    return w / length if length else w


class BlockMaxIndex:
    """Inverted index over examples in order, with each term's largest weight in each block of BLOCK examples."""

    def __init__(self, examples: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        self.n, self.blocks = len(examples), -(-len(examples) // block)
        sizes = np.array([len(c) for c, _ in examples], np.int64)
        owner = np.repeat(np.arange(self.n), sizes)
        codes = np.concatenate([np.zeros(0, np.int64), *[c for c, _ in examples]]).astype(np.int64)
        weights = np.concatenate([np.zeros(0), *[w for _, w in examples]])
        order = np.lexsort((owner, codes))
        self.owner, self.weight = owner[order], weights[order]
        cell = codes * self.blocks + owner // block
        # the postings of a term in a block lie between two entries of one row
        self.begin = np.searchsorted(cell[order], np.arange(n_terms * self.blocks + 1)) if self.blocks else np.zeros(1, np.int64)
        self.largest = np.zeros((n_terms, self.blocks))
        np.maximum.at(self.largest.reshape(-1), cell, weights)

    def _score(self, codes: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """The cosines of all examples, exact for those of the blocks and zero for others."""
        cells = (codes[:, None] * self.blocks + blocks).ravel()
        begin, n = self.begin[cells], self.begin[cells + 1] - self.begin[cells]
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], self.weight[at] * np.repeat(np.repeat(weights, len(blocks)), n), self.n)

    def nearest(self, codes: np.ndarray, weights: np.ndarray, k: int = K, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k of largest cosine above zero, ties by example."""
        if not len(codes) or not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        bounds = weights @ self.largest[codes]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        cosines, done, step = np.zeros(self.n), 0, 4
        while done < len(order):
            some = order[done : done + step]
            cosines += self._score(codes, weights, np.sort(some))
            done += len(some)
            step *= 4
            if without >= 0:
                cosines[without] = 0
            if done < len(order) and self.n > k:
                kth = np.partition(cosines, -k)[-k]
                # bounds and cosines are sums in other orders: a hair's breadth of rounding is let through
                order = order[: done + int(np.searchsorted(-bounds[order[done:]], -kth + 1e-9, "right"))]
        found = np.flatnonzero(cosines > 0)
        if len(found) > k:
            found = found[np.lexsort((found, -cosines[found]))[:k]]
        else:
            found = found[np.lexsort((found, -cosines[found]))]
        return found, cosines[found]


@dataclass
class Judge:
    """What scoring needs; of bounded size."""

    idf: np.ndarray
    examples: list[tuple[np.ndarray, np.ndarray]]
    ids: list[int]
    toxic: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def ready(self) -> Judge:
        self.index = BlockMaxIndex(self.examples, len(self.idf))
        shares = np.array([1 - self.prior, self.prior])
        counts = np.maximum(np.bincount(self.toxic, minlength=2), 1)
        self.votes = (shares * max(len(self.toxic), 1) / counts)[self.toxic] if len(self.toxic) else np.zeros(0)
        return self

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        w = self.votes[found] * cosines**SHARPNESS
        return float((w @ self.toxic[found] + PRIOR * self.prior) / (w.sum() + PRIOR))

    def calibrate(self) -> Judge:
        """Fit slope and shift by Newton's method to the examples, each without itself; held near 1 and 0 where they tell little."""
        if not 0 < self.prior < 1 or not len(self.toxic):
            return self
        x = np.array([_logit(self.vote(*self.index.nearest(c, w, without=i))) for i, (c, w) in enumerate(self.examples)])
        theta, want, a = np.array([1.0, 0.0]), self.toxic.astype(float), np.stack([x, np.ones(len(x))], 1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
            gradient = a.T @ (self.votes * (want - p)) - (theta - [1.0, 0.0])
            theta = theta + np.linalg.solve((a * (self.votes * p * (1 - p))[:, None]).T @ a + np.eye(2), gradient)
        self.slope, self.shift = (max(float(theta[0]), 0.05), float(theta[1])) if np.isfinite(theta).all() else (1.0, 0.0)
        return self

    def score(self, codes: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(probability, nearest examples, their cosines)."""
        found, cosines = self.index.nearest(codes, weighed(codes, counts, self.idf))
        if not 0 < self.prior < 1:
            return self.prior, found, cosines
        return float(1 / (1 + np.exp(-np.clip(self.slope * _logit(self.vote(found, cosines)) + self.shift, -30, 30)))), found, cosines


def _logit(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return float(np.log(p / (1 - p)))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, toxic): one row for each labelled document that is not held out. Only ids are shuffled."""
    ids = docs.select(F.col(f"`{id_col}`").alias("id")).where("id is not null").distinct()
    given = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null")
    given = given.groupBy("id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    return given.where(~_held_out(F.col("id"))).join(ids, "id", "left_semi")


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", evidence: int = 3, space: Workspace | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, neighbours: number of examples that voted, evidence: array of the nearest (doc_id, cosine, toxic))."""
    spark = docs.sparkSession
    ship_package(spark)
    space = space or Workspace(spark, "toxicity")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = space.write(training_rows(texts, labels), "known")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    place = F.xxhash64("id", F.lit(11))

    def first(n: int) -> DataFrame:
        out = [known.where(F.col("toxic") == x).orderBy(place, "id").limit(n) for x in (0, 1)]
        return out[0].unionByName(out[1])

    # bounded by 2 * SAMPLE ids
    sample = F.broadcast(space.write(first(SAMPLE), "sample"))
    sampled = {x: min(n, SAMPLE) for x, n in ((0, n_clean), (1, n_toxic))}
    counts = term_counts(texts.join(sample, F.col("doc_id") == F.col("id")).select("text", "toxic"))
    words = terms(counts, sampled[1], sampled[0])
    held = space.write(vectors(texts, words), "vectors")
    n_docs = held.count()
    found = {r["code"]: r["count"] for r in held.select(F.explode("codes").alias("code")).groupBy("code").count().collect()}
    idf = np.log((1 + n_docs) / (1 + np.array([found.get(i, 0) for i in range(len(words))], float)))
    chosen = held.join(F.broadcast(first(EXAMPLES)), F.col("doc_id") == F.col("id")).groupBy("doc_id", "toxic").agg(F.min(F.struct("codes", "counts")).alias("v"))
    rows = sorted(chosen.collect(), key=lambda r: r["doc_id"])
    examples = []
    for r in rows:
        codes, n = np.array(r["v"]["codes"], np.int64), np.array(r["v"]["counts"], np.int64)
        examples.append((codes, weighed(codes, n, idf)))
    prior = n_toxic / (n_toxic + n_clean) if n_toxic + n_clean else 0.0
    judge = Judge(idf, examples, [r["doc_id"] for r in rows], np.array([r["toxic"] for r in rows], np.int64), prior).ready().calibrate()
    sent = spark.sparkContext.broadcast(Judge(judge.idf, judge.examples, judge.ids, judge.toxic, judge.prior, judge.slope, judge.shift))
    told = pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, seen = sent.value.ready(), {}
        for batch in batches:
            scores, proofs, voters = [], [], []
            for codes, counts in zip(batch.column("codes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                # copies, and the many texts of few terms, are scored once
                key = (tuple(codes), tuple(counts))
                if key not in seen:
                    if len(seen) >= 20_000:
                        seen.clear()
                    score, near, cosines = judge.score(np.array(codes, np.int64), np.array(counts, np.int64))
                    seen[key] = score, len(near), [{"doc_id": judge.ids[i], "cosine": float(c), "toxic": int(judge.toxic[i])} for i, c in zip(near[:evidence], cosines, strict=False)]
                score, n, proof = seen[key]
                scores.append(score)
                voters.append(n)
                proofs.append(proof)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(voters, pa.int64()), pa.array(proofs, pa.list_(told))], ["doc_id", "score", "neighbours", "evidence"])

    kind = held.schema["doc_id"].dataType.simpleString()
    out = held.select("doc_id", "codes", "counts").mapInArrow(lambda b: tidied(run(b)), f"doc_id {kind}, score double, neighbours bigint, evidence array<struct<doc_id: bigint, cosine: double, toxic: int>>")
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "evidence")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
