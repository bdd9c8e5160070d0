"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document, once for junk and once for toxicity. Expectation
maximisation over the counts of vote patterns (at most 3**7 rows, over all documents) estimates each labeller's accuracy
on either class and gives every pattern a posterior. Posterior labels of a bounded sample of documents train two hashed linear scorers,
whose features are rates of words and word prefixes and buckets of document measures; the scorers judge every whole text.

The toxicity labellers look words up in lexicons that are read off a bounded sample of labelled documents, by
document frequency in either class; without labels the lexicons are empty and nothing is judged toxic.

Bounds, which are parameters: LABELLED documents for the lexicons and TRAINED for the scorers, those whose hashed ids come first,
and at most 2**DIM_BITS features; only hashed features of the latter and the lexicons' entries reach the driver.

Defined results: a null or empty text has no words and is judged by its measures alone; a null id is passed through (and
never sampled); repeated rows are judged each; very long texts are measured whole; an empty table gives an empty result; other columns are passed through, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.llm.support import Rows, Workspace, hashed_sample, spare_name, tidied
from spanweave.session import ship_package

DIM_BITS = 18
DIM = 1 << DIM_BITS
LABELLED, TRAINED = 4000, 2000
PREFIXES = (5, 7)
RATE = 20.0
#: A lexicon's entry lies in this share of the sample's toxic documents.
LEXICON_SHARE = 0.015
#: A feature of the scorers lies in this share of the sample.
LEAST_SHARE = 0.004
KEEP_BELOW = 0.6
CACHE_WORDS = 250_000
MEASURES = 11  # buckets of doc measures take the first MEASURES * 16 features
TOXIC_LABELLERS, JUNK_LABELLERS = ("word", "short_prefix", "long_prefix"), ("symbols", "few_words_over", "phrases_over", "shouting", "no_letters", "listing", "symbol_words")
#: (bad from, good up to) of each junk measure, in the order of JUNK_LABELLERS.
JUNK_CUTS = ((0.25, 0.02), (0.65, 0.55), (0.25, 0.05), (0.5, 0.1), (0.2, 0.05), (0.5, 0.1), (0.2, 0.02))
TOXIC_CUTS = ((0.008, 0.003), (0.012, 0.006), (0.012, 0.006))
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_PUNCT = ".,;:!?\"'()[]{}«»„“”…*#$%&|<>-"


def cores(found: list[str]) -> list[str]:
    """Lower-cased words without punctuation at either end."""
    return [w.lower().strip(_PUNCT) for w in found]


def word_features(core: list[str]) -> np.ndarray:
    """32-bit hashes of each word and of its prefixes of PREFIXES letters; -1 where it is too short."""
    h = [[crc32(b"w" + c.encode()) if c else -1 for c in core]]
    h += [[crc32(b"%d" % n + c[:n].encode()) if len(c) >= n else -1 for c in core] for n in PREFIXES]
    return np.array(h, np.int64).T


def slots(hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes among the scorers' features, after those of the measures."""
    return MEASURES * 16 + hashes % (DIM - MEASURES * 16)


class _Table(dict):
    """Codes of words, and attributes of each code."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code


@dataclass
class Model:
    lexicon: list[frozenset[str]] = field(default_factory=lambda: [frozenset()] * 3)
    weights: np.ndarray | None = None  # (2, DIM): junk, toxic
    bias: tuple[float, float] = (0.0, 0.0)


class Measurer:
    """Whole texts to measures; per word it remembers what depends on the word alone."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.table = _Table()
        self.attrs = Rows(np.float32, 11)
        self.features = Rows(np.int64, 1 + len(PREFIXES))
        self.marks = Rows(np.uint64)

    def _learn(self, keep: bool) -> None:
        new, self.table.new = self.table.new, []
        attrs = np.zeros((len(new), 11), np.float32)
        attrs[:, 0] = np.fromiter(map(len, new), np.int64, len(new))
        for i, w in enumerate(new):
            if not w.isalpha() and not w[:-1].isalpha():
                attrs[i, 1] = sum(map(w.count, "#*$%&|<>"))
                attrs[i, 3] = not any(map(str.isalpha, w))
                attrs[i, 4] = w in ("|", "-", "*", "•") or w[-1] == "|"
        attrs[:, 2] = [len(w) > 1 and w.isupper() for w in new]
        attrs[:, 10] = attrs[:, 1] > 0
        core = cores(new)
        for k, (n, lexicon) in enumerate(zip((None, *PREFIXES), self.model.lexicon, strict=True)):
            if lexicon:
                attrs[:, 5 + k] = [c[:n] in lexicon for c in core]
        if keep or self.model.weights is not None:
            hashes = word_features(core)
            if self.model.weights is not None:
                attrs[:, 8:10] = np.where(hashes >= 0, self.model.weights[:, slots(hashes)], 0).sum(axis=2).T
            if keep:
                self.features.append(hashes)
        self.attrs.append(attrs)
        self.marks.append(np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new)))

    def measure(self, text: str | None, keep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(junk measures, toxic rates, sums of the scorers' word weights); with keep, self.last has the document's codes."""
        if len(self.table) > CACHE_WORDS:
            self._clear()
        found = text.split() if text else []
        n = len(found)
        codes = np.fromiter(map(self.table.__getitem__, found), np.int64, n)
        if self.table.new:
            self._learn(keep)
        self.last = codes
        if not n:
            return np.zeros(8), np.zeros(3), np.zeros(2)
        rates = self.attrs[codes].sum(axis=0, dtype=np.float64) / n
        # of the words themselves, so that they are the same whatever was read before
        marks = self.marks[codes]
        mixed = marks[:-3] + marks[1:-2] * _ODD[0] + marks[2:-1] * _ODD[1] + marks[3:] * _ODD[2] if n > 3 else marks[:0]
        phrases = 1 - len(np.unique(mixed)) / len(mixed) if len(mixed) else 0.0
        # of n words of a natural text about n**0.85 are distinct; what is missing is said over and over
        over = 1 - len(np.unique(codes)) / n if n >= 12 else 0.0
        return np.array([rates[1], over, phrases, rates[2], rates[3], rates[4], rates[10], rates[0]]), rates[5:8], rates[8:10] * RATE


_EDGES = np.array([1e-9, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
_LENGTHS = np.array([1, 2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 9, 12, 20.0])


_RATES = np.array([1e-9, 0.001, 0.002, 0.003, 0.004, 0.006, 0.008, 0.01, 0.012, 0.014, 0.017, 0.02, 0.03, 0.05, 0.1])


def bucket_features(measures: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Features of the measures' buckets."""
    at = np.concatenate([np.searchsorted(_EDGES, measures[:7], "right"), np.searchsorted(_LENGTHS, measures[7:], "right"), np.searchsorted(_RATES, toxic, "right")])
    return np.arange(MEASURES) * 16 + at


def votes(measures: np.ndarray, toxic: np.ndarray) -> tuple[list[int], list[int]]:
    """1 bad, 0 good, -1 no vote."""

    def vote(x: float, cuts: tuple[float, float]) -> int:
        return 1 if x >= cuts[0] else 0 if x <= cuts[1] else -1

    return [vote(x, c) for x, c in zip(measures, JUNK_CUTS, strict=False)], [vote(x, c) for x, c in zip(toxic, TOXIC_CUTS, strict=True)]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of class bad for each pattern, and the labellers' confusion tables (class, labeller, vote no/good/bad).

    The start takes any bad vote as a sign of class bad, so the classes can't be swapped. A labeller may know few of the
    bad documents: its good vote then says little, as its table comes to show.
    """
    outcome = np.stack([patterns == v for v in (-1, 0, 1)]).astype(float)
    post = np.where((patterns == 1).any(1), 0.9, 0.02)
    for _ in range(rounds):
        share = np.stack([1 - post, post]) * counts
        prior = np.clip(share[1].sum() / counts.sum(), 0.001, 0.5)
        table = np.einsum("cp,vpl->clv", share, outcome) + 0.3
        table /= table.sum(axis=2, keepdims=True)
        logs = np.log(table)
        logit = np.log(prior / (1 - prior)) + np.einsum("lv,vpl->p", logs[1] - logs[0], outcome)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, table


def fit_linear(starts: np.ndarray, ids: np.ndarray, values: np.ndarray, target: np.ndarray, rounds: int = 120, rate: float = 0.3, shrink: float = 5e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Adagrad over the whole sample; the classes weigh the same.

    Features of under LEAST_SHARE of the sample are left at zero: they tell nothing of other documents.
    """
    rows = np.repeat(np.arange(len(target)), np.diff(np.append(starts, len(ids))))
    often = np.bincount(ids, minlength=DIM)[ids] >= max(3, LEAST_SHARE * len(target))
    rows, ids, values = rows[often], ids[often], values[often]
    used, ids = np.unique(ids, return_inverse=True)
    weight = target / max(target.sum(), 1) + (1 - target) / max((1 - target).sum(), 1)
    w, seen, bias, seen_b = np.zeros(len(used)), np.full(len(used), 1e-12), 0.0, 1e-12
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, values * w[ids], len(target)) + bias, -30, 30)))
        off = (p - target) * weight
        grad = np.bincount(ids, values * off[rows], len(used)) + shrink * w
        seen += grad**2
        w -= rate * grad / np.sqrt(seen)
        g = off.sum()
        seen_b += g * g
        bias -= rate * g / np.sqrt(seen_b)
    out = np.zeros(DIM)
    out[used] = w
    return out, float(bias)


def _sample_features(docs: DataFrame, model: Model) -> DataFrame:
    """(id, votes, features, values) of the documents, features hashed: at most DIM a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Measurer(model)
        for batch in batches:
            out = {"junk": [], "toxic": [], "features": [], "values": []}
            for text in batch.column("text"):
                measures, rates, _ = m.measure(text.as_py(), True)
                flat = m.features[m.last].ravel()
                found, times = np.unique(slots(flat[flat >= 0]), return_counts=True)
                buckets = bucket_features(measures, rates)
                j, t = votes(measures, rates)
                out["junk"].append(j)
                out["toxic"].append(t)
                out["features"].append(np.concatenate([buckets, found]).astype(np.int32))
                out["values"].append(np.concatenate([np.ones(len(buckets)), times * (RATE / max(len(m.last), 1))]).astype(np.float32))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "junk": pa.array(out["junk"], pa.list_(pa.int32())), "toxic": pa.array(out["toxic"], pa.list_(pa.int32())), "features": pa.array(out["features"], pa.list_(pa.int32())), "values": pa.array(out["values"], pa.list_(pa.float32()))})

    return docs.mapInArrow(lambda batches: tidied(run(batches)), "id bigint, junk array<int>, toxic array<int>, features array<int>, values array<float>")


def learn_lexicons(texts: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> list[frozenset[str]]:
    """Words, short and long prefixes that mark toxic documents, from at most `labelled` labelled documents."""
    toxic = labels.where("toxic is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("is_toxic")).dropDuplicates(["id"])
    chosen = F.broadcast(hashed_sample(toxic, labelled, 9).join(toxic, "id"))  # at most that many rows of 12 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column("is_toxic").to_pylist(), batch.column("text"), strict=True):
                found = (text.as_py() or "").split()
                core = cores(found)
                counts = Counter((0, c) for c in core if c)
                for k, n in enumerate(PREFIXES, 1):
                    counts.update((k, c[:n]) for c in core if len(c) >= n)
                yield pa.RecordBatch.from_pydict({"is_toxic": pa.array([label] * len(counts), pa.int32()), "kind": pa.array([k for k, _ in counts], pa.int32()), "mark": pa.array([c for _, c in counts], pa.string()), "rate": pa.array([x / len(found) for x in counts.values()], pa.float64())})

    rates = texts.join(chosen, "id").select("is_toxic", "text").mapInArrow(run, "is_toxic int, kind int, mark string, rate double")
    found = rates.groupBy("kind", "mark").agg(
        F.count_if(F.col("is_toxic") == 1).alias("bad"),
        F.sum(F.when(F.col("is_toxic") == 1, F.col("rate")).otherwise(0)).alias("bad_rate"),
        F.sum(F.when(F.col("is_toxic") == 0, F.col("rate")).otherwise(0)).alias("good_rate"),
    )
    n = {r["is_toxic"]: r["count"] for r in texts.join(chosen, "id").groupBy("is_toxic").count().collect()}
    if not (n.get(1) and n.get(0)):
        return [frozenset()] * 3
    # marks: in LEXICON_SHARE of the toxic documents, so at most some thousands of features
    marks = found.where((F.col("bad") >= max(3, LEXICON_SHARE * n[1])) & (F.col("bad_rate") / n[1] > 12 * (F.col("good_rate") + 0.002) / n[0])).select("kind", "mark").collect()
    return [frozenset(r["mark"] for r in marks if r["kind"] == k) for k in range(3)]


def fit(spark: SparkSession, texts: DataFrame, labels: DataFrame, labelled: int = LABELLED, trained: int = TRAINED) -> tuple[Model, dict]:
    """texts: (id, text). The model, and the labellers' estimated accuracies."""
    model = Model(learn_lexicons(texts, labels, labelled))
    space = Workspace(spark, "weak")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Measurer(model)
        for batch in batches:
            found = [votes(*m.measure(text.as_py())[:2]) for text in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"junk": pa.array([j for j, _ in found], pa.list_(pa.int32())), "toxic": pa.array([t for _, t in found], pa.list_(pa.int32()))})

    cast = texts.select("text").mapInArrow(lambda batches: tidied(run(batches)), "junk array<int>, toxic array<int>").groupBy("junk", "toxic").count()
    patterns = cast.collect()  # at most 3**10 rows
    accuracies, post = {}, {}
    for head, labellers in (("junk", JUNK_LABELLERS), ("toxic", TOXIC_LABELLERS)):
        table: dict[tuple, int] = {}
        for r in patterns:
            table[tuple(r[head])] = table.get(tuple(r[head]), 0) + r["count"]
        if table:
            p, a = expectation_maximisation(np.array(list(table)), np.array(list(table.values()), float))
            post[head] = dict(zip(table, p, strict=True))
            accuracies[head] = {k: (float(a[0, i, 1]), float(a[1, i, 2])) for i, k in enumerate(labellers)}
    chosen = F.broadcast(hashed_sample(texts.select("id"), trained, 9))  # at most that many rows of 8 bytes
    sample = space.write(_sample_features(texts.join(chosen, "id").select("id", "text"), model), "sample").orderBy("id").toArrow()
    model.weights = np.zeros((2, DIM), np.float32)
    if len(sample):
        ids, values = (np.concatenate([c.flatten().to_numpy() for c in sample[name].chunks]) for name in ("features", "values"))
        starts = np.cumsum(np.append(0, pc.list_value_length(sample["features"]).to_numpy()))[:-1]
        biases = []
        for k, head in enumerate(("junk", "toxic")):
            target = np.array([post[head].get(tuple(v), 0.0) for v in sample[head].to_pylist()])
            if target.max() < 0.5:
                biases.append(-10.0)
                continue
            model.weights[k], bias = fit_linear(starts, ids, values, target)
            biases.append(bias)
        model.bias = (biases[0], biases[1])
        del sample, ids, values
        pa.default_memory_pool().release_unused()
    return model, accuracies


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs plus struct `classified` (p_junk, p_toxic, kept), with underscores behind it where docs has such a column."""
    columns, spare, place = docs.columns, spare_name(docs, "classified"), docs.columns.index(text_col)
    # mapInArrow can't take a name with a dot, so columns go by number
    numbered = [f"c{i}" for i in range(len(columns))]
    docs = docs.toDF(*numbered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Measurer(model)
        for batch in batches:
            z = np.zeros((batch.num_rows, 2))
            for i, text in enumerate(batch.column(place)):
                measures, rates, sums = m.measure(text.as_py())
                z[i] = sums + model.weights[:, bucket_features(measures, rates)].sum(axis=1) + model.bias
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            found = pa.StructArray.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array((p < KEEP_BELOW).all(axis=1))], ["p_junk", "p_toxic", "kept"])
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*numbered, "classified"])

    verdict = T.StructType().add("p_junk", "double").add("p_toxic", "double").add("kept", "boolean")
    return docs.mapInArrow(lambda batches: tidied(run(batches)), T.StructType([*docs.schema.fields, T.StructField("classified", verdict)])).toDF(*columns, spare)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, trained: int = TRAINED) -> DataFrame:
    """score() by a model fitted on docs and on labels (doc_id, toxic); labelled and trained bound the documents sampled for the
    lexicons and for the scorers."""
    ship_package(spark)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    model, _ = fit(spark, texts, labels, labelled, trained)
    return score(docs, model, id_col, text_col)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(spark, docs, labels).select("doc_id", "classified.p_junk", "classified.p_toxic", "classified.kept")
