"""Comparisons of samples and of sentences: Wasserstein distance, distance correlation, ROUGE-L homogenisation, and the share of direct speech."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.operators.matching import tokens
from spanweave.session import ship_package


def wasserstein(u: np.ndarray, v: np.ndarray) -> float:
    """The area between the cumulative distributions of two samples of any sizes: a merge of the sorted values. NaN if one is empty."""
    if not len(u) or not len(v):
        return float("nan")
    u, v = np.sort(u), np.sort(v)
    both = np.sort(np.concatenate([u, v]))
    at = both[:-1]
    share = lambda s: np.searchsorted(s, at, "right") / len(s)
    return float((np.abs(share(u) - share(v)) * np.diff(both)).sum())


def _below(x: np.ndarray, y: np.ndarray) -> float:
    """The sum of (x[i] - x[j]) (y[i] - y[j]) over j < i with y[j] <= y[i], by halves: at each size of block, the rows of right halves meet the
    sums of the left halves' rows up to their own y."""
    n = len(x)
    by_y = np.argsort(y, kind="stable")
    total, size = 0.0, 1
    while size < n:
        block = by_y // (2 * size)
        order = by_y[np.argsort(block, kind="stable")]
        left = order // size % 2 == 0
        columns = np.where(left, np.stack([np.ones(n), x[order], y[order], x[order] * y[order]]), 0.0)
        sums = np.cumsum(columns, axis=1)
        starts = np.flatnonzero(np.append(True, np.diff(order // (2 * size)) > 0))
        before = np.repeat(sums[:, starts] - columns[:, starts], np.diff(np.append(starts, n)), axis=1)
        c, sx, sy, sxy = (sums - before)[:, ~left]
        xi, yi = x[order][~left], y[order][~left]
        total += float((xi * yi * c - xi * sy - yi * sx + sxy).sum())
        size *= 2
    return total


def _row_sums(x: np.ndarray) -> np.ndarray:
    """The sum of |x[i] - x[j]| over j, for each i."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    before = np.concatenate([[0.0], np.cumsum(s)[:-1]])
    i = np.arange(len(x))
    out = np.empty(len(x))
    out[order] = s * (2 * i - len(x)) + s.sum() - 2 * before
    return out


def _covariance(x: np.ndarray, y: np.ndarray) -> float:
    """Squared distance covariance (V-statistic) without the matrices of distances: rank sums in n log^2 n."""
    n = len(x)
    order = np.lexsort((y, x))
    p, q = x[order], y[order]
    whole = n * float(p @ q) - float(p.sum() * q.sum())  # over j < i of (x[i] - x[j]) (y[i] - y[j])
    both = 2 * (2 * _below(p, q) - whole)
    a, b = _row_sums(x), _row_sums(y)
    return both / n**2 - 2 * float(a @ b) / n**3 + float(a.sum() * b.sum()) / n**4


def distance_correlation(u: np.ndarray, v: np.ndarray) -> float:
    """Of two samples of one length; 0 if one is constant, NaN if they are empty or of different lengths."""
    if not len(u) or len(u) != len(v):
        return float("nan")
    # the same for any offset and scale, and better kept from rounding
    x, y = ((np.asarray(s, np.float64) - np.mean(s)) / (np.std(s) or 1.0) for s in (u, v))
    spread = _covariance(x, x) * _covariance(y, y)
    return float(np.sqrt(max(_covariance(x, y), 0.0) / np.sqrt(spread))) if spread > 1e-20 else 0.0


def compared(pairs: DataFrame, left: str, right: str, measures: dict[str, Callable[[np.ndarray, np.ndarray], float]] | None = None) -> DataFrame:
    """pairs' columns but for the two arrays, and a double for each measure; null where an array is null or the measure has no value."""
    ship_package(pairs.sparkSession)
    measures = measures or {"wasserstein": wasserstein, "distance_correlation": distance_correlation}
    others = [f for f in pairs.schema if f.name not in (left, right)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = list(zip(batch.column(left).to_pylist(), batch.column(right).to_pylist(), strict=True))
            values = [[None if a is None or b is None else f(np.array(a, np.float64), np.array(b, np.float64)) for a, b in both] for f in measures.values()]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in others], *[pa.array(v, pa.float64(), from_pandas=True) for v in values]], [*[f.name for f in others], *measures])

    return pairs.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], *[f"{m} double" for m in measures]]))


def common_length(a: list[int], b: list[int]) -> int:
    """Of the longest common subsequence, bit-parallel over the words of a."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & masks.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


#: Sentences of a block: a task compares two blocks.
SENTENCES = 256


def homogenisation(sentences: DataFrame, block: int = SENTENCES) -> DataFrame:
    """(doc_id, homogenisation, pairs) of sentences (doc_id, pos, piece): the mean ROUGE-L F-measure of all pairs of a document's sentences, twice the longest
    common subsequence over both lengths in words; 0 where neither has a word; null without a pair. All pairs are compared, block with
    block, so a document is many tasks."""
    ship_package(sentences.sparkSession)
    rows = sentences.select("doc_id", F.col("pos").cast("long").alias("pos"), F.transform(tokens(F.col("piece")), lambda w: F.xxhash64(w)).alias("words")).withColumn("b", F.floor(F.col("pos") / block))
    most = rows.groupBy("doc_id").agg(F.max("b").alias("most"))
    # block b meets itself and every other one once: as the first of (b, k >= b) and as the second of (k <= b, b)
    spread = rows.join(most, "doc_id").select("doc_id", "pos", "words", "b", F.explode(F.sequence(F.lit(0).cast("long"), "most")).alias("other"))
    dealt = spread.select("doc_id", F.least("b", "other").alias("x"), F.greatest("b", "other").alias("y"), "b", "pos", "words")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        pdf = pdf.sort_values("pos")
        first, second = ([list(w) for w in pdf.loc[pdf["b"] == k, "words"]] for k in (x, y))
        total, n = 0.0, 0
        for i, a in enumerate(first):
            for b in second[i + 1 :] if x == y else second:
                n += 1
                if a and b:
                    total += 2 * common_length(a, b) / (len(a) + len(b))
        return pd.DataFrame([[pdf["doc_id"].iloc[0], total, n]], columns=["doc_id", "total", "n"])

    found = dealt.groupBy("doc_id", "x", "y").applyInPandas(run, f"doc_id {dict(sentences.dtypes)['doc_id']}, total double, n bigint")
    return found.groupBy("doc_id").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("homogenisation"), F.sum("n").alias("pairs"))


#: Quotation marks that open, with those that close them. A mark that may do either closes what it can.
QUOTES = {"“": "”", "„": "“”", "»": "«", "«": "»", "‘": "’", "‚": "‘’", "‹": "›", "›": "‹", '"': '"'}
_MARK = re.compile("[" + "".join(sorted(set(QUOTES) | set("".join(QUOTES.values())))) + r"]|\n")


def quoted(text: str) -> list[tuple[int, int]]:
    """[begin, end) of the outermost quotations, without their marks. Marks may be nested; one that is never closed ends with its paragraph; one that closes
    nothing is passed over, and so is an apostrophe between letters."""
    held: list[tuple[str, int]] = []
    out = []
    for m in _MARK.finditer(text):
        c, at = m[0], m.start()
        if c == "\n":
            if held:
                out.append((held[0][1], at))
                held = []
            continue
        if c in "’‘" and 0 < at < len(text) - 1 and text[at - 1].isalnum() and text[at + 1].isalnum():
            continue
        closes = next((k for k in range(len(held) - 1, -1, -1) if c in QUOTES[held[k][0]]), None)
        if closes is not None:
            if closes == 0:
                out.append((held[0][1], at))
            held = held[:closes]
        elif c in QUOTES:
            held.append((c, at + 1))
    if held:
        out.append((held[0][1], len(text)))
    return out


def direct_speech(docs: DataFrame) -> DataFrame:
    """(doc_id, words, quoted_words, directspeech_ratio) of docs (doc_id, text): the share of words inside quotations; null without a word."""
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    word = re.compile(r"\w+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_of, inside = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                all_of.append(sum(1 for _ in word.finditer(text)))
                inside.append(sum(1 for a, b in quoted(text) for _ in word.finditer(text, a, b)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(all_of, pa.int64()), pa.array(inside, pa.int64())], ["doc_id", "words", "quoted_words"])

    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, words bigint, quoted_words bigint")
    return found.withColumn("directspeech_ratio", F.col("quoted_words") / F.nullif("words", F.lit(0)))
