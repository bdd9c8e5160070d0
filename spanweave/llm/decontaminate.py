"""Benchmark decontamination by CGK embedding.

Texts and items are word sequences (lower-cased runs of letters, digits and marks; each letter by itself in scripts that are
written without blanks). An item leaks where a stretch of a text is within
`rate` times the item's words of it in edit distance. The search has three steps:

1. A count filter that loses nothing: a stretch within k edits of an item of n words holds n - k of its words. Items are
   put into classes of near lengths; a start is kept if enough words of the class follow it.
2. At each start kept, the CGK random walk (copy the word under the pointer, move on if the step's random function of the
   word says so) embeds an item-sized window so that edit distance becomes Hamming distance. Samples of two places of the
   embedding are looked up among the items' samples; walks and samples are repeated, WALKS * SAMPLES tables in all, for
   recall of over 0.95 at the largest distance allowed (tests measure it, from 10 to 2,000 words).
3. Every candidate is verified by the exact edit distance, bit-parallel over the item's words.

A walk drifts over a long item, so one of over LONG words is cut into even pieces of at most PIECE words, and each is searched like an item. Of
the pieces of a stretch within the item's distance, at least one is within its own, and more of them make a loss less likely. Where a piece is
found, the whole item is verified around it.

Items of under MIN_WORDS words leak where a text holds all their words in a row, without an edit: each place's next words are looked up
by their hash among those of the items of that length, and compared.

Items come to the workers in blocks of at most BLOCK_ITEMS items and BLOCK_WORDS words, one pass over the texts a block.

Defined results: null or empty texts and items, and items without a word, hold nothing; a null id of a document is passed through, items without an id are not searched; repeated rows are found each; very long texts are searched whole, one at
a time; an empty table of either kind gives no leaks; further columns are passed through by without_leaks, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.support import tidied
from spanweave.session import ship_package

RATE = 0.2
MIN_WORDS = 8
WALKS, SAMPLES = 4, 10
CLASSES = 16
LONG, PIECE = 120, 80
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 250_000
#: Words of texts handled at once.
CHUNK = 1 << 19
#: Thai to Tibetan, Burmese, Khmer, kana, Han ideographs.
_ALONE = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(f"[^\\W{_ALONE}]+|[{_ALONE}]")


def edits_allowed(n: int, rate: float) -> int:
    return int(n * rate)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = (x.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def edit_ends(item: list[int], text: list[int]) -> tuple[int, int]:
    """(least edit distance of the item to a stretch of the text, where the first such stretch ends), Myers' bit vectors."""
    n = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best, end = full, 0, n, n, 0
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def even_pieces(n: int) -> list[tuple[int, int]]:
    """[begin, end) of the fewest pieces of near equal length that have at most PIECE words."""
    cuts = [round(i * n / -(-n // PIECE)) for i in range(-(-n // PIECE) + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


class Items:
    """One block of items, ready for search."""

    def __init__(self, items: list[tuple[int, list[str]]], rate: float):
        self.rate = rate
        whole = [x for x in items if len(x[1]) > LONG]
        # (place in whole, first word) of each piece stands for an id
        pieces = [((k, at), ws[at:end]) for k, (_, ws) in enumerate(whole) for at, end in even_pieces(len(ws))]
        kept = sorted([x for x in items if MIN_WORDS <= len(x[1]) <= LONG] + pieces, key=lambda x: len(x[1]))
        short = sorted((x for x in items if 0 < len(x[1]) < MIN_WORDS), key=lambda x: len(x[1]))
        self.codes: dict[str, int] = {}
        # items and pieces that are searched, then the items that pieces belong to
        self.words = [[self.codes.setdefault(w, len(self.codes) + 1) for w in ws] for _, ws in kept + short + whole]
        first = len(kept) + len(short)
        self.ids = [None if isinstance(i, tuple) else i for i, _ in kept + short + whole]
        self.piece_of = {n: (first + i[0], i[1]) for n, (i, _) in enumerate(kept) if isinstance(i, tuple)}
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(ws) for _, ws in short}):
            part = np.array([i for i in range(len(kept), len(self.words)) if len(self.words[i]) == n])
            self.short[n] = self._table(self._row_keys(np.array([self.words[i] for i in part]).T), part)
        self.classes: list[dict] = []
        parts = [p for p in np.array_split(np.arange(len(kept)), min(CLASSES, max(1, len({len(w) for _, w in kept})))) if len(p)]
        self.masks = np.zeros(len(self.codes) + 1, np.uint32)
        # the walks' random functions: bit t of a word's hash says if step t moves on
        blocks = 2 * max((len(w) for w in self.words[:first]), default=1) // 64 + 1
        self.steps = np.stack([np.stack([mix(np.arange(len(self.codes) + 1), walk * 4096 + b + 1) for b in range(blocks)]) for walk in range(WALKS)])
        for c, part in enumerate(parts):
            sizes = [len(self.words[i]) for i in part]
            for i in part:
                self.masks[self.words[i]] |= np.uint32(1 << c)
            low, high = min(sizes), max(sizes)
            rng = np.random.default_rng(1000 + c)
            steps = 2 * low
            group = {"items": part, "need": low - edits_allowed(low, rate), "span": high + edits_allowed(high, rate), "steps": steps, "places": [[np.sort(rng.choice(steps, 2, replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)]}
            padded = np.zeros((len(part), group["span"]), np.int64)
            for row, i in zip(padded, part, strict=True):
                row[: len(self.words[i])] = self.words[i]
            group["tables"] = [[self._table(keys, part) for keys in self._samples(padded, group, w)] for w in range(WALKS)]
            self.classes.append(group)
        self.reach = max([MIN_WORDS, *[g["span"] for g in self.classes], *[len(ws) + 6 * edits_allowed(len(ws), rate) for _, ws in whole]])

    @staticmethod
    def _table(keys: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        return keys[order], part[order]

    def _samples(self, windows: np.ndarray, group: dict, walk: int) -> list[np.ndarray]:
        """The keys of each sample of one walk over (windows, span) word codes."""
        flat, base = windows.ravel(), np.arange(len(windows)) * windows.shape[1]
        at, last = base.copy(), base + windows.shape[1] - 1
        wanted = np.unique(np.concatenate(group["places"][walk]))
        out = {}
        for t in range(int(wanted[-1]) + 1):
            word = flat[np.minimum(at, last)]
            if t == wanted[len(out)]:
                out[t] = word
            at += ((self.steps[walk, t >> 6][word] >> np.uint64(t & 63)) & np.uint64(1)).view(np.int64)
        return [out[a] * (len(self.codes) + 1) + out[b] for a, b in group["places"][walk]]

    @staticmethod
    def _row_keys(places: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the words of each column."""
        return np.add.reduce([mix(row, k + 1) for k, row in enumerate(places)])

    def _search_short(self, stream: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        for n, (known, items) in self.short.items():
            padded = np.append(stream, np.zeros(n, stream.dtype))
            keys = self._row_keys(np.stack([padded[k : k + len(stream)] for k in range(n)]))
            first, last = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
            for at in np.flatnonzero(last > first).tolist():
                for item in items[first[at] : last[at]].tolist():
                    if padded[at : at + n].tolist() == self.words[item]:
                        yield at, at + n, item, 0

    def search(self, stream: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(start, end, item, distance) of verified leaks in a stream of word codes; texts in it lie `reach` zeros apart."""
        self.tried: dict[int, list[int]] = {}
        yield from self._search_short(stream)
        mask = self.masks[stream]
        for c, group in enumerate(self.classes):
            inside = np.concatenate([[0], np.cumsum((mask >> np.uint32(c)) & np.uint32(1), dtype=np.int32)])
            stop = np.minimum(np.arange(len(stream)) + group["span"], len(stream))
            starts = np.flatnonzero((inside[stop] - inside[:-1] >= group["need"]) & (stream > 0))
            for at in range(0, len(starts), 20_000):
                yield from self._wholes(stream, self._verify(stream, group, starts[at : at + 20_000]))

    def _wholes(self, stream: np.ndarray, found: Iterator[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """Items as they are found; in place of a piece its whole item, where that is near enough."""
        for start, end, item, distance in found:
            if item not in self.piece_of:
                yield start, end, item, distance
                continue
            item, offset = self.piece_of[item]
            words = self.words[item]
            k, about = edits_allowed(len(words), self.rate), start - offset
            near = self.tried.setdefault(item, [])
            # a stretch begins within k of where its piece tells; one trial takes in all that begin within 2 * k
            if any(abs(about - x) <= k for x in near[-64:]):
                continue
            near.append(about)
            low = max(0, about - 2 * k)
            text = stream[low : about + len(words) + 3 * k].tolist()
            if len(set(words) & set(text)) < len(set(words)) - k:
                continue
            distance, stop = edit_ends(words, text)
            if distance <= k:
                _, back = edit_ends(words[::-1], text[:stop][::-1])
                yield low + stop - back, low + stop, item, distance

    def _verify(self, stream: np.ndarray, group: dict, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        padded = np.append(stream, np.zeros(group["span"], stream.dtype))
        windows = padded[starts[:, None] + np.arange(group["span"])].astype(np.int64)
        met: list[np.ndarray] = []
        for walk in range(WALKS):
            for keys, (known, items) in zip(self._samples(windows, group, walk), group["tables"][walk], strict=True):
                first, last = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
                hit = np.flatnonzero(last > first)
                if len(hit):
                    n = last[hit] - first[hit]
                    slot = np.repeat(first[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    met.append(np.repeat(hit, n) * len(self.words) + items[slot])
        if not met:
            return
        for pair in np.unique(np.concatenate(met)).tolist():
            row, item = divmod(pair, len(self.words))
            words = self.words[item]
            n, k = len(words), edits_allowed(len(words), self.rate)
            text = windows[row, : n + k].tolist()
            if len(set(words) & set(text)) < len(set(words)) - k:
                continue
            distance, end = edit_ends(words, text)
            if distance <= k:
                yield int(starts[row]), int(starts[row]) + end, item, distance


class _Known(dict):
    def __missing__(self, word: str) -> int:
        return 0


def find_leaks(texts: list[str | None], items: Items) -> list[list[tuple[int, int, int, int]]]:
    """For each text the best stretch of each item in it: (item, first word, end word, distance)."""
    out: list[list] = [[] for _ in texts]
    if not items.ids:
        return out
    code = _Known(items.codes).__getitem__
    gap = np.zeros(items.reach, np.int32)
    held, starts, owners, size = [], [], [], 0

    def flush() -> None:
        best: dict[tuple[int, int], tuple] = {}
        begins = np.array(starts)
        for start, end, item, distance in items.search(np.concatenate(held)):
            d = int(np.searchsorted(begins, start, "right")) - 1
            # the least distance; of those the shortest stretch, then the first
            found = (distance, end - start, start - starts[d], end - starts[d])
            if (d, item) not in best or found < best[d, item]:
                best[d, item] = found
        for (d, item), (distance, _, start, end) in sorted(best.items()):
            out[owners[d]].append((item, start, end, distance))

    for i, text in enumerate(texts):
        if text:
            found = _WORD.findall(text.lower())
            held += [np.fromiter(map(code, found), np.int32, len(found)), gap]
            starts.append(size)
            owners.append(i)
            size += len(found) + len(gap)
            if size >= CHUNK:
                flush()
                held, starts, owners, size = [], [], [], 0
    if size:
        flush()
    return out


def item_blocks(spark: SparkSession, benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in blocks of bounded size; only one block at a time is on the driver."""
    block, size = [], 0
    for r in benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).toLocalIterator():
        words = _WORD.findall(r[1].lower())
        block.append((r[0], words))
        size += len(words)
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, distance): the best stretch of every item that a document holds."""
    ship_package(spark)
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id bigint, item_id bigint, first_word bigint, end_word bigint, distance bigint"
    out = None
    for block in item_blocks(spark, benchmark, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, rate)
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    some = batch.slice(at, 1000)
                    ids = some.column("doc_id").to_pylist()
                    rows = [(ids[i], items.ids[item], a, b, d) for i, found in enumerate(find_leaks(some.column("text").to_pylist(), items)) for item, a, b, d in found]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "first_word", "end_word", "distance"])

        found = kept.mapInArrow(lambda batches, run=run: tidied(run(batches)), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """The documents that hold no item, all columns; a filter without a shuffle."""
    ship_package(spark)
    # mapInArrow can't take a name with a dot, so columns go by number
    names, place = docs.columns, docs.columns.index(text_col)
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    for block in item_blocks(spark, benchmark, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, rate)
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    some = batch.slice(at, 1000)
                    found = find_leaks(some.column(place).to_pylist(), items)
                    yield some.filter(pa.array([not x for x in found]))

        docs = docs.mapInArrow(lambda batches, run=run: tidied(run(batches)), docs.schema)
    return docs.toDF(*names)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return leaks(spark, docs, benchmark)
