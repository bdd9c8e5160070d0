"""LM scoring by a gated recurrent language model in numpy.

Words are counted over all training documents. The OUTPUTS most frequent words, the end and BUCKETS classes of rarer words
(by their first two bytes) are the network's vocabulary; a rare word's probability is its bucket's times a smoothed
unigram within the bucket, so every text gets the log10 probability of a proper distribution. A gated recurrent unit reads
the words; its output softmax is factored into CLASSES classes and the members of each.

Training is truncated backpropagation through time over windows of WINDOW steps with the state carried across windows. A
first model is fitted on a bounded sample on the driver (at most FIRST documents and FIRST_TOKENS tokens, the shorter ones of the sample first); then every partition trains on from it on all its training documents and the
partitions' parameters are averaged, weighted by tokens, in one distributed aggregation. Whole documents are queued in lanes, a
lane's state running from a document's first word to its end, and every window is trained on, the short ones at the end included.
Scoring carries the state through complete documents of any length.

Base scores need the count of every word: the HOT most frequent ones travel with the task, all others are joined.

Scores depend on how the training documents are dealt to partitions, as each trains on its own ones: another layout of the files
gives a slightly different model. Repeated runs over one layout agree.

Defined results: a null or empty text is the end token alone; a null id counts as the text "" for the split and is passed
through; repeated rows are scored each; an empty table gives an empty result; without training documents counts are 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.support import Workspace, hashed_sample, word_slices
from spanweave.session import ship_package

END = b"\n"  # no word holds it
CLASSES, MEMBERS = 32, 32
OUTPUTS = CLASSES * MEMBERS
BUCKETS = 64
HIDDEN = 16
END_ID = OUTPUTS - BUCKETS - 1
WINDOW = 16
LANES = 512
HOT = 60_000
FIRST, FIRST_TOKENS = 400, 1_000_000
#: The first model's passes over its sample: at most so many, none begun after FIRST_READ tokens in all.
FIRST_EPOCHS, FIRST_READ = 20, 1_500_000
#: Windows that a lane's documents are fetched for at once.
AHEAD = 16
SLICE_BYTES = 4 << 20


def held_out_column(id_col: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % 10 == 0


def bucket(word: bytes) -> int:
    return crc32(word[:2]) % BUCKETS


class Recurrent:
    """The network: parameters by name, all float32."""

    NAMES = ("inp", "rec", "cls", "cls_b", "mem", "mem_b")

    def __init__(self, params: dict[str, np.ndarray] | None = None, seed: int = 1):
        if params is None:
            rng = np.random.default_rng(seed)
            shape = {"inp": (OUTPUTS + 1, 3 * HIDDEN), "rec": (HIDDEN, 3 * HIDDEN), "cls": (HIDDEN, CLASSES), "cls_b": (CLASSES,), "mem": (CLASSES, HIDDEN, MEMBERS), "mem_b": (CLASSES, MEMBERS)}
            params = {k: (rng.normal(0, 0.25 if k == "rec" else 0.1, s) if not k.endswith("_b") else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
        self.p = params

    def start_biases(self, counts: np.ndarray) -> None:
        """Output biases at the unigram frequencies."""
        c = (counts + 0.5).reshape(CLASSES, MEMBERS)
        self.p["cls_b"] = np.log(c.sum(1) / c.sum()).astype(np.float32)
        self.p["mem_b"] = np.log(c / c.sum(1, keepdims=True)).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def from_flat(self, flat: np.ndarray) -> Recurrent:
        out, at = {}, 0
        for k in self.NAMES:
            n = self.p[k].size
            out[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return Recurrent(out)

    def advance(self, h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, tuple]:
        """One step for all lanes: the state after reading the ids `before`."""
        x, u = self.p["inp"][before], h @ self.p["rec"]
        gates = x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        return c + z * (h - c), (h, z, r, c, u[:, 2 * HIDDEN :])

    def bounded(self) -> bool:
        """Whether no logit of a state, whose parts lie within 1, can leave the range that exponentials take."""
        cls, mem = np.abs(self.p["cls"]).sum(0) + np.abs(self.p["cls_b"]), np.abs(self.p["mem"]).sum(1) + np.abs(self.p["mem_b"])
        return max(cls.max(), mem.max()) < 60

    def log_probs(self, h: np.ndarray, ids: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of P(id | state) of each row; with grad, adds the loss's gradients and gives that of h."""
        cls = ids // MEMBERS
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        h, cls, member = h[order], cls[order], (ids % MEMBERS)[order]
        edges = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        spans = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
        rows, one, bounded = np.arange(len(ids)), np.ones(CLASSES, h.dtype), self.bounded()

        def softmax(e: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Log probabilities of the outcomes `at`; e holds the probabilities afterwards, where they are needed."""
            if not bounded:
                np.clip(e, -60, 60, out=e)  # far beyond what the weights give; keeps the exponentials finite
            own = e[rows, at]
            np.exp(e, out=e)
            total = e @ one
            if grad is not None:
                e /= total[:, None]
                e[rows, at] -= 1
            return own - np.log(total)

        e = h @ self.p["cls"]
        e += self.p["cls_b"]
        logp = softmax(e, cls)
        m = np.empty((len(ids), MEMBERS), h.dtype)
        for c, at in spans:
            np.matmul(h[at], self.p["mem"][c], out=m[at])
            m[at] += self.p["mem_b"][c]
        logp += softmax(m, member)
        out = np.empty_like(logp)
        out[order] = logp
        if grad is None:
            return out, None
        grad["cls"] += h.T @ e
        grad["cls_b"] += e.sum(0)
        inner = e @ self.p["cls"].T
        for c, at in spans:
            grad["mem"][c] += h[at].T @ m[at]
            grad["mem_b"][c] += m[at].sum(0)
            inner[at] += m[at] @ self.p["mem"][c].T
        back = np.empty_like(inner)
        back[order] = inner
        return out, back

    def gradients(self, h: np.ndarray, before: np.ndarray, ids: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients over one window (steps, lanes) from state h, the state after it and the mean log probability; places of
        id -1, after a lane's last word, count for nothing."""
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        states, caches = [], []
        kept = [None if (first := b == OUTPUTS).sum() == 0 else (~first)[:, None].astype(h.dtype) for b in before]
        for t in range(len(before)):
            if kept[t] is not None:
                h = h * kept[t]
            h, cache = self.advance(h, before[t])
            states.append(h)
            caches.append(cache)
        flat, real = np.concatenate(states), ids.ravel() >= 0
        if real.all():
            logp, back = self.log_probs(flat, ids.ravel(), grad)
        else:
            back = np.zeros_like(flat)
            logp, back[real] = self.log_probs(flat[real], ids.ravel()[real], grad)
        back = back.reshape(len(before), -1, HIDDEN)
        dh = np.zeros_like(h)
        inner = np.empty((*before.shape, 3 * HIDDEN), h.dtype)
        for t in range(len(before) - 1, -1, -1):
            dh = dh + back[t]
            was, z, r, c, uc = caches[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (was - c) * z * (1 - z)
            dr = dc * uc * r * (1 - r)
            du = np.concatenate([dz, dr, dc * r], axis=1)
            np.concatenate([dz, dr, dc], axis=1, out=inner[t])
            grad["rec"] += was.T @ du
            dh = dh * z + du @ self.p["rec"].T
            if kept[t] is not None:
                dh *= kept[t]
        order = np.argsort(before, axis=None, kind="stable")
        words, starts = np.unique(before.ravel()[order], return_index=True)
        grad["inp"][words] = np.add.reduceat(inner.reshape(-1, 3 * HIDDEN)[order], starts)
        n = len(logp)
        return {k: g / n for k, g in grad.items()}, h, float(logp.mean())


class Trainer:
    """Adam over windows; OUTPUTS is the id before a document's first word."""

    def __init__(self, net: Recurrent, rate: float):
        self.net, self.rate, self.n = net, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.p.items()}

    def step(self, grad: dict) -> None:
        self.n += 1
        for k, g in grad.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            fix = np.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n)
            self.net.p[k] -= self.rate * fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-6)

    def stream(self, docs: Iterable[np.ndarray]) -> int:
        """Train on every window of the documents, each whole in one lane; the number of tokens trained on."""
        source, head, size = iter(docs), [], 0
        while size < LANES * WINDOW * 4 and (doc := next(source, None)) is not None:
            head.append(doc)
            size += len(doc)
        source, width = chain(head, source), WINDOW * AHEAD
        rest = [np.empty(0, np.int16)] * min(LANES, max(1, size // (WINDOW * 4)))  # a lane's ids to come, a document's first behind OUTPUTS
        h, last, tokens = np.zeros((len(rest), HIDDEN), np.float32), np.full(len(rest), OUTPUTS, np.int16), 0
        while True:
            for k, lane in enumerate(rest):
                parts, held = [lane], len(lane)
                while held < width and (doc := next(source, None)) is not None:
                    parts.append(doc)
                    held += len(doc)
                if len(parts) > 1:
                    rest[k] = np.concatenate(parts)
            # lanes by length, so that those of a window lie together when no documents are left
            lengths = np.array([len(lane) for lane in rest])
            order = np.argsort(-np.minimum(lengths, width), kind="stable")
            order = order[: int((lengths > 0).sum())]
            if not len(order):
                return tokens
            rest, h, last, lengths = [rest[k] for k in order], h[order], last[order], np.minimum(lengths[order], width)
            block = np.full((width, len(rest)), -1, np.int16)
            for k, lane in enumerate(rest):
                block[: lengths[k], k] = lane[:width]
                rest[k] = lane[width:]
            before = np.concatenate([last[None], block[:-1]])
            before[(before == END_ID) | (before < 0)] = OUTPUTS
            after = h.copy()
            for t in range(0, width, WINDOW):
                n = int((lengths > t).sum())
                if not n:
                    break
                ids = block[t : t + WINDOW, :n]
                tokens += int((ids >= 0).sum())
                grad, after[:n], _ = self.net.gradients(after[:n], before[t : t + WINDOW, :n], ids)
                self.step(grad)
            h, last = after, np.where(block[-1] == END_ID, OUTPUTS, block[-1]).astype(np.int16)


def score_documents(net: Recurrent, docs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each whole document of ids, the end last; documents share lanes but never a state."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    total = sum(map(len, docs))
    lanes: list[list[int]] = []
    size = max(len(docs[order[0]]), -(-total // LANES))
    room = 0
    for i in order:
        if not lanes or room < len(docs[i]):
            lanes.append([])
            room = size
        lanes[-1].append(i)
        room -= len(docs[i])
    lengths = [sum(len(docs[i]) for i in lane) for lane in lanes]
    lanes = [lanes[k] for k in np.argsort(lengths, kind="stable")[::-1]]
    lengths = np.sort(lengths)[::-1]
    ids = np.zeros((int(lengths[0]), len(lanes)), np.int16)
    for k, lane in enumerate(lanes):
        ids[: lengths[k], k] = np.concatenate([docs[i] for i in lane])
    active = np.searchsorted(-lengths, -np.arange(len(ids)), "left")  # lanes longer than t
    logp = np.zeros(ids.shape, np.float32)
    before = np.full(len(lanes), OUTPUTS, np.int16)
    h, held, span = np.zeros((len(lanes), HIDDEN), np.float32), [], 0
    for t in range(len(ids)):
        n = int(active[t])
        h, b = h[:n], before[:n]
        new = b == OUTPUTS
        if new.any():
            h = np.where(new[:, None], np.float32(0), h)
        h, _ = net.advance(h, b)
        before = np.where(ids[t, :n] == END_ID, OUTPUTS, ids[t, :n]).astype(np.int16)
        held.append(h)
        span += n
        if span >= 1 << 15 or t == len(ids) - 1:
            at = range(t - len(held) + 1, t + 1)
            found, _ = net.log_probs(np.concatenate(held), np.concatenate([ids[s, : active[s]] for s in at]))
            where = np.concatenate([[0], np.cumsum(active[at.start : at.stop])])
            for s, a in zip(at, where, strict=False):
                logp[s, : active[s]] = found[a : a + active[s]]
            held, span = [], 0
    out = np.zeros(len(docs))
    for k, lane in enumerate(lanes):
        own = logp[: lengths[k], k].astype(np.float64)
        out[lane] = np.add.reduceat(own, np.cumsum([0, *[len(docs[i]) for i in lane[:-1]]]))
    return out / np.log(10)


_TWO = np.array([crc32(bytes([a, b])) % BUCKETS for a in range(256) for b in range(256)], np.int16)
_ONE = np.array([crc32(bytes([a])) % BUCKETS for a in range(256)], np.int16)


def buckets(found: pa.Array) -> np.ndarray:
    """bucket() of every word of a large_binary array."""
    if not len(found):
        return np.empty(0, np.int16)
    _, offsets, data = found.buffers()
    at = np.frombuffer(offsets, np.int64)[found.offset : found.offset + len(found) + 1]
    data = np.frombuffer(data, np.uint8)
    first = data[at[:-1]].astype(np.int64)
    second = data[np.minimum(at[:-1] + 1, len(data) - 1)]
    return np.where(np.diff(at) > 1, _TWO[first << 8 | second], _ONE[first])


class Vocabulary:
    """Hot words' counts and network ids; anything else goes to a bucket."""

    def __init__(self, hot: list[tuple[bytes, int]], end_count: int, tokens: int, distinct: int, bucket_stats: list[tuple[int, int]]):
        self.n, self.v, self.end_count = tokens, distinct, end_count
        self.words = pa.array([w for w, _ in hot], pa.large_binary())
        self.counts = np.array([c for _, c in hot], np.int64)
        self.n_top = min(len(hot), END_ID)  # the network's words are the first ones
        self.stats = bucket_stats  # (tokens, distinct words) of each bucket
        stats = np.array(bucket_stats, np.float64)
        own = buckets(self.words)
        self.base = np.log10((self.counts + 0.1) / (self.n + 0.1 * (self.v + 1)))
        self.within = np.log10((self.counts + 0.1) / (stats[own, 0] + 0.1 * (stats[own, 1] + 1)))
        self.within[: self.n_top] = 0.0

    @property
    def end_base(self) -> float:
        return float(np.log10((self.end_count + 0.1) / (self.n + 0.1 * (self.v + 1))))

    def find(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place among the hot words or -1, network id) of each word."""
        hot = pc.fill_null(pc.index_in(found, self.words), -1).to_numpy(zero_copy_only=False)
        return hot, np.where((hot >= 0) & (hot < self.n_top), hot, OUTPUTS - BUCKETS + buckets(found)).astype(np.int16)


def _documents(vocabulary: Vocabulary, texts: pa.Array) -> Iterator[np.ndarray]:
    """Network ids of each text, its end included."""
    for distinct, codes, bounds in word_slices(texts, SLICE_BYTES):
        ids = np.insert(vocabulary.find(distinct)[1][codes], bounds[1:], END_ID)
        yield from np.split(ids, (bounds[1:] + np.arange(1, len(bounds)))[:-1])


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, n) over all texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(found: pa.Array, times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([found, pa.array(times, pa.int64())], ["word", "n"])

        for batch in batches:
            for distinct, codes, _ in word_slices(batch.column("text"), 2 * SLICE_BYTES):
                yield row(distinct.cast(pa.binary()), np.bincount(codes, minlength=len(distinct)))
            yield row(pa.array([END], pa.binary()), np.array([batch.num_rows]))

    return texts.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def learn_vocabulary(counts: DataFrame) -> Vocabulary:
    first = F.crc32(F.substring("word", 1, 2)) % BUCKETS
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the least count that at most HOT words reach, from numbers of words by count on a log scale: under 1,500 rows
    scale = F.floor(F.log2("n") * 24)
    real = counts.where(F.col("word") != F.lit(END))
    reach, least = 0, None
    for r in sorted(real.groupBy(scale.alias("s")).agg(F.count("*").alias("d"), F.min("n").alias("least")).collect(), key=lambda r: -r["s"]):
        reach += r["d"]
        if reach > HOT:
            break
        least = r["least"]
    hot = [(bytes(r["word"]), r["n"]) for r in real.where(F.col("n") >= least).collect()] if least is not None else []
    hot.sort(key=lambda x: (-x[1], x[0]))
    top = {bucket(w): [0, 0] for w, _ in hot}
    for w, n in hot[:END_ID]:
        top[bucket(w)][0] += n
        top[bucket(w)][1] += 1
    sums = {r["b"]: (r["t"], r["d"]) for r in counts.where(F.col("word") != F.lit(END)).groupBy(first.alias("b")).agg(F.sum("n").alias("t"), F.count("*").alias("d")).collect()}
    stats = [(sums.get(b, (0, 0))[0] - top.get(b, (0, 0))[0], sums.get(b, (0, 0))[1] - top.get(b, (0, 0))[1]) for b in range(BUCKETS)]
    end = counts.where(F.col("word") == F.lit(END)).first()
    return Vocabulary(hot, end["n"] if end else 0, whole[0], whole[1], stats)


def train(space: Workspace, texts: DataFrame, vocabulary: Vocabulary, first_docs: int, first_tokens: int) -> Recurrent:
    """texts: training rows (id, text). The first model sees at most first_docs documents and first_tokens tokens an epoch."""
    spark = space.spark
    net = Recurrent()
    seen = np.zeros(OUTPUTS)
    seen[: vocabulary.n_top] = vocabulary.counts[: vocabulary.n_top]
    seen[END_ID] = vocabulary.end_count
    seen[OUTPUTS - BUCKETS :] = [t for t, _ in vocabulary.stats]
    net.start_biases(seen)
    sent = spark.sparkContext.broadcast(vocabulary)  # at most HOT words

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = list(_documents(sent.value, batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array([len(d) for d in docs], pa.int64()), pa.array(docs, pa.list_(pa.int16()))], ["n", "ids"])

    first = F.broadcast(hashed_sample(texts.select("id"), first_docs, 3))  # first_docs ids
    tried = space.write(texts.join(first, "id").mapInArrow(ids_of, "n bigint, ids array<smallint>"), "first")
    # the shorter ones, as far as first_tokens go: a few numbers first, then no more ids than that
    reach, longest = 0, -1
    for r in tried.groupBy("n").count().orderBy("n").limit(first_docs).collect():
        reach += r["n"] * r["count"]
        if reach > first_tokens:
            break
        longest = r["n"]
    sample = [np.array(r["ids"], np.int16) for r in tried.where(F.col("n") <= longest).collect()]
    sample.sort(key=lambda d: (len(d), d.tobytes()))
    np.random.default_rng(2).shuffle(sample)
    if not sample:
        return net
    trainer = Trainer(net, 0.02)
    spent = 0
    for epoch in range(FIRST_EPOCHS):
        trainer.rate = 0.02 * 0.9**epoch
        trainer.stream(sample)
        spent += sum(map(len, sample))
        if spent > FIRST_READ:
            break
    start = spark.sparkContext.broadcast(net.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Recurrent({k: v.copy() for k, v in start.value.items()})
        trainer = Trainer(own, 0.003)
        tokens = trainer.stream(ids for batch in batches for ids in _documents(sent.value, batch.column("text")))
        if tokens:
            flat = own.flat()
            for at in range(0, len(flat), 4096):
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([flat[at : at + 4096]], pa.list_(pa.float32())), pa.array([tokens], pa.int64())], ["at", "weights", "tokens"])

    # a partition gives one model; they are averaged place by place before anything reaches the driver
    models = texts.select("text").mapInArrow(run, "at int, weights array<float>, tokens bigint")
    spread = models.select("tokens", F.col("at"), F.posexplode("weights").alias("k", "w")).groupBy((F.col("at") + F.col("k")).alias("place"))
    rows = spread.agg((F.sum(F.col("w") * F.col("tokens")) / F.sum("tokens")).alias("w")).orderBy("place").toPandas()
    sent.destroy()
    start.destroy()
    return net.from_flat(rows["w"].to_numpy()) if len(rows) else net


def score_texts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_docs: int = FIRST, first_tokens: int = FIRST_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    ship_package(spark)
    space = Workspace(spark, "lm")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", held_out_column(F.col("id")))
    training = texts.where("not held_out").select("id", "text")
    counts = space.write(count_words(training), "counts")
    vocabulary = learn_vocabulary(counts)
    net = train(space, training, vocabulary, first_docs, first_tokens)
    sent = spark.sparkContext.broadcast((vocabulary, net.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = sent.value[0], Recurrent(sent.value[1])
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            at = 0
            for distinct, local, bounds in word_slices(batch.column("text"), SLICE_BYTES):
                n, sizes = len(bounds) - 1, np.diff(bounds)
                hot, ids = vocabulary.find(distinct)

                def sums(of_word: np.ndarray) -> np.ndarray:
                    return np.diff(np.append(0.0, np.cumsum(of_word[local]))[bounds])  # noqa: B023

                def of_hot(values: np.ndarray) -> np.ndarray:
                    return np.where(hot >= 0, values[hot], 0.0) if len(values) else np.zeros(len(hot))  # noqa: B023

                flat = np.insert(ids[local], bounds[1:], END_ID)
                score = score_documents(model, np.split(flat, (bounds[1:] + np.arange(1, n + 1))[:-1])) + sums(of_hot(vocabulary.within))
                cold = hot[local] < 0
                pair, times = np.unique(np.repeat(np.arange(n), sizes)[cold] << 32 | local[cold], return_counts=True)
                cuts = np.searchsorted(pair >> 32, np.arange(n + 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(cuts, distinct.take(pa.array(pair & 0xFFFFFFFF)).cast(pa.binary()))
                known = sums(of_hot(np.ones(len(vocabulary.words)))).round().astype(np.int64) + (vocabulary.end_count > 0)
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), part.column("id"), part.column("held_out"), pa.array(sizes + 1), pa.array(known), pa.array(sums(of_hot(vocabulary.base)) + vocabulary.end_base), pa.array(score), rare, pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64()))],
                    ["row", "id", "held_out", "n_tokens", "known", "base", "score", "rare", "times"],
                )
                row, at = row + n, at + n

    schema = "row bigint, id bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double, rare array<binary>, times array<bigint>"
    scored = space.write(texts.mapInArrow(run, schema), "scored")
    pairs = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("p")).select("row", F.col("p.rare").alias("word"), F.col("p.times").alias("times"))
    joined = pairs.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    stats = F.expr("array(" + ",".join(f"{t + 0.1 * (d + 1)!r}D" for t, d in vocabulary.stats) + ")")
    inside = F.log10((F.col("n") + 0.1) / stats[(F.crc32(F.substring("word", 1, 2)) % BUCKETS).cast("int")])
    base = F.log10((F.col("n") + 0.1) / F.lit(vocabulary.n + 0.1 * (vocabulary.v + 1)))
    rest = joined.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("r_known"), F.sum(base * F.col("times")).alias("r_base"), F.sum(inside * F.col("times")).alias("r_score"))
    zero = F.lit(0)
    return scored.drop("rare", "times").join(rest, "row", "left").select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens", (F.col("known") + F.coalesce("r_known", zero)).alias("n_known"), F.lit(vocabulary.n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("r_base", zero)).alias("base_score"), (F.col("score") + F.coalesce("r_score", zero)).alias("score")
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
