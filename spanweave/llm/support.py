"""What several operators of this subpackage share: ASCII text rules, words of whole texts, samples, and the engine's written tables and
components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.operators.graphs import components  # noqa: F401 - shared with the engine
from spanweave.workspace import Workspace, shared_dir  # noqa: F401

#: The white space of all contracts: space and the controls from tab to carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def spare_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. lower() is the same on pure ASCII and much faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text lower-cased in A-Z, as UTF-8."""
    return text.encode().lower().split() if text else []


def word_slices(texts: pa.Array, slice_bytes: int = 8 << 20) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """The words of words() for slices of the texts in order: the distinct ones, the codes of all into them, and where each
    text's words begin (and the last end). A longer text is a slice of its own."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    held = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + slice_bytes, "right")))
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, stop - at)))
        offsets = split.offsets.to_numpy()
        flat = split.flatten().cast(pa.large_binary())
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        if not full.all():
            offsets = np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]
            flat = flat.filter(pa.array(full))
        found = flat.dictionary_encode()
        yield found.dictionary, found.indices.to_numpy(), (offsets - offsets[0]).astype(np.int64)
        at = stop


def tidied(rows: Iterator) -> Iterator:
    """The rows, and at the end what the task held goes back to the system: workers are used again by other stages."""
    try:
        yield from rows
    finally:
        pa.default_memory_pool().release_unused()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def hashed_sample(ids: DataFrame, n: int, salt: int) -> DataFrame:
    """The n values of column id whose hashes come first: bounded, and the same however the rows are partitioned.

    The hash is cut first where half as many again as wanted are expected, so the tasks together send the driver about that many. Ids that repeat
    count once.
    """
    ids = ids.select("id").where("id is not null").distinct()
    total = ids.count()
    place = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30))
    near = ids.where(place <= min(1 << 30, int((1 << 30) * (1.5 * n + 200) / max(total, 1))))
    return near.orderBy(place, "id").limit(n)


class Rows:
    """A numpy array that rows are appended to at constant cost a row."""

    def __init__(self, dtype: type, width: int | None = None):
        self.held, self.n = np.empty((1024,) if width is None else (1024, width), dtype), 0

    def append(self, more: np.ndarray) -> None:
        end = self.n + len(more)
        if end > len(self.held):
            bigger = np.empty((max(end, 2 * len(self.held)), *self.held.shape[1:]), self.held.dtype)
            bigger[: self.n] = self.held[: self.n]
            self.held = bigger
        self.held[self.n : end] = more
        self.n = end

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.held[at]

    def __len__(self) -> int:
        return self.n
