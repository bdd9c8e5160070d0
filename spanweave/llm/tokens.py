"""Token ids of whole texts, part by part.

The tokenizer used here treats the parts of a text between blanks and line feeds separately, so each distinct part is
encoded once and looked up afterwards. A part of Latin letters with at most one closing mark goes straight to the BPE model,
any other through the whole library. The ids equal those of encoding the whole text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from spanweave.llm.support import Rows

#: Distinct parts remembered by one Python worker before it starts afresh.
CACHE_PARTS = 400_000
#: Bytes of text encoded at once.
SLICE_BYTES = 4 << 20
SENTENCE_ENDS = (".", "!", "?", "…", "。")
_CLOSERS = "\"')]}»”’"
_MARKS = frozenset(".,!?;:")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: itself if it prints, else the next free one from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b if b in shown else 256 + sum(x not in shown for x in range(b))) for b in range(256)}


class _Codes(dict):
    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        code = self[part] = len(self)
        self.new.append(part)
        return code


class PartEncoder:
    """Encodes texts with a lower-casing byte-level tokenizer; remembers the ids of each part between blanks."""

    def __init__(self, path: str, ordinary_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary_specials
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in _MARKS}
        self._clear()

    def _clear(self) -> None:
        self.codes = _Codes()
        self.flat, self.start, self.length, self.ends = Rows(np.uint32), Rows(np.int64), Rows(np.int64), Rows(bool)

    def _one(self, part: str) -> list[int] | None:
        """The ids of letters below U+0250 with at most one mark, else None. Such letters are in normal form C, and none but
        U+0130 turns into several when lower-cased."""
        core, mark = (part[:-1], self.marks[part[-1]]) if part[-1] in _MARKS else (part, None)
        if not core.isalpha() or max(core) >= "ɐ" or "İ" in core:
            return None
        low = core.lower()
        if not low.isascii():
            low = low.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(low)]
        return ids + mark if mark else ids

    def _learn(self) -> None:
        new, self.codes.new = self.codes.new, []
        ids = [self._one(p) if p else [] for p in new]
        rest = [i for i, x in enumerate(ids) if x is None]
        for at in range(0, len(rest), 5_000):
            some = rest[at : at + 5_000]
            for i, e in zip(some, self.tokenizer.encode_batch([new[i] for i in some], add_special_tokens=False), strict=True):
                ids[i] = e.ids
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start.append(len(self.flat) + np.cumsum(length) - length)
        self.flat.append(np.fromiter((i for x in ids for i in x), np.uint32, int(length.sum())))
        self.length.append(length)
        self.ends.append(np.array([p == "\n" or p.rstrip(_CLOSERS).endswith(SENTENCE_ENDS) for p in new], bool))

    def encode_slices(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For slices of the texts in order: uint32 ids of all, where each text's ids begin (and the last end), and the
        numbers of ids at which a sentence or line ends."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        held = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            before = held[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(held, before + SLICE_BYTES, "right")))
            yield self._encode(texts.slice(at, stop - at))
            pa.default_memory_pool().release_unused()
            at = stop

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.codes) > CACHE_PARTS:
            self._clear()
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        bounds = split.offsets.to_numpy()
        found = split.flatten().dictionary_encode()
        distinct = found.dictionary.to_pylist()
        known = np.fromiter(map(self.codes.__getitem__, distinct), np.int64, len(distinct))
        if self.codes.new:
            self._learn()
        codes = known[found.indices.to_numpy()]
        length = self.length[codes]
        after = np.cumsum(length)
        total = int(after[-1]) if len(after) else 0
        where = np.repeat(self.start[codes] - (after - length), length) + np.arange(total)
        return self.flat[where], np.concatenate([[0], after])[bounds - bounds[0]], np.unique(after[self.ends[codes]])

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """ids and sentence ends of one text."""
        ids, _, sentences = next(self.encode_slices(pa.array([text], pa.string())))
        return ids, sentences


_ENCODERS: dict[tuple[str, bool], PartEncoder] = {}


def encoder(path: str, ordinary_specials: bool = False) -> PartEncoder:
    """One encoder a worker process."""
    key = path, ordinary_specials
    if key not in _ENCODERS:
        _ENCODERS[key] = PartEncoder(*key)
    return _ENCODERS[key]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
