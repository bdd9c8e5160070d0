"""Pairs of a document's sentences in a worker: words are numbers there, and pairs that share none are never looked at.

A set of rows is the sorted numbers code * rows + row, so that the rows which hold a word lie together, in order. Of a word of a row those later rows of its
document are read that hold it too: their number grows with the pairs that meet, and they are held a bounded block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens that are coded at once, and pairs with their common words that are held at once, but for what a single row makes.
TOKENS, HELD = 1 << 17, 1 << 20


def stretches(batches: Iterator[pa.RecordBatch], most: int = TOKENS, whole: bool = True) -> Iterator[pa.RecordBatch]:
    """Whole documents of sentence rows, together of some `most` tokens; a document begins where n is 1. If they need not be whole, each stretch but the first
    begins with the last row of the one before."""

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(kept).combine_chunks().to_batches()[0]

    kept, size = [], 0
    for batch in batches:
        if not whole and size >= most and batch.num_rows:
            yield joined()
            kept, size = [kept[-1].slice(kept[-1].num_rows - 1)], 0
        firsts = np.flatnonzero(batch.column("n").to_numpy() == 1)
        cut = int(firsts[-1]) if len(firsts) else 0
        if whole and size >= most and len(firsts):
            kept.append(batch.slice(0, cut))
            yield joined()
            kept, size, batch = [], 0, batch.slice(cut)
        if batch.num_rows:
            kept.append(batch)
            size += len(batch.column("toks").flatten())
    if kept:
        yield joined()


def distinct(numbers: np.ndarray) -> np.ndarray:
    """The numbers in order, each once; np.unique goes through a hash table, which takes longer."""
    numbers = np.sort(numbers)
    return numbers[np.append(True, numbers[1:] != numbers[:-1])] if len(numbers) else numbers


class Tokens:
    """The tokens of sentence rows as numbers: `row` is each one's row, a null is a word like any other."""

    def __init__(self, rows: pa.RecordBatch):
        self.rows, self._toks = rows.num_rows, rows.column("toks").flatten()
        sizes = rows.column("toks").value_lengths().to_numpy()
        self.row = np.repeat(np.arange(self.rows), sizes)
        self.word = ~self._toks.field("is_punct").fill_null(True).to_numpy(zero_copy_only=False)
        self._coded: dict[str, tuple[np.ndarray, pa.Array]] = {}

    def codes(self, field: str) -> tuple[np.ndarray, pa.Array]:
        """The numbers of a field's values, and the values."""
        if field not in self._coded:
            of = pc.dictionary_encode(self._toks.field(field), null_encoding="encode")
            self._coded[field] = of.indices.to_numpy(zero_copy_only=False).astype(np.int64), of.dictionary
        return self._coded[field]

    def among(self, field: str, values: tuple[str, ...]) -> np.ndarray:
        codes, names = self.codes(field)
        return np.array([v in values for v in names.to_pylist()], bool)[codes]

    def nodes(self) -> tuple[np.ndarray, int]:
        """The numbers of dependency and part of speech together, of words; and how many there are."""
        (dep, deps), (pos, tags) = self.codes("dep_type"), self.codes("pos_coarse")
        pairs, inverse = np.unique((dep * len(tags) + pos)[self.word], return_inverse=True)
        names, deps, tags = {}, deps.to_pylist(), tags.to_pylist()
        number = [names.setdefault(" ".join(x for x in (deps[p // len(tags)], tags[p % len(tags)]) if x is not None), len(names)) for p in pairs.tolist()]
        return np.array(number, np.int64)[inverse], len(names)

    def held(self, field: str, *coarse: str, base: int = 0) -> np.ndarray:
        """The set of a field's values among tokens of some parts of speech; codes begin at `base`."""
        told = self.among("pos_coarse", coarse)
        return distinct((self.codes(field)[0][told] + base) * self.rows + self.row[told])

    def roots(self, labels: tuple[str, ...]) -> np.ndarray:
        """The number of words before each row's first root, -1 without one."""
        before, out = np.cumsum(self.word) - self.word, np.full(self.rows, -1)
        at = np.flatnonzero(self.word & self.among("dep_type", labels))[::-1]
        out[self.row[at]] = before[at] - before[np.searchsorted(self.row, self.row[at])]
        return out

    def joined(self, field: str) -> tuple[np.ndarray, list[str]]:
        """The numbers of the rows' texts, a field's values with blanks between them, and the texts."""
        values = self._toks.field(field)
        given = self.row[values.is_valid().to_numpy(zero_copy_only=False)]
        ends = np.searchsorted(given, np.arange(self.rows + 1)).astype(np.int32)
        of = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), values.drop_null()), " ").dictionary_encode()
        return of.indices.to_numpy(zero_copy_only=False).astype(np.int64), of.dictionary.to_pylist()


def neighbours(of: np.ndarray, before: np.ndarray, rows: int) -> np.ndarray:
    """How many words of each row the row before it has in the other set; the first row's number means nothing."""
    if not len(before):
        return np.zeros(rows, np.int64)
    at = np.minimum(np.searchsorted(before, of - 1), len(before) - 1)
    return np.bincount(of[before[at] == of - 1] % rows, minlength=rows)


class Pairs:
    """Pairs of a row and a later one of the same document; documents are the stretches of rows that begin at `firsts`."""

    def __init__(self, firsts: np.ndarray, rows: int, held: int = HELD):
        self.rows, self.firsts, self.most = rows, firsts, held
        self.ends = np.append(firsts[1:], rows)
        self.end = np.repeat(self.ends, self.ends - firsts)
        self.later = self.end - np.arange(rows) - 1
        sizes = self.ends - firsts
        self.pairs = sizes * (sizes - 1) // 2

    def _met(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of rows a to b: (a, b, where each row's pairs begin, and of each common word of a pair the two rows and the pair's place)."""
        row = left % self.rows
        low = np.searchsorted(right, left, "right")
        many = np.searchsorted(right, left - row + self.end[row], "left") - low
        order = np.argsort(row, kind="stable")
        row, low, many = row[order], low[order], many[order]
        at = np.searchsorted(row, np.arange(self.rows + 1))
        done = np.cumsum(self.later + np.diff(np.append(0, np.cumsum(many))[at]))
        a = 0
        while a < self.rows:
            b = max(int(np.searchsorted(done, (done[a - 1] if a else 0) + self.most, "right")), a + 1)
            begin = np.append(0, np.cumsum(self.later[a:b]))
            n = many[at[a] : at[b]]
            i = np.repeat(row[at[a] : at[b]], n)
            j = right[np.repeat(low[at[a] : at[b]] - np.cumsum(n) + n, n) + np.arange(n.sum())] % self.rows
            yield a, b, begin, i, j, begin[i - a] + j - i - 1
            a = b

    def meeting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """A document's pairs whose earlier row has a word of the left set that the later one has in the right set."""
        out = np.zeros(len(self.firsts), np.int64)
        for a, b, begin, _, _, cell in self._met(left, right):
            if len(cell):
                met = np.zeros(begin[-1], bool)
                met[cell] = True
                for d in range(np.searchsorted(self.ends, a, "right"), np.searchsorted(self.firsts, b, "left")):
                    out[d] += np.count_nonzero(met[begin[max(self.firsts[d] - a, 0)] : begin[min(self.ends[d], b) - a]])
        return out

    def shares(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the shares of common words in all words of two rows, and of their squares, over a document's pairs."""
        size, total, squares = np.bincount(of % self.rows, minlength=self.rows), np.zeros(len(self.firsts)), np.zeros(len(self.firsts))
        for _, _, begin, i, j, cell in self._met(of, of):
            if len(cell):
                # a pair comes once a common word, each time with that word's part of it
                common = np.bincount(cell, minlength=begin[-1])[cell]
                part = 1.0 / (size[i] + size[j] - common)
                doc = np.searchsorted(self.ends, i, "right")
                total += np.bincount(doc, part, len(total))
                squares += np.bincount(doc, common * part * part, len(total))
        return total, squares
