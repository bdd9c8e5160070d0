"""Edit distances of many pairs of texts at once, by bits: a column of the table of distances is a few machine words of differences (Myers), and each
step takes one character of all pairs. Long texts and those with rare characters take whole numbers of any length instead, a pair at a time."""

from __future__ import annotations

import numpy as np

#: Words of 64 characters up to which pairs go together, pairs of a group, fewest of a group, and characters that have a column in a group's table.
WORDS, GROUP, FEW, COMMON = 8, 4096, 64, 126
_ONE, _TOP = np.uint64(1), np.uint64(63)


def _together(chars: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """Distances of texts of m characters from `a`, m over `words` - 1 and at most `words` machine words, to those of n from `b`, longest first."""
    count, width = len(m), int(chars.max()) + 1
    base = np.arange(count) * width
    found = np.zeros(words * count * width, np.uint64)
    place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    # each place of a text has a bit of its own, so bits add up
    np.add.at(found, (place >> 6) * (count * width) + np.repeat(base, m) + chars[np.repeat(a, m) + place], _ONE << (place & 63).astype(np.uint64))
    found = found.reshape(words, count * width)
    plus, minus = np.full((words, count), ~np.uint64(0)), np.zeros((words, count), np.uint64)
    at = b.copy()
    for k in np.searchsorted(-n, -np.arange(n[0]), "left").tolist():
        here = chars.take(at[:k])
        here += base[:k]
        at[:k] += 1
        up, down = _ONE, None
        for w in range(words):
            p, q, eq = plus[w, :k], minus[w, :k], found[w].take(here)
            xv = eq | q
            if w:
                eq |= down
            xh = eq & p
            xh += p
            xh ^= p
            xh |= eq
            ph = xh | p
            np.invert(ph, out=ph)
            ph |= q
            xh &= p
            if w < words - 1:
                next_up, next_down = ph >> _TOP, xh >> _TOP
            ph <<= _ONE
            ph |= up
            xh <<= _ONE
            if w:
                xh |= down
            np.bitwise_and(ph, xv, out=q)
            xv |= ph
            np.invert(xv, out=xv)
            np.bitwise_or(xh, xv, out=p)
            if w < words - 1:
                up, down = next_up, next_down
    # down the last column the differences add up, from the length of the other text
    plus[-1] &= ~np.uint64(0) >> (63 - ((m - 1) & 63)).astype(np.uint64)
    minus[-1] &= ~np.uint64(0) >> (63 - ((m - 1) & 63)).astype(np.uint64)
    return n + np.bitwise_count(plus).sum(0, dtype=np.int64) - np.bitwise_count(minus).sum(0, dtype=np.int64)


def _alone(a: np.ndarray, b: np.ndarray) -> int:
    """The distance of two texts' characters; a is one whole number of bits."""
    m = score = len(a)
    every = (1 << m) - 1
    found = {c: int.from_bytes(np.packbits(a == c, bitorder="little").tobytes(), "little") for c in np.unique(a).tolist()}
    plus, minus = every, 0
    for c in b.tolist():
        eq = found.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (every & ~(xh | plus)), plus & xh
        score += ((ph >> (m - 1)) & 1) - ((mh >> (m - 1)) & 1)
        ph, mh = (ph << 1) | 1, mh << 1
        plus, minus = (mh | ~(xv | ph)) & every, ph & xv & every
    return score


def edit_distances(texts: list[str], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levenshtein's distances of texts[left] and texts[right] in characters, and the lengths of the texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    m, n = sizes[left], sizes[right]
    out = np.maximum(m, n)
    todo = np.flatnonzero((left != right) & (m > 0) & (n > 0))
    out[left == right] = 0
    if not len(todo):
        return out, sizes
    starts = np.cumsum(sizes) - sizes
    plain = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    # the commonest characters have numbers below COMMON, all others share the next
    times = np.bincount(plain)
    common = np.argsort(-times, kind="stable")[: min(COMMON, np.count_nonzero(times))]
    number = np.full(len(times), COMMON)
    number[common] = np.arange(len(common))
    chars = number[plain]
    rare = np.append(0, np.cumsum(chars == COMMON))
    rare = rare[starts + sizes] > rare[starts]
    # the text in machine words is the one that makes fewer steps of them
    swap = -(-n // 64) * m < -(-m // 64) * n
    a, b = np.where(swap, right, left), np.where(swap, left, right)
    words = -(-sizes[a] // 64)
    words[rare[a] | rare[b]] = WORDS + 1
    alone = [todo[words[todo] > WORDS]]
    for w in range(1, WORDS + 1):
        of = todo[words[todo] == w]
        if len(of) < FEW:
            alone.append(of)
            continue
        of = of[np.argsort(-sizes[b[of]], kind="stable")]
        for k in range(0, len(of), GROUP):
            x = of[k : k + GROUP]
            out[x] = _together(chars, starts[a[x]], sizes[a[x]], starts[b[x]], sizes[b[x]], w)
    for x in np.concatenate(alone).tolist():
        i, j = a[x], b[x]
        out[x] = _alone(plain[starts[i] : starts[i] + sizes[i]], plain[starts[j] : starts[j] + sizes[j]])
    return out, sizes
