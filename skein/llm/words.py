"""Words of many texts at once, as spans of one byte array, and their 64-bit hashes."""

from __future__ import annotations

import numpy as np

#: Space and the five ASCII line and tab controls.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the maximal runs of bytes that ``inside`` (a table) holds for; none crosses texts."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = inside[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(raw))]
    first[borders] = word[borders]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[borders - 1] = word[borders - 1]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int | None = None) -> np.ndarray:
    """A 64-bit hash of each span's bytes (of its first ``most``)."""
    size = ends - starts if most is None else np.minimum(ends - starts, most)
    h = np.full(len(starts), 0x2545F4914F6CDD1D, np.uint64)
    live, at, k = np.flatnonzero(size > 0), None, 0
    while len(live):
        h[live] = h[live] * _STEP + _BYTE[raw[starts[live] + k]]
        k += 1
        live = live[size[live] > k]
    return mix(h ^ size.astype(np.uint64))


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words of each text, and the edges of the texts in them.

    A text of fewer words has the run of all of them; one without words has none.
    """
    counts = np.bincount(doc, minlength=n_docs)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    room = counts[doc] - (np.arange(len(words)) - firsts[:-1][doc]) if len(words) else np.zeros(0, np.int64)
    whole = (room >= n) | ((room == counts[doc]) & (counts[doc] < n)) if len(words) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    h = mix(words[at] + np.uint64(1))
    for k in range(1, n):
        more = room[at] > k
        h[more] = mix(h[more] * _STEP + words[at[more] + k] + np.uint64(k + 1))
    return h, np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=n_docs))])
