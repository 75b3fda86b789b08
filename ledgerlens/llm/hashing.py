"""Word and shingle hashes of whole Arrow columns in numpy.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; A-Z are read as
a-z. All hashes are 64 bits and equal on every machine.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CASED = BYTE.copy()
BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACES = 4096
PLACE = np.cumprod(np.full(_PLACES, 0x9E3779B97F4A7C15, np.uint64))
TERM = _rng.integers(1, 2 ** 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


#: Classes of bytes; a word is a maximal run of one class other than 0.
#: Runs outside white space; runs of letters and digits; these and runs of
#: ASCII punctuation; runs of letters.
WORDS = (~SPACE).astype(np.uint8)
_ascii = [chr(i) for i in range(128)]
ALNUM = np.array([c.isalnum() for c in _ascii] + [True] * 128).astype(np.uint8)
TERMS = np.where(ALNUM > 0, 1, np.where(SPACE | (np.arange(256) < 33), 0, 2)).astype(np.uint8)
LETTERS = np.array([c.isalpha() for c in _ascii] + [True] * 128).astype(np.uint8)


def word_spans(raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray = WORDS,
               table: np.ndarray = BYTE, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, bytes) per word and bounds: the words of text i are
    bounds[i]:bounds[i + 1]. ``kinds``: the bytes' classes, where they do not
    follow from the bytes alone."""
    n = len(raw)
    kind = classes[raw] if kinds is None else kinds
    inside = kind > 0
    first = inside.copy()
    first[1:] &= kind[1:] != kind[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < n]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, bounds
    solid = raw[inside]
    begin = (np.cumsum(inside) - 1)[starts]
    size = np.diff(np.append(begin, len(solid)))
    place = np.arange(len(solid)) - np.repeat(begin, size)
    value = table[solid] * PLACE[place & (_PLACES - 1)]
    if size.max() > _PLACES:
        far = place >= _PLACES
        value[far] *= (place[far] // _PLACES * 2 + 1).astype(np.uint64)
    hashes = mix(np.add.reduceat(value, begin) + size.astype(np.uint64) * TERM[15])
    return hashes, starts, size, bounds


def word_hashes(raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and bounds of ``word_spans``."""
    hashes, _, _, bounds = word_spans(raw, offsets, classes)
    return hashes, bounds


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash per shingle, bounds): every run of ``k`` words of a text, the
    whole sequence as one where a text has fewer words, none without words."""
    count = np.diff(bounds)
    total = len(words)
    full = np.zeros(total, np.uint64)
    for j in range(min(k, total)):
        full[:total - j] += words[j:] * TERM[j]
    end = np.repeat(bounds[1:], count)
    at = np.arange(total)
    keep = at + k <= end
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        lone = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            lone[has] += words[bounds[short[has]] + j] * TERM[j]
        full[bounds[short]] = lone + count[short].astype(np.uint64) * TERM[14]
        keep[bounds[short]] = True
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    return mix(full[keep]), np.concatenate([[0], np.cumsum(made)])


class Slots:
    """Numbers of hashes, as a sorted array (a few bytes per hash)."""

    def __init__(self):
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it has none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.numbers[at], -1)

    def add(self, keys: np.ndarray) -> np.ndarray:
        """The next numbers, given to new and distinct keys."""
        numbers = np.arange(len(self.keys), len(self.keys) + len(keys))
        merged = np.concatenate([self.keys, keys])
        order = np.argsort(merged, kind="stable")
        self.keys = merged[order]
        self.numbers = np.concatenate([self.numbers, numbers])[order]
        return numbers
