"""Word shingles of texts, hashed in batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd

SHINGLE = 5
# Characters hashed at once.
_BATCH = 500_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-case runs without white space."""
    return (text or "").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, words of each text)."""
    cut = [words_of(t) for t in texts]
    counts = np.array([len(w) for w in cut], np.int64)
    codes, distinct = pd.factorize(np.array([*chain.from_iterable(cut), None], dtype=object)[:-1])
    own = pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False) if len(distinct) else np.empty(0, np.uint64)
    return own[codes] if len(codes) else np.empty(0, np.uint64), counts


def rolled(word: np.ndarray) -> np.ndarray:
    """Hashes of the shingles that start at each word; those of the last words run over the end."""
    padded = np.concatenate((word, np.zeros(SHINGLE, np.uint64)))
    sums = np.zeros(len(word), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            sums = mixed(sums * _PRIME + padded[k : k + len(word)] + np.uint64(k))
    return sums


def _hashes(texts: list[str | None], short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes of all texts, first of each text and the end, words of each text).

    A text of fewer words than a shingle is one shingle if `short`, else none.
    """
    word, counts = word_hashes(texts)
    sums = rolled(word)
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(len(word))
    keep = left >= SHINGLE
    numbers = np.maximum(counts - SHINGLE + 1, 0)
    if short:
        few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        for k in few:
            total = np.uint64(counts[k])
            for w in word[ends[k] - counts[k] : ends[k]]:
                total = mixed(np.array([total * _PRIME + w]))[0]
            at = ends[k] - counts[k]
            sums[at], keep[at], numbers[k] = total, True, 1
    return sums[keep], np.concatenate(([0], np.cumsum(numbers))), counts


def runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts that are hashed at once."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= _BATCH or k == len(texts) - 1:
            yield begin, k + 1
            begin, size = k + 1, 0


def hashed(texts: list[str | None], short: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, hashes, bounds, words) of runs of texts."""
    for begin, end in runs(texts):
        with np.errstate(over="ignore"):
            yield begin, end, *_hashes(texts[begin:end], short)
