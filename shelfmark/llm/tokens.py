"""Token ids of whole texts, piece by piece: each distinct piece is encoded once per worker.

Both vocabularies first part a text into pieces (runs of letters, digits or marks) and encode
each by itself, so a text's ids are those of its pieces one after the other.  Texts of Latin
letters are parted here by the same rule, and what is new among their pieces goes to the
tokenizer in one call; any other text goes to it as it is.
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import chain

import numpy as np

from shelfmark.llm import workers

# Characters whose kind is known here: what holds others goes to the tokenizer whole.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_MARKS = r"!-/:-@\[-`{-~"
_SPACES = " \n\t\r"
# Pieces by a space that belongs to what follows it, and pieces without white space.
_SPACED = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+|'(?:[sdmt]|ll|ve|re)| ?[{_MARKS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_BARE = re.compile(rf"[{_LETTERS}]+|[0-9]|'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])|[{_MARKS}]+")
# Distinct pieces kept per worker; beyond, all are let go.
_KEPT = 1 << 20
# Pieces to a call of the tokenizer.
_RUN = 1000
# Characters encoded at once.
_BATCH = 500_000


class Encoder:
    """`spaced`: a space belongs to the piece that follows it; else white space is dropped."""

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced, self.find = Tokenizer.from_file(path), spaced, (_SPACED if spaced else _BARE).findall
        vocabulary = self.tokenizer.get_vocab()
        # How many bytes a token stands for, and whether it ends a piece: one of them tells pieces apart.
        self.bytes, self.ends = np.zeros(max(vocabulary.values()) + 1, np.int64), np.zeros(max(vocabulary.values()) + 1, bool)
        for token, k in vocabulary.items():
            self.bytes[k], self.ends[k] = len(token), token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        # An open hash table from the 64-bit hashes of pieces to their numbers: a tenth of a dictionary's memory.
        self.count = 0
        self.hashes, self.numbers = np.zeros(2 * _KEPT, np.int64), np.full(2 * _KEPT, -1, np.int32)
        self.pool, self.bounds = np.empty(0, np.uint16 if len(self.bytes) <= 1 << 16 else np.uint32), np.zeros(1, np.int32)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes ^ (hashes >> 29)) & (2 * _KEPT - 1)

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of known pieces, -1 for others."""
        slots = self._slots(hashes)
        found = self.numbers[slots]
        astray = np.flatnonzero((found >= 0) & (self.hashes[slots] != hashes))
        while len(astray):
            slots[astray] = (slots[astray] + 1) & (2 * _KEPT - 1)
            found[astray] = self.numbers[slots[astray]]
            astray = astray[(found[astray] >= 0) & (self.hashes[slots[astray]] != hashes[astray])]
        return found

    def _enter(self, hashes: np.ndarray) -> None:
        """Numbers new pieces, whose hashes differ, in order."""
        numbers = np.arange(self.count, self.count + len(hashes), dtype=np.int32)
        slots, left = self._slots(hashes), np.arange(len(hashes))
        while len(left):
            # One to a free slot; the others move on.
            _, first = np.unique(slots[left], return_index=True)
            chosen = left[first]
            chosen = chosen[self.numbers[slots[chosen]] < 0]
            self.hashes[slots[chosen]], self.numbers[slots[chosen]] = hashes[chosen], numbers[chosen]
            placed = np.zeros(len(hashes), bool)
            placed[chosen] = True
            left = left[~placed[left]]
            slots[left] = (slots[left] + 1) & (2 * _KEPT - 1)
        self.count += len(hashes)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        # Many pieces to a call: one result holds the ids of all.
        runs = [new[k : k + _RUN] for k in range(0, len(new), _RUN)]
        ids = np.concatenate([
            np.array(e.ids, np.uint32) for k in range(0, len(runs), 8)
            for e in self.tokenizer.encode_batch_fast(runs[k : k + 8], is_pretokenized=True, add_special_tokens=False)
        ])
        if self.spaced:
            upto, wanted = np.cumsum(self.bytes[ids]), np.cumsum([len(p.encode()) for p in new])
            ends = np.minimum(np.searchsorted(upto, wanted), len(ids) - 1) + 1
            right = (upto[ends - 1] == wanted).all()
        else:
            ends = np.flatnonzero(self.ends[ids]) + 1
            right = len(ends) == len(new)
        if not right:
            each = self._whole(new)
            ids, ends = np.array([*chain.from_iterable(each)], np.uint32), np.cumsum([len(x) for x in each])
        self.bounds = np.concatenate((self.bounds, (len(self.pool) + ends).astype(np.int32)))
        self.pool = np.concatenate((self.pool, ids.astype(self.pool.dtype)))

    def _part(self, text: str) -> list[str] | None:
        """The pieces of a text, or None where one of its characters is in none of them."""
        pieces = self.find(text)
        dropped = 0 if self.spaced else sum(map(text.count, _SPACES))
        # Special tokens begin with these two marks.
        return pieces if sum(map(len, pieces)) + dropped == len(text) and "<|" not in text else None

    def _places(self, flat: list[str]) -> np.ndarray:
        hashes = np.fromiter(map(hash, flat), np.int64, len(flat))
        numbers = self._numbers(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            if self.count and self.count + len(new) > _KEPT:
                self.forget()
                return self._places(flat)
            for k in range(0, len(new), _KEPT // 2):
                self._learn([flat[i] for i in missing[first[k : k + _KEPT // 2]].tolist()])
            self._enter(new)
            numbers[missing] = self._numbers(hashes[missing])
        return numbers

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [self._part(t) for t in texts]
        index = self._places([*chain.from_iterable(p for p in cut if p)])
        starts = self.bounds[:-1][index]
        sizes = self.bounds[1:][index] - starts
        at = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        ids = self.pool[np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])].astype(np.uint32)
        ends = at[np.cumsum([0 if p is None else len(p) for p in cut])]
        lengths = np.diff(np.concatenate(([0], ends)))
        others = [k for k, p in enumerate(cut) if p is None]
        if others:
            pieces = np.split(ids, ends[:-1])
            for k, x in zip(others, self._whole([texts[k] for k in others]), strict=True):
                pieces[k] = np.array(x, np.uint32)
                lengths[k] = len(x)
            ids = np.concatenate(pieces)
        return ids, lengths

    def batches(self, texts: list[str | None]):
        """(from, to, ids, lengths) of runs of texts; null texts are empty."""
        begin, size = 0, 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size >= _BATCH or k == len(texts) - 1:
                yield begin, k + 1, *self._batch([t or "" for t in texts[begin : k + 1]])
                begin, size = k + 1, 0


@cache
def _kept(name: str, spaced: bool) -> Encoder:
    import public_tokenizers

    return Encoder(name if os.path.sep in name else public_tokenizers.path(name), spaced)


workers.on_idle(_kept.cache_clear)


def encoder(name: str, spaced: bool) -> Encoder:
    """One per worker, as long as its tasks follow each other; `name` is a path, or a file of
    the public tokenizers installed."""
    return _kept(name, spaced)
