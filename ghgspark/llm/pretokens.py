"""Byte-level BPE over batches of texts: pre-tokens found with array operations, ids looked up per distinct pre-token."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

from ghgspark.llm.common import blocks, ragged, segment_hashes

SPACE, BREAK, LETTER, DIGIT, OTHER = range(5)

#: Bytes of a text of ASCII and Latin-1 letters (0xC3 and its continuation bytes).
CLASS = np.full(256, OTHER, np.uint8)
CLASS[ord(" ")] = SPACE
CLASS[[9, 10, 11, 12, 13]] = BREAK
CLASS[ord("0"):ord("9") + 1] = DIGIT
CLASS[ord("A"):ord("Z") + 1] = LETTER
CLASS[ord("a"):ord("z") + 1] = LETTER
CLASS[0x80:0xC0] = LETTER
CLASS[0xC3] = LETTER

#: Bytes that send a text to the general pattern: other scripts and signs, separators, apostrophes.
GENERAL = np.zeros(256, bool)
GENERAL[0xC0:] = True
GENERAL[0xC3] = False
GENERAL[0x1C:0x20] = True
GENERAL[ord("'")] = True


def starts_of(data: np.ndarray, offsets: np.ndarray, pattern: regex.Pattern) -> np.ndarray:
    """Whether a pre-token starts at each byte.

    Texts of ASCII and Latin-1 letters without apostrophes are cut by their byte classes: a run of letters, digits or
    other signs takes one blank before it; white space is one pre-token but for its last character before a word.
    Other texts are cut by the pattern itself.
    """
    n = len(data)
    start = np.zeros(n, bool)
    if not n:
        return start
    kind = CLASS[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # starts of texts, and the end
    white = kind <= BREAK
    before, after = np.empty(n, np.uint8), np.empty(n, bool)
    before[1:], before[0] = kind[:-1], OTHER
    after[:-1], after[-1] = white[1:], True
    after |= first[1:]
    same = before == kind
    np.logical_and(same, ~white, out=same)
    start = np.where(white, (before > BREAK) | ~after, ~same & (before != SPACE)) | first[:-1]
    odd = GENERAL[data]
    sign = np.zeros(n, bool)  # U+00D7 and U+00F7 are no letters
    sign[1:] = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    odd |= sign
    odd[np.flatnonzero(data == 0xC2)] = True
    for row in np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1):
        low, high = offsets[row], offsets[row + 1]
        words = pattern.findall(data[low:high].tobytes().decode("utf-8", "replace"))
        start[low:high] = False
        start[low + np.cumsum([0, *(len(w.encode()) for w in words)])[:-1]] = True
    return start


class PretokenIds:
    """Ids of whole texts; each distinct pre-token goes through ``encode`` once while it stays in the cache.

    Pre-tokens are told apart by a 64-bit hash of their bytes. A direct-mapped table answers for most of them in one
    array operation, a sorted array of all hashes for the rest (12 bytes an entry, a dictionary takes some 200). The cache
    is emptied at ``limit`` entries, so a worker's memory does not grow with the corpus.
    """

    def __init__(self, pattern: str, encode: Callable[[list[bytes]], list], limit: int = 1_500_000, block: int = 1 << 20):
        self.pattern, self.encode, self.limit, self.block = regex.compile(pattern), encode, limit, block
        self.mask = np.uint64((1 << 21) - 1)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slots = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.used, self.count = 0, 0
        self.ids, self.start, self.length = np.empty(1 << 16, np.uint32), np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)
        self.table_key, self.table_slot = np.zeros(int(self.mask) + 1, np.uint64), np.zeros(int(self.mask) + 1, np.int32)

    def _add(self, found: list) -> None:
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        total, n = int(lengths.sum()), len(found)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.count + n > len(self.start):
            self.start = np.concatenate([self.start, np.empty_like(self.start)])
            self.length = np.concatenate([self.length, np.empty_like(self.length)])
        self.ids[self.used:self.used + total] = np.concatenate([np.asarray(ids, np.uint32) for ids in found])
        self.start[self.count:self.count + n] = self.used + np.cumsum(lengths) - lengths
        self.length[self.count:self.count + n] = lengths
        self.used, self.count = self.used + total, self.count + n

    def texts(self, data: np.ndarray, offsets: np.ndarray):
        """(first row, ids, id offsets) for every block of the column."""
        for low, high in blocks(offsets, self.block):
            yield (low, *self._block(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]))

    def _slots(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        cell = hashes & self.mask
        slots = self.table_slot[cell]
        other = np.flatnonzero(self.table_key[cell] != hashes)
        if not len(other):
            return slots
        keys, where, inverse = np.unique(hashes[other], return_index=True, return_inverse=True)
        if self.count + len(keys) > self.limit and self.count:
            self._clear()
            return self._slots(hashes, data, starts, lengths)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        found = np.empty(len(keys), np.int32)
        found[known] = self.slots[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw, first = data.tobytes(), other[where[new]]
            found[new] = np.arange(self.count, self.count + len(new))
            self._add(self.encode([raw[s:s + n] for s, n in zip(starts[first].tolist(), lengths[first].tolist())]))
            self.keys, self.slots = np.insert(self.keys, at[new], keys[new]), np.insert(self.slots, at[new], found[new])
        self.table_key[keys & self.mask], self.table_slot[keys & self.mask] = keys, found
        slots[other] = found[inverse]
        return slots

    def _block(self, data: np.ndarray, offsets: np.ndarray):
        starts = np.flatnonzero(starts_of(data, offsets, self.pattern))
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        lengths = np.diff(starts, append=len(data))
        slots = self._slots(segment_hashes(data, starts, lengths), data, starts, lengths)
        counts = self.length[slots]
        ids = self.ids[ragged(self.start[slots], counts)]
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        return ids, ends[np.searchsorted(starts, offsets)]
