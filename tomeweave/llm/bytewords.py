"""Words of many texts at once, as numpy arrays over their bytes.

A word is a run of bytes that are letters a-z, digits or beyond ASCII, after
A-Z are lower-cased; in UTF-8 these are just the runs of such characters.
"""

from __future__ import annotations

import numpy as np

_CODES = np.arange(256)
LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
IS_WORD = (
    ((_CODES >= 48) & (_CODES <= 57)) | ((_CODES >= 65) & (_CODES <= 90)) | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
)
KEEP_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
ODD_A, ODD_B, ODD_C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Words:
    """Words of the texts ``raw[ends[i]:ends[i + 1]]``.

    ``start`` and ``end`` are byte places in ``low``, the lower-cased bytes;
    ``first[i]`` is the number of words before text i. A byte that ends a text
    also ends its last word.
    """

    def __init__(self, raw: np.ndarray, ends: np.ndarray):
        base = int(ends[0])
        low = LOWER[raw[base : int(ends[-1])]]
        bounds = ends - base
        mark = np.zeros(len(low) + 1, bool)
        mark[:-1] = IS_WORD[low]
        begins = mark.copy()
        begins[1:] &= ~mark[:-1]
        inner = bounds[(bounds > 0) & (bounds < len(low))]
        begins[inner] = mark[inner]
        self.start = np.flatnonzero(begins)
        stops = np.zeros(len(low) + 1, bool)
        stops[1:] = mark[:-1] & ~mark[1:]
        stops[inner] |= mark[inner - 1]
        self.end = np.flatnonzero(stops)
        self.first = np.searchsorted(self.start, bounds)
        self.low = np.concatenate([low, np.zeros(8, np.uint8)])

    def __len__(self) -> int:
        return len(self.start)

    def word(self, k: int) -> bytes:
        return self.low[self.start[k] : self.end[k]].tobytes()

    def heads(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first eight bytes, last eight bytes, length) of each word: all of a word of up to 16 bytes."""
        eights = np.lib.stride_tricks.as_strided(self.low, (max(0, len(self.low) - 7), 8), (1, 1))
        length = self.end - self.start
        short = np.minimum(length, 8)
        head = np.ascontiguousarray(eights[self.start]).view("<u8")[:, 0] & KEEP_BYTES[short]
        tail = np.ascontiguousarray(eights[np.maximum(self.end - 8, self.start)]).view("<u8")[:, 0] & KEEP_BYTES[short]
        return head, tail, length

    def keys(self) -> np.ndarray:
        """A 64-bit key per word; equal words have equal keys."""
        return word_keys(*self.heads())


def word_keys(head: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
    mixed = head * ODD_A ^ (tail * ODD_B + length.astype(np.uint64) * ODD_C)
    mixed ^= mixed >> np.uint64(29)
    mixed *= ODD_B
    return mixed ^ (mixed >> np.uint64(32))
