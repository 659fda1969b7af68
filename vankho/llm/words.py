"""Words of a batch of texts as numbers, without a call per row: folding by table, boundaries, one 64-bit hash per word."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

from vankho.llm import codepoints as C
from vankho.llm.canonical import LOOK_ALIKES

_DROP = 0xFFFFFFFF


@cache
def fold_table() -> np.ndarray:
    """Code point to bare lower-case letter or digit; 0 parts words; marks and invisible characters are dropped."""
    out = np.zeros(C.TABLE, np.uint32)
    for point in range(0x20000):
        if 0xD800 <= point < 0xE000:
            continue
        letter = chr(point)
        kind = unicodedata.category(letter)
        if kind in ("Mn", "Cf"):
            out[point] = _DROP
        elif kind[0] == "L" or kind == "Nd":
            bare = unicodedata.normalize("NFKD", letter)[0].lower()[0]
            out[point] = ord({"đ": "d", "ð": "d", "ɖ": "d"}.get(bare, bare))
    for other, latin in LOOK_ALIKES.items():
        out[ord(other)] = ord({"đ": "d"}.get(latin.lower(), latin.lower()))
    return out


@cache
def _powers() -> np.ndarray:
    out = np.empty(64, np.uint64)
    value = 1
    for i in range(64):
        out[i] = value
        value = value * 0x9E3779B97F4A7C15 % (1 << 64)
    return out


def words(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, begin, word_starts): a hash per word, where each word begins in `cp`, and the n + 1 offsets of the texts in words."""
    folded = C.gather(cp, fold_table()) if not (cp.size and cp.max() >= C.TABLE) else fold_table()[np.minimum(cp, C.TABLE - 1)]
    kept = np.flatnonzero(folded != _DROP)
    folded = folded[kept]
    letter = folded != 0
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    inside = np.searchsorted(kept, starts)
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    edge = inside[:-1][inside[:-1] < len(letter)]
    begins[edge] |= letter[edge]
    at = np.flatnonzero(begins)
    index = np.flatnonzero(letter)
    word = np.cumsum(begins)[index] - 1
    place = np.minimum(index - at[word], 63)
    weighted = (folded[index].astype(np.uint64) + np.uint64(7)) * _powers()[place]
    bounds = np.searchsorted(word, np.arange(len(at)))
    hashes = np.add.reduceat(weighted, bounds)
    hashes ^= hashes >> np.uint64(29)
    return hashes, kept[at], np.searchsorted(at, inside)
