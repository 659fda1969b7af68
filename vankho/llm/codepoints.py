"""Batches of text as numpy code-point arrays: decoding, table gathers with expansion, composition of marks, encoding.

All functions work on a whole batch at once: `cp` holds the code points of all texts one after another, `starts` the n + 1 offsets.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = 0x20
TABLE = 0x30000


def decode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points and offsets of an Arrow string array; nulls count as empty texts. One decoding call for the whole batch."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    if n == 0 or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    cp = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return cp, lead[offsets - offsets[0]]


#: Bytes of text that a task works on at once.
SLICE = 2_000_000


def slices(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of batches with about SLICE bytes of text in a column, at least one row each: a text is never cut."""
    for batch in batches:
        size = pc.binary_length(batch.column(column).fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // SLICE
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def encode(cp: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Arrow string array of a batch."""
    raw = np.ascontiguousarray(cp, np.uint32).tobytes().decode("utf-32-le", "replace").encode("utf-8")
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])[starts].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(at.tobytes()), pa.py_buffer(raw)).cast(pa.string())


def keep(cp: np.ndarray, starts: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the code points under `mask`."""
    return cp[mask], np.concatenate([[0], np.cumsum(mask)])[starts]


def gather(cp: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[cp], code points beyond the table unchanged."""
    if cp.size and cp.max() >= len(table):
        inside = cp < len(table)
        out = cp.copy()
        out[inside] = table[cp[inside]]
        return out
    return table[cp]


@cache
def compositions() -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs base << 21 | mark, and the code points they compose to: every canonical composition of letter and mark."""
    pairs = {}
    for point in [*range(0xC0, 0x2000), *range(0x3040, 0x3100)]:
        parts = unicodedata.normalize("NFD", chr(point))
        once = unicodedata.decomposition(chr(point)).split()
        if len(once) == 2 and not once[0].startswith("<") and unicodedata.normalize("NFC", parts) == chr(point):
            base, mark = (int(x, 16) for x in once)
            pairs[base << 21 | mark] = point
    keys = np.array(sorted(pairs), np.int64)
    return keys, np.array([pairs[k] for k in keys], np.uint32)


@cache
def mark_classes() -> np.ndarray:
    """Canonical combining class by code point; 0 for letters."""
    out = np.zeros(TABLE, np.uint8)
    for point in [*range(0x300, 0x370), *range(0x483, 0x488), *range(0x591, 0x5C8), *range(0x610, 0x65F), *range(0x900, 0xE4F), *range(0x1AB0, 0x1B00), *range(0x1DC0, 0x1E00), *range(0x20D0, 0x20F1), *range(0x302A, 0x3030), *range(0x3099, 0x309B), *range(0xFE20, 0xFE30)]:
        out[point] = unicodedata.combining(chr(point))
    return out


@cache
def decompositions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Full canonical decompositions of Latin letters: by code point a length (0: none) and a start in one flat array."""
    length, start, flat = np.zeros(TABLE, np.int64), np.zeros(TABLE, np.int64), []
    for point in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        parts = unicodedata.normalize("NFD", chr(point))
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == chr(point):
            length[point], start[point] = len(parts), len(flat)
            flat.extend(map(ord, parts))
    return length, start, np.array(flat, np.uint32)


def expand(cp: np.ndarray, starts: np.ndarray, where: np.ndarray, length: np.ndarray, start: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points under `where` replaced by their sequences in `flat`; offsets move with them."""
    size = np.ones(len(cp), np.int64)
    size[where] = length[cp[where]]
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(to[-1], np.uint32)
    plain = ~where
    out[to[:-1][plain]] = cp[plain]
    if where.any():
        counts = size[where]
        begin = np.repeat(to[:-1][where], counts)
        within = np.arange(counts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        out[begin + within] = flat[np.repeat(start[cp[where]], counts) + within]
    return out, to[starts]


def syllables(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hangul letters put together to syllables, by the rule of their code points: lead and vowel, then the tail."""
    if not ((cp >= 0x1161) & (cp < 0x11C3)).any():
        return cp, starts
    for low, high in ((0x1161, 0x1176), (0x11A8, 0x11C3)):
        first = np.zeros(len(cp) + 1, bool)
        first[starts] = True
        before, after = cp[:-1].astype(np.int64), cp[1:].astype(np.int64)
        lead = (before >= 0x1100) & (before < 0x1113) if low == 0x1161 else (before >= 0xAC00) & (before < 0xD7A4) & ((before - 0xAC00) % 28 == 0)
        at = np.flatnonzero((after >= low) & (after < high) & lead & ~first[1:-1]) + 1
        cp = cp.copy()
        cp[at - 1] = 0xAC00 + ((cp[at - 1] - 0x1100) * 21 + (cp[at] - 0x1161)) * 28 if low == 0x1161 else cp[at - 1] + (cp[at] - 0x11A7)
        mask = np.ones(len(cp), bool)
        mask[at] = False
        cp, starts = keep(cp, starts, mask)
    return cp, starts


def compose(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks in canonical order and composed with their letters, all runs of the batch at once.

    Letters followed by marks are decomposed first; each round then sets one mark of every run on its letter.
    """
    cp, starts = syllables(cp, starts)
    classes = mark_classes()
    marked = gather(cp, classes.astype(np.uint32)).astype(np.uint8) if cp.size and cp.max() >= TABLE else classes[cp]
    if not marked.any():
        return cp, starts
    length, start, flat = decompositions()
    before = np.zeros(len(cp), bool)
    before[:-1] = marked[1:] > 0
    bounded = np.minimum(cp, TABLE - 1)
    where = before & (length[bounded] > 0)
    if where.any():
        cp, starts = expand(cp, starts, where, length, start, flat)
        marked = classes[np.minimum(cp, TABLE - 1)]
    first = np.zeros(len(cp), bool)
    first[starts[:-1][starts[:-1] < len(cp)]] = True
    runs = np.cumsum((marked == 0) | first)
    if ((marked[1:] > 0) & (marked[:-1] > marked[1:]) & (runs[1:] == runs[:-1])).any():
        order = np.lexsort((np.where(marked == 0, 0, marked), runs))
        cp, marked = cp[order], marked[order]
    keys, made = compositions()
    for _ in range(4):
        # a mark directly after its letter (all earlier marks of the run are already composed) or after marks of a lower class
        at = np.flatnonzero((marked[1:] > 0) & (marked[:-1] == 0) & ~first[1:]) + 1
        if not at.size:
            break
        pair = cp[at - 1].astype(np.int64) << 21 | cp[at].astype(np.int64)
        hit = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        good = keys[hit] == pair
        if not good.any():
            # the next mark may still compose past one that cannot
            far = np.flatnonzero((marked[2:] > 0) & (marked[1:-1] > 0) & (marked[2:] > marked[1:-1]) & (marked[:-2] == 0) & ~first[2:] & ~first[1:-1]) + 2
            pair = cp[far - 2].astype(np.int64) << 21 | cp[far].astype(np.int64)
            hit = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            good = keys[hit] == pair
            if not good.any():
                break
            cp = cp.copy()
            cp[far[good] - 2] = made[hit[good]]
            gone = far[good]
        else:
            cp = cp.copy()
            cp[at[good] - 1] = made[hit[good]]
            gone = at[good]
        mask = np.ones(len(cp), bool)
        mask[gone] = False
        cp, starts = keep(cp, starts, mask)
        marked, first = marked[mask], first[mask]
    return cp, starts
