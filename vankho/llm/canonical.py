"""Visually identical text with different characters: one consistent form (problem 5).

Arrow batches are copied to numpy code-point arrays. Full-width forms, odd blanks and invisible characters go through lookup
tables; look-alike letters are replaced in words that have Latin letters; then marks are composed. No call is made per row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vankho.llm import codepoints as C

#: Cyrillic and Greek letters with the Latin letters they look like, and two look-alikes of the barred D.
LOOK_ALIKES = {
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ι": "i", "υ": "u", "κ": "k", "τ": "t", "χ": "x",
    "Ð": "Đ", "Ɖ": "Đ", "ɖ": "đ", "ð": "đ", "ı": "i", "ɑ": "a", "ɡ": "g",
}
_DROP = 0x2FFFF


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Simple replacements (dropped characters become _DROP), look-alikes (0: none), and classes of letters: 1 Latin, 2 other script, 3 mark or joiner."""
    simple = np.arange(C.TABLE, dtype=np.uint32)
    for point in range(0xFF01, 0xFF5F):
        simple[point] = point - 0xFEE0
    for point in range(C.TABLE - 0x10000):
        if 0xD800 <= point < 0xE000:
            continue
        kind = unicodedata.category(chr(point))
        if kind == "Zs":
            simple[point] = C.SPACE
        elif kind == "Cf":
            simple[point] = _DROP
    for point in (*range(0xFE00, 0xFE10), 0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0):
        simple[point] = _DROP
    for point, letter in ((0xFFE0, 0xA2), (0xFFE1, 0xA3), (0xFFE5, 0xA5), (0x0340, 0x300), (0x0341, 0x301)):
        simple[point] = letter
    alike = np.zeros(C.TABLE, np.uint32)
    for other, latin in LOOK_ALIKES.items():
        alike[ord(other)] = ord(latin)
    scripts = np.zeros(C.TABLE, np.uint8)
    for point in range(0x20000):
        if 0xD800 <= point < 0xE000:
            continue
        kind = unicodedata.category(chr(point))
        if kind[0] == "L":
            scripts[point] = 1 if point < 0x250 or 0x1E00 <= point < 0x1F00 else 2
        elif kind == "Mn":
            scripts[point] = 3
    for other in "ÐƉɖðıɑɡ":
        scripts[ord(other)] = 1
    return simple, alike, scripts


def canonical(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One consistent form of a batch: normal width, ordinary blanks, nothing invisible, own letters, composed accents."""
    simple, alike, scripts = _tables()
    cp = C.gather(cp, simple)
    drop = cp == _DROP
    if drop.any():
        cp, starts = C.keep(cp, starts, ~drop)
    if not cp.size:
        return cp, starts
    inside = np.minimum(cp, C.TABLE - 1)
    kind = scripts[inside]
    other = alike[inside] > 0
    if other.any():
        letter = kind > 0
        first = np.zeros(len(cp), bool)
        first[starts[:-1][starts[:-1] < len(cp)]] = True
        begins = letter & (first | ~np.concatenate([[False], letter[:-1]]))
        word = np.cumsum(begins)
        words = word[-1] + 1
        # marks of Vietnamese letters count as Latin: no other script of the tables carries them
        vietnamese = np.isin(cp, [0x300, 0x301, 0x302, 0x303, 0x306, 0x309, 0x31B, 0x323])
        latin = np.bincount(word[letter & ((kind == 1) | vietnamese)], minlength=words)
        foreign = np.bincount(word[letter & (kind == 2) & ~other], minlength=words)
        # a word wholly of look-alikes is written in the other script only if its script's own letters stand beside it
        strange = np.bincount(word[letter & (kind == 2)], minlength=words)
        lone = strange_words(cp, kind, other, word, words, starts, strange, latin, foreign)
        change = letter & other & (foreign[word] == 0) & ((latin[word] > 0) | lone[word])
        cp = np.where(change, alike[inside], cp)
    return C.compose(cp.astype(np.uint32), starts)


def strange_words(cp, kind, other, word, words, starts, strange, latin, foreign) -> np.ndarray:
    """Words made of look-alikes only ("со", "ТН"): replaced if no word of the same text has letters that are of another script alone.

    Single letters that are symbols in formulas (a lone Greek letter) stay.
    """
    size = strange
    only = (size > 0) & (latin == 0) & (foreign == 0)
    if not only.any():
        return only
    at = np.zeros(words, np.int64)
    letter = kind > 0
    index = np.flatnonzero(letter)
    at[word[index][::-1]] = index[::-1]
    text = np.searchsorted(starts, at, "right") - 1
    own = np.zeros(len(starts), bool)
    own[text[foreign > 0]] = True
    greek = (cp[np.minimum(at, len(cp) - 1)] >= 0x370) & (cp[np.minimum(at, len(cp) - 1)] < 0x400)
    return only & (~own[text] | (size > 1)) & ~((size == 1) & greek & ~np.isin(cp[np.minimum(at, len(cp) - 1)], [0x3BF, 0x39F]))


def canonical_array(texts: pa.Array) -> pa.Array:
    """`canonical` for an Arrow string array; nulls stay null."""
    out = C.encode(*canonical(*C.decode(texts)))
    if texts.null_count:
        out = pa.compute.if_else(texts.is_valid(), out, pa.scalar(None, pa.string()))
    return out


def with_canonical(df: DataFrame, column: str, out: str = "canonical") -> DataFrame:
    """`df` reduced to row_id, `column` and its consistent form; null stays null, empty stays empty."""
    schema = f"row_id bigint, text string, {out} string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in C.slices(batches):
            text = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), text, canonical_array(text)], names=["row_id", "text", out])

    return df.select(F.col("row_id").cast("bigint").alias("row_id"), F.col(column).alias("text")).mapInArrow(run, schema)


def not_canonical(df: DataFrame, column: str) -> DataFrame:
    """row_id of each row whose text is not in the consistent form; null and empty texts are."""
    import pyarrow.compute as pc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            text = batch.column(1).fill_null("")
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pc.not_equal(text, canonical_array(text)))], names=["row_id"])

    return df.select(F.col("row_id").cast("bigint").alias("row_id"), F.col(column).alias("text")).mapInArrow(run, "row_id bigint")
