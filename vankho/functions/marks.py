"""Values that stand for nothing, and accent folding."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers for nothing as they occur in the tables (compared trimmed and lower-cased).
MISSING_MARKERS = ["", "chưa phân loại", "chua phan loai", "null", "none", "nan", "n/a", "na", "-", "--", "[]", "{}", "()"]


def is_missing(col: Column) -> Column:
    """True for null, empty text and markers for nothing; never null."""
    return F.coalesce(F.lower(F.regexp_replace(col, r"^[\s\h]+|[\s\h]+$", "")).isin(MISSING_MARKERS), F.lit(True))


@cache
def _fold_pairs() -> tuple[str, str]:
    """Every precomposed Latin letter with its bare letter, by decomposition; the barred D forms by hand."""
    source, target = [], []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(point)
        bare = unicodedata.normalize("NFD", letter)[0]
        if bare != letter and bare.isascii():
            source.append(letter)
            target.append(bare)
    for letter, bare in (("Đ", "D"), ("đ", "d"), ("Ð", "D"), ("ð", "d"), ("Ɖ", "D"), ("ɖ", "d")):
        source.append(letter)
        target.append(bare)
    return "".join(source), "".join(target)


def fold(col: Column) -> Column:
    """Lower-case text without accents, combining marks and invisible characters."""
    source, target = _fold_pairs()
    bare = F.translate(F.regexp_replace(col, r"[\p{M}\p{Cf}]", ""), source, target)
    return F.lower(bare)


def fold_text(text: str) -> str:
    """`fold` for a Python string."""
    source, target = _fold_pairs()
    kept = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return kept.translate(str.maketrans(source, target)).lower()
