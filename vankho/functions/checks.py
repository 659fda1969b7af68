"""Validation expressions: contracts of chunks and vectors, marks of a bad text layer, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRATEGIES = ["fixed-size", "semantic", "hierarchical"]


def chunk_error(chunk_id: Column, strategy: Column, source: Column, first: Column, last: Column, text: Column) -> Column:
    """Reason why a chunk breaks the contract; "skip" for one with blank text; null for a good one."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return (
        F.when(blank(chunk_id), "chunk_id")
        .when(~F.coalesce(strategy.isin(STRATEGIES), F.lit(False)), "strategy")
        .when(blank(source), "source")
        .when(F.coalesce(first < 1, F.lit(True)), "page_start")
        .when(F.coalesce(last < first, F.lit(True)), "page_end")
        .when(blank(text), "skip")
    )


def vector_ok(vector: Column, size: int) -> Column:
    """Right size, all elements finite, not all zero."""
    return F.coalesce(
        (F.size(vector) == size) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists(vector, lambda x: F.abs(x) > 1e-9),
        F.lit(False),
    )


def vector_error(vector: Column, size: int) -> Column:
    """Reason why a vector breaks the contract, else "ok"."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.when(vector.isNull(), "null").when(F.size(vector) != size, "size").when(~finite, "not finite").when(~F.exists(vector, lambda x: F.abs(x) > 1e-9), "zero").otherwise("ok")


def text_problems(text: Column) -> Column:
    """Array of flags of a bad text layer: empty, replaced characters, digits inside words, mixed case, control characters."""
    mixed = F.regexp_count(text, F.lit(r"[a-zđ][A-ZĐ][a-zđ]"))
    digits = F.regexp_count(text, F.lit(r"[\p{L}][0-9][\p{L}]"))
    return F.array_compact(
        F.array(
            F.when(F.trim(text) == "", "empty"),
            F.when(F.contains(text, F.lit("�")), "replaced"),
            F.when(text.rlike("Ã.|Ä.|Â."), "mojibake"),
            F.when(digits >= 3, "digits"),
            F.when(mixed >= 3, "mixed"),
        )
    )


def text_quality(text: Column) -> Column:
    """Score of a page's text layer: 0.2 for hardly any text, 0.3 for many replaced characters, 0.4 for digits inside words, else 1."""
    length = F.length(F.trim(text))
    replaced = F.regexp_count(text, F.lit("�"))
    digits = F.regexp_count(text, F.lit(r"[\p{L}][0-9][\p{L}]"))
    return F.when(F.coalesce(length, F.lit(0)) < 15, 0.2).when(replaced > 0.03 * F.length(text), 0.3).when(digits >= 3, 0.4).otherwise(1.0)


def legal_number_ok(col: Column) -> Column:
    """At least four characters, not a date, with a letter."""
    return F.coalesce((F.length(col) >= 4) & ~col.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$") & col.rlike(r"\p{L}"), F.lit(False))


def date_ok(col: Column, form: str = "dd/MM/yyyy") -> Column:
    """A date that exists, in the given form."""
    return F.coalesce(col.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$") & F.try_to_timestamp(col, F.lit(form)).isNotNull(), F.lit(False))
