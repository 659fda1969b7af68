"""Several values packed in one field: one row per value, with its place.

The text is split on its quote character. Odd pieces are literals and kept whatever they contain; even pieces are split
on delimiters; an array fold puts the values back in their written order. Everything is a Catalyst expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vankho.functions.marks import is_missing

#: Characters that part values outside quotes.
DELIMITERS = r",;|/、；，｜\t\n\r"
_EDGE = rf"^[\s\h{DELIMITERS}]+|[\s\h{DELIMITERS}]+$"
_DOUBLE, _SINGLE, _BACKSLASH, _MARK = "\ue000", "\ue001", "\ue002", "\ue003"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE, "")


def _opened(df: DataFrame, bracketed: bool) -> DataFrame:
    """row_id and _text: the text within the list's own brackets; a missing closing bracket is tolerated."""
    df = df.select("row_id", _strip(F.col("_text")).alias("_text"))
    rounded = F.regexp_replace("_text", r"^[({]|[)}]$", "")
    df = df.select("row_id", F.when(F.col("_text").rlike(r"(?s)^\(.*\)$|^\{.*\}$"), _strip(rounded)).otherwise(F.col("_text")).alias("_text"))
    if bracketed:
        opens, ends = r"^\[\s*[\"'\[]", r"^\[|(?<=[\"'\]])\s*\]$"
    else:
        opens, ends = r"^\[", r"^\[|\s*\]$"
    return df.select("row_id", F.when(F.col("_text").rlike(opens), _strip(F.regexp_replace("_text", ends, ""))).otherwise(F.col("_text")).alias("_text"))


def _split(text: Column, pattern: str) -> Column:
    """Split on a pattern: marks first, since a pattern in regexp_replace is compiled once and one in split for every text."""
    return F.split(F.regexp_replace(text, pattern, _MARK), _MARK, -1)


def _loose(piece: Column, bracketed: bool) -> Column:
    """Values of an even piece: hard delimiters, two blanks, and single blanks between plain identifiers."""
    guard = r"(?![^\[\]]*\])" if bracketed else ""
    parts = rf"[{DELIMITERS}]+{guard}" + (r"|(?<=\])\s*(?=\[)" if bracketed else "")
    items = _split(piece, parts)
    if not bracketed:
        blanks = lambda x: F.when(x.rlike(r"^\h*[A-Za-z0-9_\-]+(?:\h+[A-Za-z0-9_\-]+)+\h*$"), _split(x, r"\h+")).otherwise(_split(x, r"\h{2,}"))
        items = F.when(piece.rlike(r"\H\h+\H"), F.flatten(F.transform(items, blanks))).otherwise(items)
    values = F.filter(items, lambda x: ~x.rlike(r"^[\s \[\](){}]*$"))
    return F.when(piece.rlike(rf"^[\s \[\](){{}}{DELIMITERS}]*$"), F.array().cast("array<string>")).otherwise(values)


def packed_values(df: DataFrame, column: str, bracketed: bool = False) -> DataFrame:
    """`df`(row_id, ...) reduced to row_id and `values`: array<string> of the values in `column`, in written order.

    Empty pieces are left out; null, empty text and markers for nothing give an empty array. bracketed: a value may itself stand
    in square brackets, which stay and guard the delimiters in it. Each step is a projection of its own, so that no expression is
    evaluated again for every piece.
    """
    none = F.array().cast("array<string>")
    one = _opened(df.select("row_id", F.col(column).alias("_text")).where(~is_missing(F.col("_text"))), bracketed)
    text = F.col("_text")
    shielded = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\\\", _BACKSLASH), r"\\\"", _DOUBLE), r"\\'", _SINGLE)
    one = one.select("row_id", F.when(text.contains("\\"), shielded).otherwise(text).alias("_text"))
    one = one.select("row_id", "_text", F.regexp_extract("_text", rf"(?:^|[{DELIMITERS}])\s*([\"'])", 1).alias("_quote"))
    pieces = F.when(F.col("_quote") == "", F.array("_text")).when(F.col("_quote") == '"', F.split("_text", '"', -1)).otherwise(F.split("_text", "'", -1))
    one = one.select("row_id", "_quote", pieces.alias("_pieces"))
    # an even piece becomes its values, an odd piece stays one literal
    split_up = F.transform("_pieces", lambda x, i: F.when(i % 2 == 1, F.array(x)).otherwise(_loose(x, bracketed)))
    # two quote characters in a row are one written character: they leave an empty even piece between two literals
    doubled = F.exists(F.transform("_pieces", lambda x, i: (i % 2 == 0) & (x == "") & (i > 0) & (i < F.size("_pieces") - 1)), lambda b: b)
    one = one.select("row_id", "_quote", "_pieces", split_up.alias("_parts"), doubled.alias("_doubled"))

    start = F.struct(none.alias("done"), F.lit(False).alias("glue"))

    def step(acc: Column, at: Column) -> Column:
        done, piece = acc["done"], F.get(F.col("_pieces"), at)
        glued = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.col("_quote"), piece)))
        return F.struct(
            F.when((at % 2 == 1) & acc["glue"], glued).otherwise(F.concat(done, F.get(F.col("_parts"), at))).alias("done"),
            ((at % 2 == 0) & (piece == "") & (at > 0) & (at < F.size("_pieces") - 1)).alias("glue"),
        )

    folded = F.aggregate(F.sequence(F.lit(0), F.size("_pieces") - 1), start, step, lambda acc: acc["done"])
    one = one.select("row_id", F.when(F.col("_doubled"), folded).otherwise(F.flatten("_parts")).alias("_values"))
    decoded = F.transform(
        "_values",
        lambda v: F.when(v.contains("\\"), F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), v, F.lit('"]')), "array<string>"), F.lit(0)), v)).otherwise(v),
    )
    one = one.select("row_id", decoded.alias("_values"))
    restored = F.transform("_values", lambda v: F.trim(F.when(v.rlike(r"[\ue000-\ue002]"), F.translate(v, _DOUBLE + _SINGLE + _BACKSLASH, "\"'\\")).otherwise(v)))
    return one.select("row_id", F.filter(restored, lambda v: v != "").alias("values"))


def unpack(df: DataFrame, column: str, bracketed: bool = False) -> DataFrame:
    """(row_id, pos, item_value): one row per value of `column`, pos from 1; rows without a value give none.

    Nulls, empty text and markers for nothing give no row; repeats stay; other columns of `df` play no part.
    """
    values = packed_values(df, column, bracketed)
    # the outer form: the plain one adds a filter on the array's size, which would repeat all the steps below the projections
    rows = values.select("row_id", F.posexplode_outer("values").alias("_at", "item_value")).where("_at is not null")
    return rows.select("row_id", (F.col("_at") + 1).alias("pos"), "item_value")
