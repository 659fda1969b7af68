"""Chapter and article of chunks in order, and their parents in windows of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vankho.functions.text import ARTICLE_LINE, CHAPTER_LINE, INLINE, article_label, first_heading
from vankho.operators.ordered import forward_fill, greedy_windows, running_total

MOST, GAP = 6000, 2


def resolve(chunks: DataFrame, key: str, place: str) -> DataFrame:
    """`chunks`(key, place, text, structure) with chapter, article, method and ambiguous.

    Of each the chunk's own metadata counts first, then a heading in its text, then what stood last before it in the key; no article at
    all is a fallback. Ambiguous are fallbacks, and chunks whose metadata and heading name different articles.
    """
    text = F.coalesce("text", F.lit(""))
    meta = article_label(F.nullif(F.trim("structure.article"), F.lit("")))
    own = chunks.withColumns({
        "_chapter": F.coalesce(F.nullif(F.trim("structure.chapter"), F.lit("")), first_heading(text, CHAPTER_LINE, "Chương")),
        "_meta": meta, "_heading": first_heading(text, ARTICLE_LINE, "Điều"),
    }).withColumn("_article", F.coalesce("_meta", "_heading"))
    filled = forward_fill(forward_fill(own, [key], place, "_chapter", "chapter"), [key], place, "_article", "article")
    method = F.when(F.col("_meta").isNotNull(), "metadata").when(F.col("_heading").isNotNull(), "heading_inferred").when(F.col("article").isNotNull(), "carried_forward").otherwise("document_fallback")
    ambiguous = F.col("article").isNull() | F.coalesce((F.col("_meta") != F.col("_heading")), F.lit(False))
    return filled.withColumns({"method": method, "ambiguous": ambiguous}).drop("_chapter", "_meta", "_heading", "_article")


def resolve_from_start(chunks: DataFrame, key: str, place: str, near: int = 5) -> DataFrame:
    """`chunks` with article and context: a heading names its own chunk only within the first `near` characters; a later one counts from
    the next chunk on. context is what holds after the chunk, by which it is grouped."""
    text = F.coalesce("text", F.lit(""))
    headings = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(ARTICLE_LINE) & ~x.rlike(INLINE))
    line = F.get(headings, F.size(headings) - 1)
    last = F.concat(F.lit("Điều "), F.regexp_extract(line, ARTICLE_LINE, 1))
    at_start = F.substring(text, 1, 400).rlike(rf"(?iu)^[\s\S]{{0,{near}}}?điều\s+[0-9]")
    first = F.when(at_start, first_heading(text, ARTICLE_LINE, "Điều"))
    meta = article_label(F.nullif(F.trim("structure.article"), F.lit("")))
    own = chunks.withColumns({"_now": F.coalesce(meta, first), "_after": F.coalesce(meta, last)})
    filled = forward_fill(forward_fill(own, [key], place, "_after", "_before", own=False), [key], place, "_after", "context")
    return filled.withColumn("article", F.coalesce("_now", "_before")).drop("_now", "_after", "_before")


def parent_windows(children: DataFrame, keys: list[str], place: str, most: int = MOST) -> DataFrame:
    """`children`(keys, place, chars, ...) with `window`: all of a key in order, packed while their texts with two characters between fit."""
    return greedy_windows(children, keys, place, "chars", most, GAP)


def runs(children: DataFrame, key: str, place: str, label: str) -> DataFrame:
    """`children` with `run` (from 1): rows of a key that follow one another with the same label."""
    marked = forward_fill(children.withColumn("_label", F.coalesce(label, F.lit(""))), [key], place, "_label", "_last", own=False)
    new = (F.col("_last").isNull() | (F.col("_last") != F.col("_label"))).cast("bigint")
    before = running_total(marked.withColumn("_new", new), [key], place, F.col("_new"), "_run")
    return before.withColumn("run", F.col("_run") + F.col("_new")).drop("_label", "_last", "_new", "_run")
