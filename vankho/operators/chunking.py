"""Splitting texts into ordered chunks, and chunks into parents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vankho.functions.text import HEADINGS, pieces_within
from vankho.operators.ordered import running_total


def fixed_size(docs: DataFrame, size: int = 600, overlap: int = 120) -> DataFrame:
    """(doc_id, pos, start, end): windows of `size` characters, each begun size - overlap after the last, cut back to the last blank
    of their second half unless they reach the end; the first window that reaches the end is the last. Null and empty texts have none."""
    step = size - overlap
    given = docs.where("text is not null and text <> ''").select("doc_id", "text", F.length("text").alias("n"))
    last = F.greatest(F.ceil((F.col("n") - size) / step), F.lit(0))
    at = given.select("doc_id", "text", "n", F.posexplode(F.sequence(F.lit(0), last.cast("int"))).alias("pos", "i")).withColumn("start", F.col("i") * step)
    piece = at.withColumn("piece", F.substring(F.col("text"), F.col("start") + 1, F.lit(size)))
    blank = F.length("piece") - F.call_function("locate", F.lit(" "), F.reverse("piece"))
    whole = F.col("start") + size >= F.col("n")
    cut = F.when(~whole & F.contains("piece", F.lit(" ")) & (blank > size / 2), blank).otherwise(F.length("piece"))
    return piece.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("start").cast("bigint").alias("start"), (F.col("start") + cut).cast("bigint").alias("end"))


def page_slices(pages: DataFrame, size: int = 600, overlap: int = 120, bucket: int = 20_000) -> DataFrame:
    """(source, pos, start, page_start, page_end): plain slices of a source's pages read one after another, two characters between.

    pages: (source, page, chars), one row per page. The lookup of offsets is a range join within buckets of `bucket` characters, so
    that a long source is spread over its buckets.
    """
    step = max(1, size - overlap)
    placed = running_total(pages, ["source"], "page", F.col("chars") + 2, "begin").withColumn("end", F.col("begin") + F.col("chars") + 2)
    total = pages.groupBy("source").agg((F.sum(F.col("chars") + 2) - 2).alias("n"))
    slices = total.where("n > 0").select("source", "n", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(step).cast("bigint"))).alias("pos", "start"))
    slices = slices.withColumn("stop", F.least(F.col("start") + size, F.col("n")) - 1)
    held = placed.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("begin") / bucket), F.floor((F.col("end") - 1) / bucket))))

    def page_at(df: DataFrame, offset: str, out: str) -> DataFrame:
        keyed = df.withColumn("bucket", F.floor(F.col(offset) / bucket))
        there = held.select("source", "bucket", "begin", "end", F.col("page").alias(out))
        return keyed.join(there, ["source", "bucket"]).where((F.col(offset) >= F.col("begin")) & (F.col(offset) < F.col("end"))).drop("bucket", "begin", "end")

    found = page_at(page_at(slices, "start", "page_start"), "stop", "page_end")
    return found.select("source", F.col("pos").cast("bigint").alias("pos"), "start", F.col("page_start").cast("bigint").alias("page_start"), F.col("page_end").cast("bigint").alias("page_end"))


def sentence_chunks(docs: DataFrame, largest: int = 800, least: int = 150) -> DataFrame:
    """(doc_id, pos, text): sentences packed greedily; a chunk closes when the next sentence would pass `largest` and it holds `least`.

    The fold runs over a document's own sentences. Lengths count sentences without the blanks that join them.
    """
    parts = F.split(F.regexp_replace("text", r"(?<=[.!?])\s+(?=[\p{Lu}0-9])|\n{2,}", "\ue010"), "\ue010", -1)
    sentences = docs.where("text is not null").select("doc_id", F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "").alias("s"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(a, x):
        full = (a["n"] + F.length(x) > largest) & (a["n"] >= least)
        joined = F.when(a["open"] == "", x).otherwise(F.concat(a["open"], F.lit(" "), x))
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"),
            F.when(full, x).otherwise(joined).alias("open"),
            F.when(full, F.length(x)).otherwise(a["n"] + F.length(x)).alias("n"),
        )

    folded = F.aggregate("s", start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return sentences.select("doc_id", F.posexplode(folded).alias("pos", "text"))


def article_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, article, heading, chapter, n_lines, n_chars): one chunk per article heading, with the chapter that stands before it.

    Lines before the first article belong to article 0. The windows run within a document.
    """
    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    is_article, is_chapter = F.col("line").rlike(HEADINGS["article"]), F.col("line").rlike(HEADINGS["chapter"])
    run = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("article", F.sum(is_article.cast("bigint")).over(run)).withColumn("chapter", F.last(F.when(is_chapter, F.trim("line")), ignorenulls=True).over(run))
    return marked.groupBy("doc_id", "article").agg(
        F.min_by("line", "line_no").alias("heading"), F.coalesce(F.min_by("chapter", "line_no"), F.lit("Phần mở đầu")).alias("chapter"),
        F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"),
    )


def article_corpus(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, place, text): one text per article with document and chapter before it; the preamble comes last, if it has more
    than 30 characters. An article number met again in a document gets _1, _2 and so on."""
    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    run = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    chapter = F.last(F.when(F.col("line").rlike(HEADINGS["chapter"]), F.trim("line")), ignorenulls=True).over(run)
    marked = lines.select("*", F.sum(F.col("line").rlike(HEADINGS["article"]).cast("bigint")).over(run).alias("article"), F.coalesce(chapter, F.lit("Phần mở đầu")).alias("chapter"))
    body = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n"))
    parts = marked.groupBy("doc_id", "article").agg(F.min_by("chapter", "line_no").alias("chapter"), body.alias("body"), F.min_by("line", "line_no").alias("first"))
    number = F.coalesce(F.nullif(F.regexp_extract("first", "([0-9]+)", 1), F.lit("")), F.lit("0"))
    base = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.when(F.col("article") == 0, "_preamble").otherwise(F.concat(F.lit("_dieu_"), number)))
    named = parts.where("article > 0 or length(body) > 30").withColumn("base", base)
    again = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("article")) - 1
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("article") == 0, "article")).cast("bigint")
    chunk = F.concat("base", F.when(again > 0, F.concat(F.lit("_"), again.cast("string"))).otherwise(""))
    return named.select("doc_id", chunk.alias("chunk_id"), place.alias("place"), F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), "chapter", F.lit("\n"), "body").alias("text"))


def _packed_units(text: str, size: int) -> list[str]:
    """Units (paragraphs, lines that begin with a capital) packed while they fit; a longer unit is cut by sentences, then by blanks."""
    out, open_ = [], ""
    for unit in filter(None, (u.strip() for u in re.split(r"\n\s*\n|\n(?=[A-ZĐÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝĂƠƯ])", text))):
        if open_ and len(open_) + len(unit) + 2 > size:
            out, open_ = [*out, open_], ""
        if len(unit) <= size:
            open_ = f"{open_}\n\n{unit}".strip()
            continue
        for part in (p for sentence in re.split(r"(?<=[.!?;:])\s+", unit) for p in pieces_within(sentence, size)):
            if open_ and len(open_) + len(part) + 1 > size:
                out, open_ = [*out, open_], ""
            open_ = f"{open_} {part}".strip()
    return [*out, open_] if open_ else out


def unit_chunks(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, pos, text): every text's units packed to at most `size` characters. Null and blank texts have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lists = [_packed_units(t, size) for t in frame["text"]]
            owner = np.repeat(frame["doc_id"].to_numpy(), [len(x) for x in lists])
            yield pd.DataFrame({"doc_id": owner, "pos": np.array([i for x in lists for i in range(len(x))], np.int64), "text": np.array([c for x in lists for c in x], object)})

    return docs.where("text is not null").select("doc_id", "text").mapInPandas(run, "doc_id bigint, pos bigint, text string")


def level_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, block, path, n_lines, n_chars): one chunk for each heading of any level, block 0 before the first.

    path: the headings that hold there; a level holds only if it stands after the last heading of every higher level.
    """
    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    names = list(HEADINGS)
    hit = lines.select("*", *[F.when(F.col("line").rlike(HEADINGS[n]), F.struct((F.col("line_no") + 1).alias("at"), F.trim("line").alias("line"))).alias(n) for n in names])
    run = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    level = F.coalesce(*names).isNotNull()
    held = hit.select("doc_id", "line_no", "line", F.sum(level.cast("bigint")).over(run).alias("block"), *[F.last(n, ignorenulls=True).over(run).alias(n) for n in names])
    above = lambda i: [F.col(f"{names[i]}.at") > F.coalesce(F.col(f"{names[j]}.at"), F.lit(0)) for j in range(i)]
    kept = []
    for i, n in enumerate(names):
        holds = F.col(f"{n}.at").isNotNull()
        for rule in above(i):
            holds = holds & rule
        kept.append(F.when(holds, F.col(f"{n}.line")))
    path = F.array_join(F.array_compact(F.array(*kept)), " > ")
    return held.withColumn("path", path).groupBy("doc_id", "block").agg(F.min_by("path", "line_no").alias("path"), F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def parents(chunks: DataFrame) -> DataFrame:
    """(parent_id, source, page_start, page_end, children, chars): chunks of one parent put together, two characters between."""
    given = chunks.where("parent_id is not null and text is not null")
    return given.groupBy("parent_id").agg(
        F.min("source").alias("source"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"),
        F.count("*").alias("children"), (F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("chars"),
    )


def order_statistics(df: DataFrame, value: str) -> DataFrame:
    """(n, least, middle, p95, most) of an integer column: sorted[n // 2] and sorted[int(.95 n)], from counts by value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    packed = counts.agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("all"), F.sum("c").alias("n"))

    def nth(place):
        start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("v"))
        return F.aggregate("all", start, lambda a, x: F.struct((a["seen"] + x["c"]).alias("seen"), F.when(a["v"].isNull() & (a["seen"] + x["c"] > place), x["v"].cast("bigint")).otherwise(a["v"]).alias("v")), lambda a: a["v"])

    n = F.col("n")
    return packed.where("n is not null").select("n", nth(F.lit(0)).alias("least"), nth(F.floor(n / 2)).alias("middle"), nth(F.floor(n * 0.95)).alias("p95"), nth(n - 1).alias("most"))
