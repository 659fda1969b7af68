"""Readers and writers of the pipeline's files."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CHUNK = "chunk_id string, strategy string, source string, page_start int, page_end int, text string, structure struct<chapter:string,section:string,article:string,clause:string,point:string>"


def read_chunks(spark: SparkSession, path: str, strategy: str | None = None) -> DataFrame:
    """Chunks of JSON files that hold a list or {"chunks": [...]}, with file and place in it; the strategy filter comes first.

    Files that are no JSON give no row. Chunks without an id, and ids met more than once, stay in: `chunk_error` and a count by id
    tell them.
    """
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), "value")
    row = f"struct<{_struct(_CHUNK)}>"
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{row}>")).otherwise(F.from_json("value", f"struct<chunks:array<{row}>>")["chunks"])
    rows = whole.select("file", F.posexplode(listed).alias("place", "c")).select("file", (F.col("place") + 1).alias("place"), "c.*")
    return rows if strategy is None else rows.where(F.col("strategy") == strategy)


def _struct(ddl: str) -> str:
    return ",".join(f"{name}:{kind}" for name, kind in (field.strip().split(" ", 1) for field in ddl.split(", ")))


def read_table_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column as text; quoted line ends and a byte order mark are no trouble."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit events, one JSON object a line; malformed lines are left out, and fields that look like secrets."""
    df = spark.read.json(path, mode="DROPMALFORMED")
    return df.drop(*[c for c in df.columns if any(w in c.lower() for w in ("secret", "password", "api_key"))])


def append_audit(events: DataFrame, path: str) -> None:
    """Events appended as JSON lines."""
    events.write.mode("append").json(path)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, bytes) of every file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def status(df: DataFrame) -> DataFrame:
    """(rows, sources) of a collection, without making one."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct("source").alias("sources"))


#: What the first row of a letterhead holds.
LETTERHEAD = ("CỘNG HÒA", "VIỆT NAM")


class _Blocks(HTMLParser):
    """Block elements in order: headings, paragraphs and divisions without blocks of their own; tables as rows of cells."""

    _BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str, str]] = []
        self.open: list[list] = []
        self.rows: list[list[str]] | None = None
        self.depth = 0
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.rows = []
                for o in self.open:
                    o[2] = True
        elif self.depth:
            if tag == "tr" and self.depth == 1:
                self.rows.append([])
            elif tag in ("td", "th") and self.depth == 1:
                if not self.rows:
                    self.rows.append([])
                self.rows[-1].append("")
        elif tag in self._BLOCKS:
            for o in self.open:
                o[2] = True
            self.open.append([tag, "", False])

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth and self.rows is not None:
                rows = [[" ".join(c.split()) for c in r] for r in self.rows if r]
                # a few rows that begin with two cells and the country's name are the letterhead, not a table
                head = 0 < len(rows) <= 3 and len(rows[0]) == 2 and any(w in " ".join(rows[0]).upper() for w in LETTERHEAD)
                lines = [" | ".join(c for c in r if c) if head else "| " + " | ".join(r) + " |" for r in rows]
                if lines and not head:
                    lines.insert(1, "|" + " --- |" * len(self.rows[0]))
                if lines:
                    self.out.append(("table", "table", "\n".join(lines)))
                self.rows = None
        elif not self.depth and tag in self._BLOCKS:
            while self.open:
                name, text, parted = self.open.pop()
                text = " ".join(text.split())
                if text and not (parted and name == "div"):
                    self.out.append(("text", name, text))
                if name == tag:
                    break

    def handle_data(self, data):
        if self.skip:
            return
        if self.depth:
            if self.rows and self.rows[-1]:
                self.rows[-1][-1] += data
        elif self.open:
            self.open[-1][1] += data


def _html_blocks(html: str | None) -> list[dict]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    while parser.open:
        parser.handle_endtag(parser.open[-1][0])
    return [{"type": a, "tag": b, "text": c} for a, b, c in parser.out]


def html_blocks(df: DataFrame, column: str) -> DataFrame:
    """Rows of `df` for each block of its HTML, with place, type, tag and text; null and empty HTML give none."""

    @F.pandas_udf("array<struct<type:string,tag:string,text:string>>")
    def blocks(html: pd.Series) -> pd.Series:
        return html.map(_html_blocks)

    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.posexplode(blocks(F.col(column))).alias("place", "_b")).select(*kept, "place", "_b.*")


def publish(df: DataFrame, folder: str, version: str, good: Column | None = None) -> str:
    """Writes a version beside the earlier ones; readers follow a pointer that is set only when all files are there.

    With a condition `good`, nothing is written unless every row meets it.
    """
    if good is not None and not df.where(~F.coalesce(good, F.lit(False))).isEmpty():
        raise ValueError("some rows break the contract; nothing was written")
    path = f"{folder}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    pointer = df.sparkSession.createDataFrame([(version,)], "version string")
    pointer.coalesce(1).write.mode("overwrite").text(f"{folder}/_current")
    return path


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The version that the pointer names."""
    version = spark.read.text(f"{folder}/_current").collect()[0].value
    return spark.read.parquet(f"{folder}/version={version}")


def published_rows(spark: SparkSession, folder: str, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the current version by a table of identifiers; unknown ones give none."""
    return published(spark, folder).join(ids.select(key).distinct(), key, "left_semi")


def uncached(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows whose key the cache does not hold yet."""
    return df.join(cache.select(key).distinct(), key, "left_anti")


def export_report(df: DataFrame, folder: str, title: str, shown: int = 100) -> None:
    """CSV of all rows, and a Markdown page with the first `shown` of them as a table."""
    df.write.mode("overwrite").csv(f"{folder}/csv", header=True)
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[|\r\n]+", " ")
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    rows = [r.line for r in df.limit(shown).select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("line")).collect()]
    df.sparkSession.createDataFrame([("\n".join([*head, *rows]),)], "text string").coalesce(1).write.mode("overwrite").text(f"{folder}/markdown")
