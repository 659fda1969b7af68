"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vankho.llm.canonical import not_canonical
from vankho.llm.leakage import find_leaks
from vankho.llm.names import variants
from vankho.llm.packing import fill, pack
from vankho.llm.residue import residue_documents
from vankho.llm.scans import continuous, noise_lines, repaired
from vankho.runtime import table

#: Table and text column of problem 5.
TEXTS = [("metadata", "title"), ("relation_candidates", "evidence"), ("raw_pages", "text")]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(*[table(spark, sf_dir, t) for t in ("metadata", "relation_candidates", "issuing_bodies")])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise_lines(table(spark, sf_dir, "raw_pages"))


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every page without noise, in paragraphs."""
    return repaired(table(spark, sf_dir, "raw_pages"))


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that go on over the ends of pages."""
    return continuous(table(spark, sf_dir, "raw_pages"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [not_canonical(table(spark, sf_dir, t), c).select(F.lit(t).alias("source_table"), "row_id") for t, c in TEXTS]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's container."""
    return pack(table(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are, by shard."""
    return fill(pack(table(spark, sf_dir, "documents")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged spans to remove."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), spans=True)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_documents(table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_text": p4_text, "p4_paragraphs": p4_paragraphs, "p5_found": p5_found, "p6_pack": p6_pack, "p6_fill": p6_fill, "p7_found": p7_found, "p7_spans": p7_spans, "p8_found": p8_found}
SQL: dict[str, str] = {}
