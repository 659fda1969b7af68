"""Queries of the dealt general problems: packed fields (2) and orphan references (3)."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vankho.functions.docnum import issuers, with_number_key
from vankho.functions.marks import is_missing
from vankho.operators.orphans import in_stretches, pending_snapshots
from vankho.operators.packed import unpack
from vankho.runtime import cut, table

#: Table, field, and whether its values may stand in square brackets.
PACKED_FIELDS = [
    ("agribank_internal_policies", "allowed_roles", False),
    ("audit_log", "retrieved_chunk_ids", False),
    ("audit_log", "citation_ids", True),
    ("qa_dataset", "allowed_roles", False),
]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        unpack(table(spark, sf_dir, name), field, bracketed).select(F.lit(name).alias("source_table"), F.lit(field).alias("field_name"), "row_id", "pos", "item_value")
        for name, field, bracketed in PACKED_FIELDS
    ]
    return reduce(DataFrame.unionAll, parts)


def reference_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(references, parents) of all three relationships; keys carry the target field's name so that they cannot meet."""
    known = issuers(table(spark, sf_dir, "issuing_bodies"))
    tagged = lambda name, c: F.coalesce(F.concat(F.lit(name + ":"), c), F.lit(""))
    plain = lambda c: F.trim(F.col(c))
    relations, qa, questions = (table(spark, sf_dir, t) for t in ("relation_candidates", "qa_dataset", "questions"))
    metadata, chunks = table(spark, sf_dir, "metadata"), table(spark, sf_dir, "chunks")
    numbers = relations.select("row_id", F.col("target_so_ky_hieu").alias("ref_key"), F.col("extracted_at").alias("at")).where(~is_missing(F.col("ref_key")))
    listed = questions.select("row_id", F.explode_outer(F.array_distinct("relevant_parent_ids")).alias("ref_key"), F.col("created_at").alias("at"))
    columns = lambda name, key: [F.lit(name).alias("source_table"), "row_id", "ref_key", "at", key.alias("key")]
    asked = [
        with_number_key(numbers, "ref_key", known).select(*columns("relation_candidates", tagged("number", F.col("key")))),
        qa.select("row_id", F.col("source_chunk_id").alias("ref_key"), F.col("created_at").alias("at")).where(~is_missing(F.col("ref_key"))).select(*columns("qa_dataset", tagged("chunk", plain("ref_key")))),
        listed.where(~is_missing(F.col("ref_key"))).select(*columns("questions", tagged("parent", plain("ref_key")))),
    ]
    life = ["loaded_at", "deleted_at"]
    held = [
        with_number_key(metadata.select("so_ky_hieu", *life).where("so_ky_hieu is not null"), "so_ky_hieu", known).select(tagged("number", F.col("key")).alias("key"), *life),
        chunks.select(tagged("chunk", plain("chunk_id")).alias("key"), *life),
        chunks.where(~is_missing(F.col("parent_id"))).select(tagged("parent", plain("parent_id")).alias("key"), *life),
    ]
    references = reduce(DataFrame.unionByName, asked)
    return references, reduce(DataFrame.unionByName, held)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans of the whole history, advanced as state by key from year to year."""
    references, parents = (cut(df) for df in reference_tables(spark, sf_dir))
    # a handful of years: the state is written at the end of each
    span = references.agg(F.min(F.year("at")).alias("a"), F.max(F.year("at")).alias("z")).first()
    starts = [datetime(year, 1, 1) for year in range(span.a + 1, span.z + 1)] if span.a else []
    return in_stretches(references, parents, starts)[0].select("source_table", F.date_format("at", "yyyy-MM").alias("period"), "row_id", "ref_key")


def p3_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans that came up and orphans that wait, per table and month."""
    references, parents = reference_tables(spark, sf_dir)
    return pending_snapshots(references, parents)


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_snapshots": p3_snapshots}
SQL: dict[str, str] = {}
