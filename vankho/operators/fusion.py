"""Rank fusion, reranking, gates and parents over lists of candidates (query_id, id, rank, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60


def _ranked(df: DataFrame, *order: Column, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("bigint"))


def reciprocal(lexical: DataFrame, dense: DataFrame, lexical_weight: float = 1.0, dense_weight: float = 1.0, k: int = K) -> DataFrame:
    """(query_id, id, bm25_rank, dense_rank, distance, rrf, fused_rank, matched_by) of two lists with `rank`.

    Ties go by the better rank, then the dense rank, the lexical rank and the id; a missing rank comes last.
    """
    a = lexical.select("query_id", "id", F.col("rank").alias("bm25_rank"))
    b = dense.select("query_id", "id", F.col("rank").alias("dense_rank"), "distance")
    both = a.join(b, ["query_id", "id"], "full_outer")
    part = lambda r, w: F.coalesce(F.lit(w) / (k + F.col(r)), F.lit(0.0))
    scored = both.withColumn("rrf", F.round(part("bm25_rank", lexical_weight) + part("dense_rank", dense_weight), 6)).withColumn(
        "matched_by", F.concat_ws("+", F.when(F.col("bm25_rank").isNotNull(), "bm25"), F.when(F.col("dense_rank").isNotNull(), "dense"))
    )
    best = F.least(F.coalesce("bm25_rank", F.lit(1 << 40)), F.coalesce("dense_rank", F.lit(1 << 40)))
    return _ranked(scored, F.desc("rrf"), best, F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), F.asc("id"), out="fused_rank")


def across_queries(lists: DataFrame, k: int = K, digits: int = 6) -> DataFrame:
    """(query_id, id, score, support, best_rank, rank): lists(query_id, variant, weight, id, rank) of the variants of a query fused.

    Order: score (rounded to `digits`), how many variants support the id, its best rank, id.
    """
    summed = lists.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), digits).alias("score"), F.count("*").alias("support"), F.min("rank").alias("best_rank"))
    return _ranked(summed, F.desc("score"), F.desc("support"), F.asc("best_rank"), F.asc("id"))


def rerank(candidates: DataFrame, score: Column, keep: int) -> DataFrame:
    """Candidates with rerank_score, rerank_rank and rank_change, the first `keep`; order: score, fused rank, id."""
    scored = candidates.withColumn("rerank_score", F.round(score, 4))
    ranked = _ranked(scored, F.desc("rerank_score"), F.asc_nulls_last("fused_rank"), F.asc("id"), out="rerank_rank")
    return ranked.withColumn("rank_change", F.col("fused_rank") - F.col("rerank_rank")).where(F.col("rerank_rank") <= keep)


def accepted(mode: str, distance: Column, score: Column, most: float = 0.45, least: float = 0.5) -> Column:
    """Evidence gate: dense by distance, rerank by score, the others by distance where there is one."""
    if mode == "dense":
        return F.coalesce(distance <= most, F.lit(False))
    if mode == "rerank":
        return F.coalesce(score >= least, F.lit(False))
    return F.coalesce(distance <= most, F.lit(True))


def status(accepted_count: Column, answer: Column) -> Column:
    """Status of a question by its accepted evidence and its answer, if there is one."""
    return F.when(accepted_count == 0, "insufficient_evidence").when(answer.isNotNull(), "answered").otherwise("retrieval_only")


def cited(df: DataFrame, answer: str, shown: str) -> DataFrame:
    """`df` with labels like [E1] in `answer` replaced by what the map `shown` holds for them, whatever their case.

    labels: the known labels in order of first use; unknown: how many different labels the map lacks. Those are dropped; blanks in a row
    become one.
    """
    found = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[([Ee][0-9]+)\]"), 1), lambda x: F.upper(x)))
    df = df.withColumn("_found", found)
    replaced = F.aggregate("_found", F.col(answer), lambda text, label: F.replace(F.replace(text, F.concat(F.lit("["), label, F.lit("]")), F.coalesce(F.try_element_at(shown, label), F.lit(""))), F.concat(F.lit("["), F.lower(label), F.lit("]")), F.coalesce(F.try_element_at(shown, label), F.lit(""))))
    known = F.filter("_found", lambda x: F.try_element_at(shown, x).isNotNull())
    return df.withColumns({answer: F.trim(F.regexp_replace(replaced, " +", " ")), "labels": known, "unknown": (F.size("_found") - F.size(known)).cast("bigint")}).drop("_found")


def parents_of(children: DataFrame, owner: DataFrame, best: int = 3, keep: int = 10, k: int = K) -> DataFrame:
    """(query_id, parent_id, score, children, best_rank, rank): a parent's score is that of its `best` children by rank.

    children: (query_id, id, rank), owner: (id, parent_id). Order: score, number of children, best rank, parent.
    """
    joined = children.join(owner, "id")
    placed = joined.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "parent_id").orderBy("rank", "id"))).where(F.col("place") <= best)
    summed = placed.groupBy("query_id", "parent_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 6).alias("score"), F.count("*").alias("children"), F.min("rank").alias("best_rank"))
    return _ranked(summed, F.desc("score"), F.desc("children"), F.asc("best_rank"), F.asc("parent_id")).where(F.col("rank") <= keep)


def within_budget(parents: DataFrame, budget: int) -> DataFrame:
    """`parents`(query_id, parent_id, rank, chars) that fit a budget of characters in order of rank: the first always, a later one if
    it still fits; one that does not is passed over. The fold runs over the few parents of a query."""
    listed = parents.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "parent_id", "chars"))).alias("all"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("kept"))
    fits = lambda a, x: (F.size(a["kept"]) == 0) | (a["used"] + x["chars"] <= budget)
    folded = F.aggregate(
        "all", start,
        lambda a, x: F.struct(F.when(fits(a, x), a["used"] + x["chars"]).otherwise(a["used"]).alias("used"), F.when(fits(a, x), F.concat(a["kept"], F.array(x["parent_id"]))).otherwise(a["kept"]).alias("kept")),
    )
    return listed.select("query_id", folded.alias("f")).select("query_id", "f.used", F.posexplode("f.kept").alias("place", "parent_id"))
