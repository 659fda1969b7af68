"""Queries of search modes, evidence, citations, parents and their evaluation, with DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vankho.functions.text import tokens
from vankho.operators import chunking, fusion
from vankho.operators.lexical import bm25
from vankho.plans.registry import registry
from vankho.plans.retrieval import _PARENTS, _RERANK, _RRF, _XPAR, _bm25_sql, _corpus, _hybrid, _nearest, _parents, _questions, _reranked, _VARIANTS
from vankho.runtime import cut, table

QUERIES, SQL, query = registry()

MODES = ["bm25", "dense", "hybrid", "rerank"]


def search(spark: SparkSession, d: str, mode: str, k: int = 5) -> DataFrame:
    """(query_id, id, rank) of the k best chunks of every question by one of MODES."""
    if mode == "bm25":
        return bm25(_corpus(spark, d), _questions(spark, d), k).select("query_id", "id", "rank")
    if mode == "dense":
        return _nearest(spark, d, k, _questions(spark, d)).select("query_id", "id", "rank")
    if mode == "hybrid":
        return _hybrid(spark, d).where(F.col("fused_rank") <= k).select("query_id", "id", F.col("fused_rank").alias("rank"))
    if mode == "rerank":
        return _reranked(spark, d, k).select("query_id", "id", F.col("rerank_rank").alias("rank"))
    raise ValueError(f"mode {mode!r} is none of {MODES}")


_MODES = f"""{_RERANK}, modes AS (SELECT 'bm25' AS mode, query_id, id, rank FROM lex WHERE rank <= 5 UNION ALL SELECT 'dense', query_id, id, rank FROM dn WHERE rank <= 5 UNION ALL SELECT 'hybrid', query_id, id, fused_rank FROM fused WHERE fused_rank <= 5 UNION ALL SELECT 'rerank', query_id, id, rerank_rank FROM rr WHERE rerank_rank <= 5)"""


def _compared(spark: SparkSession, d: str) -> DataFrame:
    """All modes one above the other; the lists that the fused modes are made of are searched once."""
    lexical = cut(bm25(_corpus(spark, d), _questions(spark, d), 20))
    dense = cut(_nearest(spark, d, 20, _questions(spark, d)))
    fused = cut(fusion.reciprocal(lexical, dense))
    asked = _questions(spark, d).select("query_id", F.array_distinct(tokens(F.col("text"))).alias("qt"))
    texts = table(spark, d, "chunks").select(F.col("row_id").alias("id"), "text")
    score = F.coalesce(F.size(F.array_intersect("qt", tokens(F.col("text")))), F.lit(0)) / F.greatest(F.size("qt"), F.lit(1))
    reranked = fusion.rerank(fused.where("fused_rank <= 20").join(asked, "query_id").join(texts, "id", "left"), score, 5)
    lists = {"bm25": lexical, "dense": dense, "hybrid": fused.withColumnRenamed("fused_rank", "rank"), "rerank": reranked.withColumnRenamed("rerank_rank", "rank")}
    return reduce(DataFrame.unionAll, [df.where("rank <= 5").select(F.lit(m).alias("mode"), "query_id", "id", "rank") for m, df in lists.items()])


@query(f"WITH {_MODES} SELECT mode, query_id, id, rank FROM modes")
def x_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The results of every mode side by side."""
    return _compared(spark, d)


@query(f"WITH {_MODES} SELECT query_id, id, " + ", ".join(f"max(CASE WHEN mode = '{m}' THEN rank END) AS {m}" for m in MODES) + ", count(*) AS modes, max(CASE WHEN mode = 'hybrid' THEN rank END) - max(CASE WHEN mode = 'rerank' THEN rank END) AS rank_change FROM modes GROUP BY query_id, id")
def u_ranks(spark: SparkSession, d: str) -> DataFrame:
    """A chunk's rank in each mode, and how many modes have it."""
    own = lambda m: F.max(F.when(F.col("mode") == m, F.col("rank")))
    return _compared(spark, d).groupBy("query_id", "id").agg(*[own(m).alias(m) for m in MODES], F.count("*").alias("modes")).withColumn("rank_change", F.col("hybrid") - F.col("rerank"))


_GOLD = f"""{_MODES}, judged AS (SELECT m.*, q.question_type, list_contains(q.relevant_parent_ids, c.parent_id) AS rel FROM modes m JOIN questions q ON q.row_id = m.query_id LEFT JOIN chunks c ON c.row_id = m.id),
each AS (SELECT mode, query_id, any_value(question_type) AS question_type, min(CASE WHEN rel THEN rank END) AS first FROM judged GROUP BY mode, query_id)"""


@query(f"WITH {_GOLD} SELECT mode, question_type, count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN first <= {k} THEN 1.0 ELSE 0.0 END), 4) AS hit{k}" for k in (1, 3, 5)) + ", round(avg(coalesce(1.0/first, 0)), 4) AS mrr FROM each GROUP BY GROUPING SETS ((mode), (question_type, mode))")
def m_modes(spark: SparkSession, d: str) -> DataFrame:
    """M7, M9: hits at 1, 3 and 5 and reciprocal rank by mode, and by kind of question and mode; chunks of a relevant parent are relevant."""
    gold = table(spark, d, "questions").select(F.col("row_id").alias("query_id"), "question_type", "relevant_parent_ids")
    owner = table(spark, d, "chunks").select(F.col("row_id").alias("id"), "parent_id")
    judged = _compared(spark, d).join(gold, "query_id").join(owner, "id", "left").withColumn("rel", F.array_contains("relevant_parent_ids", F.col("parent_id")))
    each = cut(judged.groupBy("mode", "query_id").agg(F.first("question_type").alias("question_type"), F.min(F.when(F.col("rel"), F.col("rank"))).alias("first")))
    hits = [F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 4).alias(f"hit{k}") for k in (1, 3, 5)]
    return each.groupingSets([["mode"], ["question_type", "mode"]], "mode", "question_type").agg(F.count("*").alias("n"), *hits, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))


_EMPTY = f"""{_XPAR}, listed AS (SELECT q.row_id AS query_id, q.question_type, list_distinct(list_filter(coalesce(q.relevant_parent_ids, []), lambda x: x IS NOT NULL)) AS gold, (SELECT list(parent_id ORDER BY rank) FROM pr WHERE pr.query_id = q.row_id AND rank <= 5) AS got FROM questions q WHERE row_id % 20 = 0 AND question IS NOT NULL),
measured AS (SELECT query_id, question_type, len(gold) AS gold, CASE WHEN len(gold) = 0 THEN CASE WHEN got IS NULL THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(coalesce(got, []), gold))/CAST(len(gold) AS DOUBLE) END AS recall,
CASE WHEN len(gold) = 0 THEN CASE WHEN got IS NULL THEN 1.0 ELSE 0.0 END ELSE coalesce(1.0/list_min(list_filter(list_transform(range(1, len(got)+1), lambda i: CASE WHEN list_contains(gold, got[i]) THEN i END), lambda x: x IS NOT NULL)), 0) END AS mrr FROM listed)"""


def _parent_metrics(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions").where("row_id % 20 = 0 and question is not null")
    gold = F.array_distinct(F.array_compact(F.coalesce("relevant_parent_ids", F.array().cast("array<string>"))))
    asked = q.select(F.col("row_id").alias("query_id"), "question_type", gold.alias("wanted"))
    got = _parents(spark, d).where("rank <= 5").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "parent_id"))), lambda x: x["parent_id"]).alias("got"))
    j = asked.join(got, "query_id", "left")
    none = F.when(F.col("got").isNull(), 1.0).otherwise(0.0)
    place = F.array_min(F.filter(F.transform("got", lambda x, i: F.when(F.array_contains("wanted", x), i + 1)), lambda x: x.isNotNull()))
    recall = F.when(F.size("wanted") == 0, none).otherwise(F.coalesce(F.size(F.array_intersect("got", "wanted")), F.lit(0)) / F.size("wanted"))
    return j.select("query_id", "question_type", F.size("wanted").cast("bigint").alias("gold"), recall.alias("recall"), F.when(F.size("wanted") == 0, none).otherwise(F.coalesce(1 / place, F.lit(0.0))).alias("mrr"))


@query(f"WITH {_EMPTY} SELECT query_id, gold, round(recall, 6) AS recall, round(CAST(mrr AS DOUBLE), 6) AS mrr FROM measured")
def m_empty_gold(spark: SparkSession, d: str) -> DataFrame:
    """M6: recall and reciprocal rank of parents; a question without gold is right if nothing was found."""
    return _parent_metrics(spark, d).select("query_id", "gold", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@query(f"WITH {_EMPTY} SELECT question_type, count(*) AS n, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr FROM measured GROUP BY question_type")
def m_hierarchical(spark: SparkSession, d: str) -> DataFrame:
    """M8: parent recall and reciprocal rank by kind of question."""
    return _parent_metrics(spark, d).groupBy("question_type").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("mrr"), 4).alias("mrr"))


# fusion variants


@query(f"WITH {_RRF}, plain AS (SELECT query_id, id, bm25_rank, dense_rank, coalesce(1.0/(60+bm25_rank),0.0)+coalesce(1.0/(60+dense_rank),0.0) AS s FROM fused) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(CAST(s AS DOUBLE), 12) DESC, bm25_rank NULLS LAST, dense_rank NULLS LAST, id) AS rank FROM plain")
def r_plain(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal ranks, ordered by score alone; equal scores stay in the order of the lexical list, then the dense one."""
    part = lambda r: F.coalesce(1 / (60 + F.col(r)), F.lit(0.0))
    scored = _hybrid(spark, d).withColumn("s", F.round(part("bm25_rank") + part("dense_rank"), 12))
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("dense_rank"), "id")
    return scored.select("query_id", "id", F.row_number().over(order).cast("bigint").alias("rank"))


@query(f"WITH {_VARIANTS.replace('), 6) AS score', '), 8) AS score')} SELECT query_id, id, score, support, best_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, support DESC, best_rank, id) AS rank FROM cross_q")
def r_rounded(spark: SparkSession, d: str) -> DataFrame:
    """R4': as the fusion of variants, with eight digits before sorting."""
    weight = F.when(F.col("query_id") % 100 == 0, 1.5).otherwise(1.0)
    lists = _nearest(spark, d, 10).select(F.floor(F.col("query_id") / 100).alias("query_id"), F.col("query_id").alias("variant"), weight.alias("weight"), "id", "rank")
    return fusion.across_queries(lists, digits=8)


@query(
    f"""WITH {_RRF}, lists AS (SELECT query_id // 100 AS query_id, CASE WHEN query_id % 100 = 0 THEN 1.5 ELSE 1.0 END AS weight, id, fused_rank AS rank FROM fused WHERE fused_rank <= 10), cross_q AS (SELECT query_id, id, round(sum(CAST(weight AS DOUBLE)/(60+rank)), 6) AS score, count(*) AS support, min(rank) AS best_rank FROM lists GROUP BY query_id, id)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, support DESC, best_rank, id) AS rank FROM cross_q"""
)
def r_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Every variant of a question through the hybrid search, in one job, then fused."""
    weight = F.when(F.col("query_id") % 100 == 0, 1.5).otherwise(1.0)
    lists = _hybrid(spark, d).where("fused_rank <= 10").select(F.floor(F.col("query_id") / 100).alias("query_id"), F.col("query_id").alias("variant"), weight.alias("weight"), "id", F.col("fused_rank").alias("rank"))
    return fusion.across_queries(lists)


@query(f"WITH {_RRF} SELECT id, " + ", ".join(f"max(CASE WHEN query_id % 100 = {v} THEN fused_rank END) AS q{v}" for v in range(0, 100, 20)) + " FROM fused WHERE fused_rank <= 10 GROUP BY id")
def u_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Rank of every chunk under each variant of the questions."""
    own = lambda v: F.max(F.when(F.col("query_id") % 100 == v, F.col("fused_rank")))
    return _hybrid(spark, d).where("fused_rank <= 10").groupBy("id").agg(*[own(v).alias(f"q{v}") for v in range(0, 100, 20)])


# evidence and answers


@query(f"WITH {_RERANK} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS rank, fused_rank - row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS rank_shift FROM rr")
def x_rerank_score(spark: SparkSession, d: str) -> DataFrame:
    """X2': order by score alone, then id; the shift against the fused rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "id")
    ranked = _reranked(spark, d, 20).withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.select("query_id", "id", "rank", (F.coalesce("fused_rank", F.lit(999)) - F.col("rank")).alias("rank_shift"))


@query(
    f"""WITH {_RERANK} SELECT query_id, mode, count(*) FILTER (ok) AS accepted, CASE WHEN count(*) FILTER (ok) = 0 THEN 'insufficient_evidence' WHEN any_value(notes) IS NOT NULL THEN 'answered' ELSE 'retrieval_only' END AS status FROM (
    SELECT query_id, mode, CASE mode WHEN 'dense' THEN coalesce(distance <= 0.45, false) WHEN 'rerank' THEN rerank_score >= 0.5 ELSE coalesce(distance <= 0.45, true) END AS ok FROM rr, (SELECT unnest(['dense', 'rerank', 'hybrid']) AS mode) WHERE rerank_rank <= 5) JOIN (SELECT row_id AS query_id, notes FROM questions) USING (query_id) GROUP BY query_id, mode"""
)
def x_status(spark: SparkSession, d: str) -> DataFrame:
    """Accepted evidence by the gate of each mode, and the status that follows; a question's notes are its answer."""
    gates = F.array(*[F.struct(F.lit(m).alias("mode"), fusion.accepted(m, F.col("distance"), F.col("rerank_score")).alias("ok")) for m in ("dense", "rerank", "hybrid")])
    counted = _reranked(spark, d, 5).select("query_id", F.inline(gates)).groupBy("query_id", "mode").agg(F.count_if("ok").alias("accepted"))
    notes = table(spark, d, "questions").select(F.col("row_id").alias("query_id"), "notes")
    return counted.join(notes, "query_id").select("query_id", "mode", "accepted", fusion.status(F.col("accepted"), F.col("notes")).alias("status"))


_EVIDENCE = f"{_bm25_sql(3)}, ev AS (SELECT query_id, 'E' || rank AS label, rank, c.source, c.chunk_id, '[Nguồn: ' || c.source || ', tr. ' || CASE WHEN c.page_start = c.page_end THEN CAST(c.page_start AS VARCHAR) ELSE concat_ws('-', c.page_start, c.page_end) END || ', chunk: ' || c.chunk_id || ']' AS display, c.text FROM lex JOIN chunks c ON c.row_id = lex.id)"


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    from vankho.functions.text import source_citation

    c = table(spark, d, "chunks")
    rows = c.select(F.col("row_id").alias("id"), source_citation(F.col("source"), F.col("page_start"), F.col("page_end"), F.col("chunk_id")).alias("display"), "text")
    return bm25(_corpus(spark, d), _questions(spark, d), 3).join(rows, "id").select("query_id", F.concat(F.lit("E"), F.col("rank").cast("string")).alias("label"), "rank", "display", "text")


@query(f"WITH {_EVIDENCE} SELECT query_id, md5(string_agg('[' || label || '] ' || coalesce(display, '') || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS digest FROM ev GROUP BY query_id")
def x_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of every question as one text, each piece with its label and citation."""
    piece = F.concat(F.lit("["), F.col("label"), F.lit("] "), F.coalesce("display", F.lit("")), F.lit("\n"), F.col("text"))
    listed = _evidence(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", piece.alias("piece")))).alias("all"))
    return listed.select("query_id", F.md5(F.array_join(F.transform("all", lambda x: x["piece"]), "\n\n")).alias("digest"))


@query(
    f"""WITH {_EVIDENCE}, shown AS (SELECT query_id, map(list(label ORDER BY rank), list(display ORDER BY rank)) AS m FROM ev GROUP BY query_id), answers AS (SELECT row_id AS query_id, question || ' [E1] và [e2],  rồi [E9] [E1]' AS answer FROM questions)
    SELECT query_id, trim(regexp_replace(replace(replace(replace(replace(answer, '[E1]', coalesce(m['E1'], '')), '[e2]', coalesce(m['E2'], '')), '[E9]', ''), '[E3]', ''), ' +', ' ', 'g')) AS answer, array_to_string(list_filter(['E1', 'E2'], lambda x: m[x] IS NOT NULL), ',') AS labels, 3 - len(list_filter(['E1', 'E2'], lambda x: m[x] IS NOT NULL)) AS unknown FROM answers JOIN shown USING (query_id)"""
)
def x_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of an answer replaced by what they cite, unknown ones dropped and counted, each citation once in order of use."""
    shown = _evidence(spark, d).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "display"))).alias("m"))
    answer = table(spark, d, "questions").select(F.col("row_id").alias("query_id"), F.concat("question", F.lit(" [E1] và [e2],  rồi [E9] [E1]")).alias("answer"))
    return fusion.cited(answer.join(shown, "query_id"), "answer", "m").select("query_id", "answer", F.array_join("labels", ",").alias("labels"), "unknown")


# parents


@query(
    f"""WITH {_XPAR}, sizes AS (SELECT parent_id, chars FROM {_PARENTS}), l AS (SELECT query_id, list({{'used': 0::BIGINT, 'kept': [{{'p': parent_id, 'c': chars}}]}} ORDER BY rank) AS all_ FROM pr JOIN sizes USING (parent_id) WHERE rank <= 10 GROUP BY query_id),
    f AS (SELECT query_id, list_reduce(list_prepend({{'used': 0::BIGINT, 'kept': []::STRUCT(p VARCHAR, c BIGINT)[]}}, all_), lambda a, b: CASE WHEN len(a.kept) = 0 OR a.used + b.kept[1].c <= 2500 THEN {{'used': a.used + b.kept[1].c, 'kept': list_append(a.kept, b.kept[1])}} ELSE a END) AS r FROM l)
    SELECT query_id, r.used AS used, generate_subscripts(r.kept, 1) - 1 AS place, unnest(list_transform(r.kept, lambda x: x.p)) AS parent_id, r.kept[1].c > 2500 AS oversize FROM f"""
)
def x_budget_warned(spark: SparkSession, d: str) -> DataFrame:
    """X11: parents that fit the budget; a first one that alone is larger stays, with a warning."""
    sizes = chunking.parents(table(spark, d, "chunks")).select("parent_id", F.col("chars").cast("bigint").alias("chars"))
    ranked = cut(_parents(spark, d).join(sizes, "parent_id"))
    kept = fusion.within_budget(ranked, 2500)
    first = ranked.groupBy("query_id").agg((F.min_by("chars", "rank") > 2500).alias("oversize"))
    return kept.join(first, "query_id").select("query_id", "used", F.col("place").cast("bigint").alias("place"), "parent_id", "oversize")


@query(f"WITH {_XPAR}, sizes AS (SELECT parent_id, chars FROM {_PARENTS}) SELECT query_id, round(sum(p.chars)/CAST(any_value(k.chars) AS DOUBLE), 2) AS factor FROM (SELECT query_id, chars FROM pr JOIN sizes USING (parent_id) WHERE rank <= 10) p JOIN (SELECT query_id, sum(length(text)) AS chars FROM lex JOIN chunks c ON c.row_id = lex.id GROUP BY query_id) k USING (query_id) GROUP BY query_id")
def x_factor(spark: SparkSession, d: str) -> DataFrame:
    """How many times longer the parents are than the children that led to them."""
    sizes = chunking.parents(table(spark, d, "chunks")).select("parent_id", "chars")
    texts = table(spark, d, "chunks").select(F.col("row_id").alias("id"), F.length("text").alias("n"))
    found = cut(bm25(_corpus(spark, d), _questions(spark, d), 20).select("query_id", "id", "rank"))
    children = found.join(texts, "id").groupBy("query_id").agg(F.sum("n").alias("n"))
    whole = _parents(spark, d, found).join(sizes, "parent_id").groupBy("query_id").agg(F.sum("chars").alias("chars"))
    return whole.join(children, "query_id").select("query_id", F.round(F.col("chars") / F.col("n"), 2).alias("factor"))


_PTOK = "regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)')"


@query(
    f"""WITH {_XPAR}, pt AS (SELECT parent_id, list_distinct(flatten(list({_PTOK}))) AS t FROM chunks WHERE parent_id IN (SELECT parent_id FROM pr WHERE rank <= 10) AND text IS NOT NULL GROUP BY parent_id), s AS (SELECT pr.query_id, pr.parent_id, pr.rank AS parent_rank, round(len(list_intersect(list_distinct({_PTOK.replace('text', 'q.question')}), pt.t))/CAST(greatest(len(list_distinct({_PTOK.replace('text', 'q.question')})), 1) AS DOUBLE), 4) AS score FROM pr JOIN pt USING (parent_id) JOIN questions q ON q.row_id = pr.query_id WHERE pr.rank <= 10)
    SELECT query_id, parent_id, score, rank, score >= 0.5 AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_rank, parent_id) AS rank FROM s) WHERE rank <= 3"""
)
def x_parent_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Parents reranked on the question itself, the first three, accepted and rejected."""
    asked = _questions(spark, d).select("query_id", F.array_distinct(tokens(F.col("text"))).alias("qt"))
    ranked = cut(_parents(spark, d))
    words = table(spark, d, "chunks").where("text is not null").join(ranked.select("parent_id").distinct(), "parent_id", "left_semi").select("parent_id", F.explode(tokens(F.col("text"))).alias("t")).distinct()
    held = ranked.join(asked.select("query_id", F.explode("qt").alias("t")), "query_id").join(words, ["parent_id", "t"]).groupBy("query_id", "parent_id").agg(F.count("*").alias("n"))
    scored = ranked.join(asked.select("query_id", F.size("qt").alias("size")), "query_id").join(held, ["query_id", "parent_id"], "left")
    scored = scored.withColumn("score2", F.round(F.coalesce("n", F.lit(0)) / F.greatest("size", F.lit(1)), 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("score2"), "rank", "parent_id")
    top = scored.withColumn("place", F.row_number().over(order).cast("bigint")).where("place <= 3")
    return top.select("query_id", "parent_id", F.col("score2").alias("score"), F.col("place").alias("rank"), (F.col("score2") >= 0.5).alias("accepted"))


@query("SELECT md5(text) AS digest, count(DISTINCT parent_id) AS parents, count(*) AS children FROM chunks WHERE parent_id IS NOT NULL AND text IS NOT NULL GROUP BY md5(text) HAVING count(DISTINCT parent_id) > 1")
def x_shared_children(spark: SparkSession, d: str) -> DataFrame:
    """X10': texts that stand under more than one parent, which aggregation to parents takes for an error."""
    c = table(spark, d, "chunks").where("parent_id is not null and text is not null")
    return c.groupBy(F.md5("text").alias("digest")).agg(F.count_distinct("parent_id").alias("parents"), F.count("*").alias("children")).where("parents > 1")
