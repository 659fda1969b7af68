"""Queries of chunking, retrieval, fusion, reranking and evaluation, with DuckDB SQL.

Search queries are every row whose id is divisible by 20, against all rows. A question's dense query vector is the embedding with its
row_id; the embedding of a chunk is the one with the chunk's row_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vankho.functions.text import LEGAL_TOKEN, tokens
from vankho.operators import chunking, fusion
from vankho.operators.dense import cosine_top
from vankho.operators.lexical import bm25, bm25_every
from vankho.operators.ordered import earliest, following, forward_fill
from vankho.plans.registry import registry
from vankho.runtime import cut, table

QUERIES, SQL, query = registry()


# chunking

_FIXED = """SELECT doc_id, i AS pos, i*480 AS start, i*480 + CASE WHEN i*480+600 < n AND contains(piece,' ') AND length(piece) - strpos(reverse(piece),' ') > 300 THEN length(piece) - strpos(reverse(piece),' ') ELSE length(piece) END AS "end"
FROM (SELECT doc_id, n, i, substr(text, i*480+1, 600) AS piece FROM (SELECT doc_id, text, length(text) AS n, unnest(generate_series(0, greatest(CAST(ceil((length(text)-600)/480.0) AS BIGINT), 0))) AS i FROM documents WHERE text IS NOT NULL AND text <> ''))"""


@query(_FIXED)
def c_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Fixed windows cut back to a blank."""
    return chunking.fixed_size(table(spark, d, "documents"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "raw_pages").where("text is not null").select("row_id", "source", F.col("page_number").alias("page"), F.length("text").alias("chars"))
    return earliest(pages, ["source", "page"], ["row_id"]).select("source", "page", "chars")


_PAGES = "pages AS (SELECT source, page_number AS page, min_by(length(text), row_id) AS chars FROM raw_pages WHERE text IS NOT NULL GROUP BY ALL), placed AS (SELECT *, coalesce(sum(chars+2) OVER (PARTITION BY source ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM pages)"


@query(
    f"""WITH {_PAGES}, total AS (SELECT source, sum(chars+2)-2 AS n FROM pages GROUP BY source), slices AS (SELECT source, n, unnest(generate_series(0, CAST((n-1)//480 AS BIGINT))) AS pos FROM total WHERE n > 0),
    cut AS (SELECT source, pos, pos*480 AS start, least(pos*480+600, n)-1 AS stop FROM slices)
    SELECT c.source, c.pos, CAST(c.start AS BIGINT) AS start, CAST(p.page AS BIGINT) AS page_start, CAST(q.page AS BIGINT) AS page_end FROM cut c JOIN placed p ON p.source=c.source AND c.start >= p.b AND c.start < p.b+p.chars+2 JOIN placed q ON q.source=c.source AND c.stop >= q.b AND c.stop < q.b+q.chars+2"""
)
def c_slices(spark: SparkSession, d: str) -> DataFrame:
    """Plain slices with the pages they lie on."""
    return chunking.page_slices(_pages(spark, d))


_SENTENCES = """SELECT doc_id, unnest(chunks) AS text, CAST(generate_subscripts(chunks, 1) - 1 AS INTEGER) AS pos FROM (SELECT doc_id, CASE WHEN r.open = '' THEN r.done ELSE list_append(r.done, r.open) END AS chunks FROM (SELECT doc_id, list_reduce(list_prepend({'done': []::VARCHAR[], 'open': '', 'n': 0::BIGINT}, list_transform(s, lambda x: {'done': []::VARCHAR[], 'open': x, 'n': length(x)})),
lambda a, b: CASE WHEN a.n + b.n > 800 AND a.n >= 150 THEN {'done': list_append(a.done, a.open), 'open': b.open, 'n': b.n} ELSE {'done': a.done, 'open': CASE WHEN a.open = '' THEN b.open ELSE a.open || ' ' || b.open END, 'n': a.n + b.n} END) AS r
FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+([\\p{Lu}0-9])', '\\1' || chr(57360) || '\\2', 'g'), '\\n{2,}', chr(57360), 'g'), chr(57360)), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL)))"""


@query(_SENTENCES)
def c_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Greedy packing of sentences."""
    return chunking.sentence_chunks(table(spark, d, "documents"))


_ARTICLES = """SELECT doc_id, article, min_by(line, line_no) AS heading, coalesce(min_by(chapter, line_no), 'Phần mở đầu') AS chapter, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM
(SELECT *, CAST(sum(CAST(regexp_matches(line, '^\\s*(?:ĐIỀU|Điều)\\s+[0-9]+') AS INT)) OVER w AS BIGINT) AS article, last_value(CASE WHEN regexp_matches(line, '^\\s*(?:CHƯƠNG|Chương|PHẦN|Phần)\\s+[IVXLCDM0-9]+') THEN trim(line) END IGNORE NULLS) OVER w AS chapter
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY doc_id, article"""


@query(_ARTICLES)
def c_articles(spark: SparkSession, d: str) -> DataFrame:
    """One chunk per article, with its chapter."""
    return chunking.article_chunks(table(spark, d, "documents"))


_PLACED = "(SELECT row_id, document_id, chunk_id, source, structure, parent_id, coalesce(try_cast(nullif(regexp_extract(structure.article, '([0-9]+)', 1), '') AS BIGINT), 0) * 1000000 + row_id % 1000000 AS place FROM chunks WHERE document_id IS NOT NULL)"


#: More than any row_id, so that a place orders by article number, then row_id; the SQL above wraps at 1,000,000 rows and agrees below.
ROWS = 1 << 36


def _placed(spark: SparkSession, d: str) -> DataFrame:
    number = F.coalesce(F.regexp_extract("structure.article", "([0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    return table(spark, d, "chunks").where("document_id is not null").select("row_id", "document_id", "chunk_id", "source", "structure", "parent_id", (number * ROWS + F.col("row_id")).alias("place"))


@query(f"SELECT row_id AS src, nxt AS dst FROM (SELECT row_id, lead(row_id) OVER (PARTITION BY document_id ORDER BY place) AS nxt FROM {_PLACED}) WHERE nxt IS NOT NULL")
def c_next(spark: SparkSession, d: str) -> DataFrame:
    """NEXT edges between consecutive chunks of a document."""
    return following(_placed(spark, d), ["document_id"], "place", "row_id", "dst").where("dst is not null").select(F.col("row_id").alias("src"), "dst")


@query("SELECT strategy, count(*) AS n, min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 2) AS mean FROM chunks WHERE text IS NOT NULL GROUP BY strategy")
def c_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of chunks by strategy."""
    n = F.length("text")
    return table(spark, d, "chunks").where("text is not null").groupBy("strategy").agg(F.count("*").alias("n"), F.min(n).cast("bigint").alias("least"), F.max(n).cast("bigint").alias("most"), F.round(F.avg(n), 2).alias("mean"))


@query(
    f"""SELECT row_id, last_value(structure.chapter IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter,
    CASE WHEN structure.chapter IS NOT NULL THEN 'metadata' WHEN last_value(structure.chapter IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) IS NOT NULL THEN 'carried' ELSE 'fallback' END AS method FROM {_PLACED}"""
)
def h_resolve(spark: SparkSession, d: str) -> DataFrame:
    """H1: chapter from the chunk itself, else carried forward, else none."""
    rows = _placed(spark, d).withColumn("own", F.col("structure.chapter"))
    filled = forward_fill(rows, ["document_id"], "place", "own", "chapter")
    return filled.select("row_id", "chapter", F.when(F.col("own").isNotNull(), "metadata").when(F.col("chapter").isNotNull(), "carried").otherwise("fallback").alias("method"))


_PARENTS = "(SELECT parent_id, min(source) AS source, CAST(min(page_start) AS BIGINT) AS page_start, CAST(max(page_end) AS BIGINT) AS page_end, count(*) AS children, CAST(sum(length(text)) + 2*(count(*)-1) AS BIGINT) AS chars FROM chunks WHERE parent_id IS NOT NULL AND text IS NOT NULL GROUP BY parent_id)"


@query(f"SELECT * FROM {_PARENTS}")
def h_parents(spark: SparkSession, d: str) -> DataFrame:
    """Parents of chunks."""
    return chunking.parents(table(spark, d, "chunks")).withColumns({c: F.col(c).cast("bigint") for c in ("page_start", "page_end", "chars")})


@query(f"WITH s AS (SELECT list_sort(list(chars)) AS l FROM {_PARENTS}) SELECT CAST(len(l) AS BIGINT) AS n, l[1] AS least, l[len(l)//2+1] AS middle, l[CAST(floor(len(l)*0.95) AS BIGINT)+1] AS p95, l[len(l)] AS most FROM s")
def h_sizes(spark: SparkSession, d: str) -> DataFrame:
    """H3: order statistics of parent sizes."""
    return chunking.order_statistics(chunking.parents(table(spark, d, "chunks")), "chars")


# lexical and dense retrieval

_LEGAL = f"list_filter(list_transform(regexp_extract_all(lower(text), '{LEGAL_TOKEN}'), lambda x: regexp_replace(x, '^[/._\\-]+|[/._\\-]+$', '', 'g')), lambda x: x <> '')"
_TOKENS = {"c": _LEGAL, "a": "regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)')", "b": "regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]+)')"}


def _bm25_sql(k: int, kind: str = "a") -> str:
    t = _TOKENS[kind]
    return f"""corpus AS (SELECT row_id AS id, {t} AS t FROM chunks WHERE text IS NOT NULL AND deleted_at IS NULL), post AS (SELECT id, term, max(l) AS l, count(*) AS tf FROM (SELECT id, len(t) AS l, unnest(t) AS term FROM corpus) GROUP BY id, term),
    size AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM corpus), raw AS (SELECT term, ln((docs - df + 0.5)/(df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), size),
    idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw), asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT row_id AS query_id, unnest({t.replace('text', 'question')}) AS term FROM questions WHERE row_id % 20 = 0 AND question IS NOT NULL) GROUP BY ALL),
    scored AS (SELECT query_id, id, round(sum(times*idf*tf*2.5/(tf+1.5*(0.25+0.75*l/mean))), 4) AS score FROM asked JOIN idf USING (term) JOIN post USING (term), size GROUP BY query_id, id),
    lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= {k})"""


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("text is not null and deleted_at is null").select(F.col("row_id").alias("id"), "text")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").where("row_id % 20 = 0 and question is not null").select(F.col("row_id").alias("query_id"), F.col("question").alias("text"))


@query(f"WITH {_bm25_sql(10)} SELECT query_id, id, score, rank FROM lex")
def l_bm25(spark: SparkSession, d: str) -> DataFrame:
    """L1: BM25, tokens of letters and digits."""
    return bm25(_corpus(spark, d), _questions(spark, d))


_EVERY = f"""{_bm25_sql(10).replace(', 4) AS score', ', 10) AS score')}, every AS (SELECT DISTINCT a.query_id, c.id FROM asked a, corpus c), full_ AS (SELECT e.query_id, e.id, coalesce(s.score, 0) AS score FROM every e LEFT JOIN scored s ON s.query_id = e.query_id AND s.id = e.id)"""


@query(f"WITH {_EVERY} SELECT query_id, id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM full_) WHERE rank <= 10")
def l_bm25_every(spark: SparkSession, d: str) -> DataFrame:
    """L1: ordered by unrounded scores, documents without a query term last with score 0."""
    return bm25_every(_corpus(spark, d), _questions(spark, d))


@query(f"WITH {_bm25_sql(20, 'b')} SELECT query_id, id, score, rank FROM lex")
def l_bm25_words(spark: SparkSession, d: str) -> DataFrame:
    """L2: BM25, tokens with underscores, twenty results."""
    return bm25(_corpus(spark, d), _questions(spark, d), 20, "b")


@query(f"WITH {_bm25_sql(5, 'c')} SELECT query_id, id, score, rank FROM lex")
def l_bm25_legal(spark: SparkSession, d: str) -> DataFrame:
    """L3: BM25, whole document numbers as tokens, five results."""
    return bm25(_corpus(spark, d), _questions(spark, d), 5, "c")


def _cosine_sql(k: int) -> str:
    return f"""vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x*x))) AS n FROM embeddings),
    near AS (SELECT q.id AS query_id, c.id, round(1 - list_dot_product(q.v, c.v)/(q.n*c.n), 6) + 0.0 AS distance FROM vec q, vec c WHERE q.id % 20 = 0),
    den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM near) WHERE rank <= {k})"""


def _nearest(spark: SparkSession, d: str, k: int, asked: DataFrame | None = None) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = vectors.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    return cosine_top(vectors, queries if asked is None else queries.join(asked.select("query_id"), "query_id", "left_semi"), k)


@query(f"WITH {_cosine_sql(10)} SELECT query_id, id, distance, rank FROM den")
def k_cosine(spark: SparkSession, d: str) -> DataFrame:
    """K1-K3: nearest rows by cosine distance."""
    return _nearest(spark, d, 10)


@query(f"WITH {_cosine_sql(10)} SELECT query_id, den.id, distance, label FROM den JOIN embeddings e ON e.vec_id = den.id WHERE distance <= 0.7")
def k_threshold(spark: SparkSession, d: str) -> DataFrame:
    """K4: the nearest first, then a threshold, then what belongs to them."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return _nearest(spark, d, 10).where("distance <= 0.7").join(labels, "id").select("query_id", "id", "distance", "label")


@query("SELECT q.row_id AS query_id, q.pos, c.row_id AS id, c.page_start FROM (SELECT row_id, unnest(relevant_child_ids) AS chunk_id, generate_subscripts(relevant_child_ids, 1) AS pos FROM questions) q JOIN chunks c USING (chunk_id)")
def k_fetch(spark: SparkSession, d: str) -> DataFrame:
    """K5: rows by a list of identifiers, with the place in the list."""
    q = table(spark, d, "questions").select(F.col("row_id").alias("query_id"), F.posexplode("relevant_child_ids").alias("pos", "chunk_id"))
    c = table(spark, d, "chunks").select("chunk_id", F.col("row_id").alias("id"), "page_start")
    return q.join(c, "chunk_id").select("query_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "id", "page_start")


@query("SELECT label, round(avg(s), 4) AS mean FROM (SELECT label, v[1]/n AS s FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x*x))) AS n FROM embeddings) WHERE n > 1e-9) GROUP BY label")
def k_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of length 1, zero vectors left out."""
    from vankho.functions.text import normalised

    e = table(spark, d, "embeddings").select("label", normalised(F.col("embedding")).alias("v")).where("v is not null")
    return e.groupBy("label").agg(F.round(F.avg(F.get("v", F.lit(0))), 4).alias("mean"))


@query("SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE vec_id % 2 = 0) GROUP BY label, pos")
def k_pooled(spark: SparkSession, d: str) -> DataFrame:
    """masked mean pooling: the mean of each component over the rows under the mask (even ids), by label."""
    masked = table(spark, d, "embeddings").where("vec_id % 2 = 0").select("label", F.posexplode("embedding").alias("pos", "v"))
    return masked.groupBy("label", "pos").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


# fusion, rerank, gate, parents

_RRF = f"""{_bm25_sql(20)}, {_cosine_sql(20)}, dn AS (SELECT * FROM den WHERE query_id IN (SELECT row_id FROM questions WHERE question IS NOT NULL)),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, least(coalesce(bm25_rank, 1099511627776), coalesce(dense_rank, 1099511627776)), dense_rank NULLS LAST, bm25_rank NULLS LAST, id) AS fused_rank FROM
(SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.rank AS bm25_rank, b.rank AS dense_rank, b.distance, round(coalesce(1.0/(60+a.rank),0)+coalesce(1.0/(60+b.rank),0), 6) AS rrf,
concat_ws('+', CASE WHEN a.rank IS NOT NULL THEN 'bm25' END, CASE WHEN b.rank IS NOT NULL THEN 'dense' END) AS matched_by FROM lex a FULL JOIN dn b ON a.query_id=b.query_id AND a.id=b.id))"""


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    lexical = bm25(_corpus(spark, d), _questions(spark, d), 20)
    dense = _nearest(spark, d, 20, _questions(spark, d))
    return fusion.reciprocal(lexical, dense)


@query(f"WITH {_RRF} SELECT query_id, id, bm25_rank, dense_rank, distance, CAST(rrf AS DOUBLE) AS rrf, matched_by, fused_rank FROM fused")
def r_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and dense lists fused by reciprocal ranks."""
    return _hybrid(spark, d).select("query_id", "id", "bm25_rank", "dense_rank", "distance", "rrf", "matched_by", "fused_rank")


_VARIANTS = f"""{_cosine_sql(10)}, lists AS (SELECT query_id // 100 AS query_id, query_id AS variant, CASE WHEN query_id % 100 = 0 THEN 1.5 ELSE 1.0 END AS weight, id, rank FROM den),
cross_q AS (SELECT query_id, id, round(sum(CAST(weight AS DOUBLE)/(60+rank)), 6) AS score, count(*) AS support, min(rank) AS best_rank FROM lists GROUP BY query_id, id)"""


@query(f"WITH {_VARIANTS} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, support DESC, best_rank, id) AS rank FROM cross_q")
def r_across(spark: SparkSession, d: str) -> DataFrame:
    """Lists of a question's variants fused, the question itself weighing half as much again."""
    lists = _nearest(spark, d, 10).select(
        F.floor(F.col("query_id") / 100).alias("query_id"), F.col("query_id").alias("variant"), F.when(F.col("query_id") % 100 == 0, 1.5).otherwise(1.0).alias("weight"), "id", "rank"
    )
    return fusion.across_queries(lists)


_RERANK = f"""{_RRF}, texts AS (SELECT f.*, list_distinct(regexp_extract_all(lower(q.question), '([\\p{{L}}\\p{{N}}]+)')) AS qt, list_distinct(regexp_extract_all(lower(coalesce(c.text,'')), '([\\p{{L}}\\p{{N}}]+)')) AS ct FROM fused f JOIN questions q ON q.row_id = f.query_id LEFT JOIN chunks c ON c.row_id = f.id WHERE fused_rank <= 20),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank, id) AS rerank_rank FROM (SELECT query_id, id, fused_rank, distance, round(len(list_intersect(qt, ct))/CAST(greatest(len(qt), 1) AS DOUBLE), 4) AS rerank_score FROM texts))"""


def _reranked(spark: SparkSession, d: str, keep: int) -> DataFrame:
    """Candidates reranked by the share of question tokens that a chunk has; a model's score takes the place of that expression."""
    asked = _questions(spark, d).select("query_id", F.array_distinct(tokens(F.col("text"))).alias("qt"))
    texts = table(spark, d, "chunks").select(F.col("row_id").alias("id"), "text")
    c = _hybrid(spark, d).where("fused_rank <= 20").join(asked, "query_id").join(texts, "id", "left")
    score = F.coalesce(F.size(F.array_intersect("qt", tokens(F.col("text")))), F.lit(0)) / F.greatest(F.size("qt"), F.lit(1))
    return fusion.rerank(c, score, keep)


@query(f"WITH {_RERANK} SELECT query_id, id, fused_rank, rerank_score, rerank_rank, fused_rank - rerank_rank AS rank_change FROM rr WHERE rerank_rank <= 5")
def x_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The first candidates by a pair score."""
    return _reranked(spark, d, 5).select("query_id", "id", "fused_rank", "rerank_score", "rerank_rank", "rank_change")


@query(f"WITH {_RERANK} SELECT query_id, count(*) FILTER (rerank_score >= 0.5) AS good, CASE WHEN count(*) FILTER (rerank_score >= 0.5) = 0 THEN 'insufficient_evidence' ELSE 'retrieval_only' END AS status FROM rr WHERE rerank_rank <= 5 GROUP BY query_id")
def x_gate(spark: SparkSession, d: str) -> DataFrame:
    """Accepted evidence and status of each question."""
    ok = fusion.accepted("rerank", F.col("distance"), F.col("rerank_score"))
    counted = _reranked(spark, d, 5).groupBy("query_id").agg(F.count_if(ok).alias("good"))
    return counted.withColumn("status", F.when(F.col("good") == 0, "insufficient_evidence").otherwise("retrieval_only"))


_XPAR = f"""{_bm25_sql(20)}, pc AS (SELECT l.query_id, c.parent_id, l.rank, l.id, row_number() OVER (PARTITION BY l.query_id, c.parent_id ORDER BY l.rank, l.id) AS p FROM lex l JOIN chunks c ON c.row_id = l.id WHERE c.parent_id IS NOT NULL),
ps AS (SELECT query_id, parent_id, round(sum(1.0/(60+rank)), 6) AS score, count(*) AS children, min(rank) AS best_rank FROM pc WHERE p <= 3 GROUP BY ALL), pr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, children DESC, best_rank, parent_id) AS rank FROM ps)"""


def _parents(spark: SparkSession, d: str, children: DataFrame | None = None) -> DataFrame:
    """Parents of `children`(query_id, id, rank), by default the twenty best of every question."""
    owner = table(spark, d, "chunks").where("parent_id is not null").select(F.col("row_id").alias("id"), "parent_id")
    return fusion.parents_of(bm25(_corpus(spark, d), _questions(spark, d), 20) if children is None else children, owner)


@query(f"WITH {_XPAR} SELECT query_id, parent_id, CAST(score AS DOUBLE) AS score, children, best_rank, rank FROM pr WHERE rank <= 10")
def x_parents(spark: SparkSession, d: str) -> DataFrame:
    """Parents by their best children."""
    return _parents(spark, d)


_BUDGET = f"""WITH {_XPAR}, sizes AS (SELECT parent_id, chars FROM {_PARENTS}), l AS (SELECT query_id, list({{'used': 0::BIGINT, 'kept': [{{'p': parent_id, 'c': chars}}]}} ORDER BY rank) AS all_ FROM pr JOIN sizes USING (parent_id) WHERE rank <= 10 GROUP BY query_id),
f AS (SELECT query_id, list_reduce(list_prepend({{'used': 0::BIGINT, 'kept': []::STRUCT(p VARCHAR, c BIGINT)[]}}, all_), lambda a, b: CASE WHEN len(a.kept) = 0 OR a.used + b.kept[1].c <= 2500 THEN {{'used': a.used + b.kept[1].c, 'kept': list_append(a.kept, b.kept[1])}} ELSE a END) AS r FROM l)
SELECT query_id, r.used AS used, CAST(generate_subscripts(r.kept, 1) - 1 AS INTEGER) AS place, unnest(list_transform(r.kept, lambda x: x.p)) AS parent_id FROM f"""


@query(_BUDGET)
def x_budget(spark: SparkSession, d: str) -> DataFrame:
    """X11: parents that fit the context budget."""
    sizes = chunking.parents(table(spark, d, "chunks")).select("parent_id", F.col("chars").cast("bigint").alias("chars"))
    return fusion.within_budget(_parents(spark, d).join(sizes, "parent_id"), 2500)


@query("""SELECT row_id, pos, label, coalesce(place, '(unknown)') AS shown FROM (SELECT row_id, unnest(list_distinct(regexp_extract_all(evidence, '([0-9]{1,4}(?:/[0-9A-ZĐ_a-zđ.\\-]+)+)'))) AS label, 1 AS pos FROM relation_candidates WHERE evidence IS NOT NULL) a LEFT JOIN (SELECT so_ky_hieu, min(id) AS place FROM metadata GROUP BY 1) m ON m.so_ky_hieu = a.label""")
def x_citations(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a text mapped to what they cite, unknown ones marked."""
    from vankho.functions.text import doc_numbers

    labels = table(spark, d, "relation_candidates").where("evidence is not null").select("row_id", F.explode(F.array_distinct(doc_numbers(F.col("evidence")))).alias("label"))
    known = table(spark, d, "metadata").groupBy(F.col("so_ky_hieu").alias("label")).agg(F.min("id").alias("place"))
    return labels.join(known, "label", "left").select("row_id", F.lit(1).alias("pos"), "label", F.coalesce("place", F.lit("(unknown)")).alias("shown"))


@query("SELECT min(row_id) AS row_id, k AS key, count(*) AS n FROM (SELECT row_id, trim(regexp_replace(lower(question), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS k FROM questions WHERE question IS NOT NULL AND length(question) <= 300) WHERE k <> '' GROUP BY k")
def x_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Query variants cleaned, long ones and repeats dropped, the first kept."""
    from vankho.functions.text import dedup_key

    q = table(spark, d, "questions").where("question is not null and length(question) <= 300").select("row_id", dedup_key(F.col("question")).alias("key")).where("key <> ''")
    return q.groupBy("key").agg(F.min("row_id").alias("row_id"), F.count("*").alias("n")).select("row_id", "key", "n")


# evaluation

_GOLD = "gold AS (SELECT q.vec_id AS query_id, c.vec_id AS id FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)"
_SIZES = "sizes AS (SELECT q.vec_id AS query_id, q.label, n - 1 AS gold FROM embeddings q JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label) WHERE q.vec_id % 20 = 0)"
_HITS = f"{_cosine_sql(11)}, {_SIZES}, hits AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, den.id) AS rank, CAST(e.label = s.label AS INT) AS rel, s.label, s.gold FROM den JOIN embeddings e ON e.vec_id = den.id JOIN sizes s USING (query_id) WHERE den.id <> query_id)"
_METRICS = f"""{_HITS}, metrics AS (SELECT query_id, any_value(label) AS label, max(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS hit5, round(coalesce(1.0/min(CASE WHEN rel = 1 THEN rank END), 0), 6) AS rr, round(sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END)/10.0, 6) AS p10,
round(sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END)/CAST(any_value(gold) AS DOUBLE), 6) AS r10, round(sum(CASE WHEN rank <= 10 THEN rel/log2(rank+1) ELSE 0 END)/list_sum(list_transform(generate_series(1, least(any_value(gold), 10)), lambda i: 1/log2(i+1))), 6) AS ndcg10 FROM hits GROUP BY query_id)"""


def _measured(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label")
    near = _nearest(spark, d, 11).where("id <> query_id").drop("rank")
    from pyspark.sql import Window

    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    gold = e.groupBy("label").agg((F.count("*") - 1).alias("gold"))
    asked = e.join(gold, "label").select(F.col("vec_id").alias("query_id"), "label", "gold")
    hits = ranked.join(asked, "query_id").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("other")), "id").withColumn("rel", (F.col("label") == F.col("other")).cast("int"))
    top = lambda x: F.when(F.col("rank") <= 10, x).otherwise(0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("gold", F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return hits.groupBy("query_id", "label", "gold").agg(
        F.max(F.when(F.col("rank") <= 5, F.col("rel")).otherwise(0)).alias("hit5"), F.coalesce(F.round(1 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), 6), F.lit(0.0)).alias("rr"),
        F.round(F.sum(top(F.col("rel"))) / 10, 6).alias("p10"), F.sum(top(F.col("rel"))).alias("found"), F.sum(top(F.col("rel") / F.log2(F.col("rank") + 1))).alias("dcg"),
    ).select("query_id", "label", "hit5", "rr", "p10", F.round(F.col("found") / F.col("gold"), 6).alias("r10"), F.round(F.col("dcg") / ideal, 6).alias("ndcg10"))


@query(f"WITH {_METRICS} SELECT query_id, label, hit5, CAST(rr AS DOUBLE) AS rr, CAST(p10 AS DOUBLE) AS p10, r10, ndcg10 FROM metrics")
def m_metrics(spark: SparkSession, d: str) -> DataFrame:
    """M1-M6: hit, reciprocal rank, precision, recall and nDCG of every query; rows of the same label are relevant."""
    return _measured(spark, d)


@query(f"WITH {_METRICS} SELECT label, count(*) AS n, round(avg(hit5), 4) AS hit5, round(avg(rr), 4) AS mrr, round(avg(ndcg10), 4) AS ndcg10, round(median(r10), 4) AS middle FROM metrics GROUP BY GROUPING SETS ((label), ())")
def m_summary(spark: SparkSession, d: str) -> DataFrame:
    """M7-M9: means by label and over all, in one pass of grouping sets."""
    m = cut(_measured(spark, d))
    grouped = m.groupingSets([[F.col("label")], []], F.col("label"))
    return grouped.agg(F.count("*").alias("n"), F.round(F.avg("hit5"), 4).alias("hit5"), F.round(F.avg("rr"), 4).alias("mrr"), F.round(F.avg("ndcg10"), 4).alias("ndcg10"), F.round(F.median("r10"), 4).alias("middle"))


@query("SELECT usecase, difficulty, count(*) AS n, round(avg(length(ground_truth)), 4) AS mean, count(*) FILTER (coalesce(length(ground_truth),0) < 50) AS low FROM qa_dataset GROUP BY usecase, difficulty")
def m_scores(spark: SparkSession, d: str) -> DataFrame:
    """Means by usecase and difficulty; nulls stay nulls."""
    n = F.length("ground_truth")
    return table(spark, d, "qa_dataset").groupBy("usecase", "difficulty").agg(F.count("*").alias("n"), F.round(F.avg(n), 4).alias("mean"), F.count_if(F.coalesce(n, F.lit(0)) < 50).alias("low"))
