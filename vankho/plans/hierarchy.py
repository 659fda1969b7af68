"""Queries of text forms, chunk limits, hierarchy and parents, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vankho.functions import text as T
from vankho.operators import chunking, hierarchy
from vankho.plans.registry import registry
from vankho.plans.retrieval import _PLACED, _placed
from vankho.runtime import table

QUERIES, SQL, query = registry()

_re = lambda p: p.replace("(?iu)", "(?i)").replace("'", "''")


# text forms


@query(f"SELECT row_id, md5(regexp_replace(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), '{_re(T.CONTROL)}', '', 'g')) AS digest FROM raw_pages WHERE text IS NOT NULL")
def f_normal(spark: SparkSession, d: str) -> DataFrame:
    """composed letters, one form of line ends, no control characters."""
    return table(spark, d, "raw_pages").where("text is not null").select("row_id", F.md5(T.normal_text(F.col("text"))).alias("digest"))


@query("SELECT row_id, len(regexp_extract_all(lower(nfc_normalize(coalesce(text,''))), '([\\p{L}\\p{N}]+)')) AS n_a, len(regexp_extract_all(lower(nfc_normalize(coalesce(text,''))), '([\\p{L}\\p{N}_]+)')) AS n_b FROM raw_pages")
def f_tokens_composed(spark: SparkSession, d: str) -> DataFrame:
    """token counts after composition."""
    own = table(spark, d, "raw_pages").select("row_id", T.nfc(F.coalesce("text", F.lit(""))).alias("t"))
    return own.select("row_id", *[F.size(T.tokens(F.col("t"), k)).cast("bigint").alias(f"n_{k}") for k in "ab"])


def _first_sql(column: str, pattern: str, name: str) -> str:
    first = f"list_filter(string_split({column}, chr(10)), lambda x: regexp_matches(x, '{_re(pattern)}') AND NOT regexp_matches(x, '{_re(T.INLINE)}'))[1]"
    return f"CASE WHEN {first} IS NOT NULL THEN '{name} ' || regexp_extract({first}, '{_re(pattern)}', 1) END"


@query(f"SELECT doc_id, {_first_sql('text', T.CHAPTER_LINE, 'Chương')} AS chapter, {_first_sql('text', T.ARTICLE_LINE, 'Điều')} AS article FROM documents WHERE text IS NOT NULL")
def f_first_heading(spark: SparkSession, d: str) -> DataFrame:
    """F8: first chapter and first article heading, references within sentences left out."""
    text = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.first_heading(text, T.CHAPTER_LINE, "Chương").alias("chapter"), T.first_heading(text, T.ARTICLE_LINE, "Điều").alias("article"))


@query("SELECT row_id, " + ", ".join(f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text,''), '{_re(p)}', 1), lambda x: lower(x)))), ';') AS {k}" for k, p in T.LEGAL_PARTS.items()) + " FROM chunks")
def f_legal_parts(spark: SparkSession, d: str) -> DataFrame:
    """articles, clauses, points, circulars and years that a text names."""
    return table(spark, d, "chunks").select("row_id", *[F.array_join(T.legal_parts(F.col("text"), k), ";").alias(k) for k in T.LEGAL_PARTS])


@query("SELECT row_id, CASE WHEN length(text) <= 150 THEN text ELSE substr(text,1,100) || chr(10) || '...' || chr(10) || substr(text, length(text)-50+1, 50) END AS piece FROM chunks WHERE text IS NOT NULL")
def f_head_tail(spark: SparkSession, d: str) -> DataFrame:
    """F16: head and tail of a text."""
    return table(spark, d, "chunks").where("text is not null").select("row_id", T.head_tail(F.col("text"), 100, 50).alias("piece"))


_SPLIT = """WITH RECURSIVE given AS (SELECT row_id, trim(text, ' ') AS t FROM chunks WHERE text IS NOT NULL), s(row_id, pos, rest, piece) AS (SELECT row_id, CAST(0 AS BIGINT), t, CAST(NULL AS VARCHAR) FROM given UNION ALL
SELECT row_id, pos + 1, CASE WHEN length(rest) <= 120 THEN '' ELSE trim(substr(rest, cut + 1), ' ') END, CASE WHEN length(rest) <= 120 THEN rest ELSE trim(substr(rest, 1, cut), ' ') END FROM
(SELECT *, CASE WHEN strpos(reverse(substr(rest, 1, 121)), ' ') > 0 AND 121 - strpos(reverse(substr(rest, 1, 121)), ' ') > 0 THEN 121 - strpos(reverse(substr(rest, 1, 121)), ' ') ELSE 120 END AS cut FROM s) WHERE rest <> '') SELECT row_id, pos, piece FROM s WHERE piece IS NOT NULL"""


@query(_SPLIT)
def f_limit(spark: SparkSession, d: str) -> DataFrame:
    """pieces of at most 120 characters, cut at the last blank that fits, else hard."""
    pieces = table(spark, d, "chunks").where("text is not null").select("row_id", F.posexplode(T.within_limit(F.col("text"), 120)).alias("pos", "piece"))
    return pieces.select("row_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "piece")


@query("SELECT row_id, '[Nguồn: ' || source || ', tr. ' || CASE WHEN page_start = page_end THEN CAST(page_start AS VARCHAR) ELSE concat_ws('-', page_start, page_end) END || ', chunk: ' || chunk_id || ']' AS cited FROM chunks")
def f_source_citation(spark: SparkSession, d: str) -> DataFrame:
    """citation by source, pages and chunk."""
    return table(spark, d, "chunks").select("row_id", T.source_citation(F.col("source"), F.col("page_start"), F.col("page_end"), F.col("chunk_id")).alias("cited"))


@query("""SELECT row_id, regexp_replace(regexp_replace(title, '[\\\\/:*?"<>|\\s]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM metadata WHERE title IS NOT NULL""")
def f_file_name(spark: SparkSession, d: str) -> DataFrame:
    """titles as names of files."""
    return table(spark, d, "metadata").where("title is not null").select("row_id", T.file_name(F.col("title")).alias("name"))


@query("SELECT row_id, regexp_replace(text, '(?i)(tài sản)', '**\\1**', 'g') AS shown FROM chunks WHERE contains(lower(text), 'tài sản')")
def f_highlight(spark: SparkSession, d: str) -> DataFrame:
    """a searched text marked, whatever its case."""
    return table(spark, d, "chunks").where(F.contains(F.lower("text"), F.lit("tài sản"))).select("row_id", T.highlighted(F.col("text"), "tài sản").alias("shown"))


@query("SELECT row_id, substr(text, 1, 120) AS preview FROM chunks WHERE text IS NOT NULL")
def f_preview(spark: SparkSession, d: str) -> DataFrame:
    """the beginning of every chunk."""
    return table(spark, d, "chunks").where("text is not null").select("row_id", F.substring("text", 1, 120).alias("preview"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f_fenced(spark: SparkSession, d: str) -> DataFrame:
    """JSON out of a Markdown code fence, as models write it."""
    fenced = table(spark, d, "events").select("event_id", F.concat(F.lit("```json\n"), "props", F.lit("\n```\n")).alias("answer"))
    return fenced.select("event_id", F.from_json(T.unfenced(F.col("answer")), "k bigint")["k"].alias("k"))


@query("SELECT row_id, upper(substr(name, 1, 1)) || substr(name, 2) AS name FROM (SELECT row_id, trim(regexp_replace(regexp_replace(nfc_normalize(co_quan_ban_hanh), '^[\\s\"“”''.,;:]+|[\\s\"“”''.,;:]+$', '', 'g'), '\\s+', ' ', 'g')) AS name FROM metadata WHERE co_quan_ban_hanh IS NOT NULL)")
def f_entity_name(spark: SparkSession, d: str) -> DataFrame:
    """names without outer quotes and stops, one blank between words, first letter a capital."""
    bare = F.regexp_replace(T.nfc(F.col("co_quan_ban_hanh")), "^[\\s\"“”'.,;:]+|[\\s\"“”'.,;:]+$", "")
    named = table(spark, d, "metadata").where("co_quan_ban_hanh is not null").select("row_id", F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("name"))
    return named.select("row_id", F.concat(F.upper(F.substring("name", 1, 1)), F.substring("name", 2, 1_000_000)).alias("name"))


# chunks


@query("SELECT document_id, strategy, count(*) AS n, min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 2) AS mean FROM chunks WHERE text IS NOT NULL GROUP BY document_id, strategy")
def c_documents(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of chunks by document and strategy."""
    n = F.length("text")
    return table(spark, d, "chunks").where("text is not null").groupBy("document_id", "strategy").agg(F.count("*").alias("n"), F.min(n).cast("bigint").alias("least"), F.max(n).cast("bigint").alias("most"), F.round(F.avg(n), 2).alias("mean"))


@query()
def c_units(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs packed to 600 characters, longer ones cut by sentences and blanks."""
    return chunking.unit_chunks(table(spark, d, "documents"), 600)


_LEVELS = ["chapter", "section", "article", "clause", "point"]
_AT = ", ".join(f"max(CASE WHEN regexp_matches(line, '{T.HEADINGS[x]}') THEN line_no END) OVER w AS p{i}, last_value(CASE WHEN regexp_matches(line, '{T.HEADINGS[x]}') THEN trim(line, ' ') END IGNORE NULLS) OVER w AS l{i}" for i, x in enumerate(_LEVELS))
_KEPT = ", ".join(f"CASE WHEN {' AND '.join(['p%d IS NOT NULL' % i] + [f'p{i} > coalesce(p{j}, 0)' for j in range(i)])} THEN l{i} END" for i in range(5))
_ANY = " OR ".join(f"regexp_matches(line, '{T.HEADINGS[x]}')" for x in _LEVELS)


@query(
    f"""SELECT doc_id, block, min_by(path, line_no) AS path, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM (SELECT *, array_to_string(list_filter([{_KEPT}], lambda x: x IS NOT NULL), ' > ') AS path FROM (SELECT *, CAST(sum(CAST(({_ANY}) AS INT)) OVER w AS BIGINT) AS block, {_AT}
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) GROUP BY doc_id, block"""
)
def c_levels(spark: SparkSession, d: str) -> DataFrame:
    """A chunk for each heading of five levels, with its path; a heading resets the levels below it."""
    return chunking.level_chunks(table(spark, d, "documents"))


_CORPUS = """WITH lines AS (SELECT *, CAST(sum(CAST(regexp_matches(line, '^\\s*(?:ĐIỀU|Điều)\\s+[0-9]+') AS INT)) OVER w AS BIGINT) AS article, coalesce(last_value(CASE WHEN regexp_matches(line, '^\\s*(?:CHƯƠNG|Chương|PHẦN|Phần)\\s+[IVXLCDM0-9]+') THEN trim(line) END IGNORE NULLS) OVER w, 'Phần mở đầu') AS chapter
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
parts AS (SELECT doc_id, article, min_by(chapter, line_no) AS chapter, trim(string_agg(line, chr(10) ORDER BY line_no), ' ') AS body, coalesce(nullif(regexp_extract(min_by(line, line_no), '([0-9]+)', 1), ''), '0') AS number FROM lines GROUP BY doc_id, article),
named AS (SELECT *, CASE WHEN article = 0 THEN 'doc_' || doc_id || '_preamble' ELSE 'doc_' || doc_id || '_dieu_' || number END AS base FROM parts WHERE article > 0 OR length(body) > 30),
counted AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY article) - 1 AS again FROM named) SELECT doc_id, base || CASE WHEN again > 0 THEN '_' || again ELSE '' END AS chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY article = 0, article) AS place, md5('[' || doc_id || '] ' || chapter || chr(10) || body) AS digest FROM counted"""


@query(_CORPUS)
def c_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The text of every article with its document and chapter, the preamble last, repeated identifiers numbered."""
    return chunking.article_corpus(table(spark, d, "documents")).select("doc_id", "chunk_id", "place", F.md5("text").alias("digest"))


_PAGE = "row_id, structure.article AS head, text FROM chunks WHERE text IS NOT NULL AND structure.article IS NOT NULL"
_CLEAN = "trim(regexp_replace({}, '\\s+', ' ', 'g'), ' ')"


@query(f"SELECT row_id, place, type, tag, text FROM (SELECT row_id, 0 AS place, 'text' AS type, 'h2' AS tag, {_CLEAN.format('head')} AS text FROM (SELECT {_PAGE}) UNION ALL SELECT row_id, 1, 'text', 'p', {_CLEAN.format('text')} FROM (SELECT {_PAGE}) UNION ALL SELECT row_id, 2, 'table', 'table', 'Việt Nam | ' || CAST(row_id AS VARCHAR) FROM (SELECT {_PAGE}))")
def s_html(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of HTML pages: heading, paragraph, and a letterhead of one row."""
    from vankho.sources.files import html_blocks

    safe = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    head, text = safe(F.col("structure.article")), safe(F.col("text"))
    page = F.concat(F.lit("<html><style>p{}</style><div><h2>"), head, F.lit("</h2><p>"), text, F.lit("</p></div><table><tr><td>Việt Nam</td><td>"), F.col("row_id").cast("string"), F.lit("</td></tr></table></html>"))
    pages = table(spark, d, "chunks").where("text is not null and structure.article is not null").select("row_id", page.alias("html"))
    return html_blocks(pages, "html").select("row_id", "place", "type", "tag", "text")


# hierarchy and parents

_H = f"""placed AS (SELECT p.*, c.text FROM {_PLACED} p JOIN chunks c USING (row_id)), own AS (SELECT *, coalesce(nullif(trim(structure.chapter), ''), {_first_sql("coalesce(text, '')", T.CHAPTER_LINE, 'Chương')}) AS ch,
CASE WHEN nullif(trim(structure.article), '') IS NULL THEN NULL WHEN regexp_extract(structure.article, '(?:ĐIỀU|Điều|điều)?\\s*([0-9]+[a-z]?)', 1) <> '' THEN 'Điều ' || regexp_extract(structure.article, '(?:ĐIỀU|Điều|điều)?\\s*([0-9]+[a-z]?)', 1) ELSE trim(structure.article) END AS meta, {_first_sql("coalesce(text, '')", T.ARTICLE_LINE, 'Điều')} AS head FROM placed),
resolved AS (SELECT *, last_value(ch IGNORE NULLS) OVER w AS chapter, last_value(coalesce(meta, head) IGNORE NULLS) OVER w AS article FROM own WINDOW w AS (PARTITION BY document_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
told AS (SELECT *, CASE WHEN meta IS NOT NULL THEN 'metadata' WHEN head IS NOT NULL THEN 'heading_inferred' WHEN article IS NOT NULL THEN 'carried_forward' ELSE 'document_fallback' END AS method, article IS NULL OR coalesce(meta <> head, false) AS ambiguous FROM resolved)"""


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "chunks").select("row_id", "text", "page_start", "page_end")
    return hierarchy.resolve(_placed(spark, d).join(texts, "row_id"), "document_id", "place")


@query(f"WITH {_H} SELECT row_id, chapter, article, method, ambiguous FROM told")
def h_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """H1: chapter and article of every chunk, by metadata, heading, what stood before, or none."""
    return _resolved(spark, d).select("row_id", "chapter", "article", "method", "ambiguous")


_LASTHEAD = f"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_re(T.ARTICLE_LINE)}') AND NOT regexp_matches(x, '{_re(T.INLINE)}'))[-1]"


@query(
    f"""WITH {_H}, s AS (SELECT *, coalesce(meta, CASE WHEN regexp_matches(substr(coalesce(text, ''), 1, 400), '(?i)^[\\s\\S]{{0,5}}?điều\\s+[0-9]') THEN head END) AS now, coalesce(meta, CASE WHEN {_LASTHEAD} IS NOT NULL THEN 'Điều ' || regexp_extract({_LASTHEAD}, '{_re(T.ARTICLE_LINE)}', 1) END) AS after FROM told)
    SELECT row_id, coalesce(now, last_value(after IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS article, last_value(after IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS context FROM s"""
)
def h_from_start(spark: SparkSession, d: str) -> DataFrame:
    """H1': a heading within the text counts from the next chunk on."""
    texts = table(spark, d, "chunks").select("row_id", "text")
    return hierarchy.resolve_from_start(_placed(spark, d).join(texts, "row_id"), "document_id", "place").select("row_id", "article", "context")


_STEP = "lambda a, b: CASE WHEN a.used + 2 + b.used <= 900 THEN {'w': a.w, 'used': a.used + 2 + b.used} ELSE {'w': a.w + 1, 'used': b.used} END"


def _windows_sql(keys: str) -> str:
    listed = f"SELECT {keys}, list(row_id ORDER BY place) AS ids, list({{'w': 1::BIGINT, 'used': length(text)::BIGINT}} ORDER BY place) AS l FROM grouped GROUP BY {keys}"
    return f"packed AS (SELECT {keys}, unnest(ids) AS row_id, unnest(list_transform(range(1, len(l) + 1), lambda i: list_reduce(l[1:i], {_STEP}).w)) AS win FROM ({listed}))"


@query(
    f"""WITH {_H}, grouped AS (SELECT row_id, place, text, source, coalesce(article, 'document_fallback') AS article_key, page_start, page_end, ambiguous FROM told JOIN (SELECT row_id, page_start, page_end FROM chunks) USING (row_id) WHERE text IS NOT NULL AND source IS NOT NULL), {_windows_sql('source, article_key')}
    SELECT regexp_replace(source, '\\.[^.]*$', '') || ':' || CASE WHEN regexp_extract(article_key, '([0-9]+)', 1) = '' THEN 'doc_fallback' ELSE 'd' || lpad(regexp_extract(article_key, '([0-9]+)', 1), 2, '0') END || ':w' || lpad(CAST(win AS VARCHAR), 2, '0') AS parent_id, source, article_key, win AS window_index, count(*) AS children,
    CAST(min(page_start) AS BIGINT) AS page_start, CAST(max(page_end) AS BIGINT) AS page_end, CAST(sum(length(text)) + 2*(count(*)-1) AS BIGINT) AS chars, count(*) FILTER (ambiguous) AS ambiguous, count(*) = 1 AND sum(length(text)) > 900 AS oversized FROM grouped JOIN packed USING (row_id, source, article_key) GROUP BY source, article_key, win"""
)
def h_windows(spark: SparkSession, d: str) -> DataFrame:
    """H2: the children of an article packed into parents of bounded size, with stable ids."""
    rows = _resolved(spark, d).where("text is not null and source is not null").select("row_id", "source", "place", F.coalesce("article", F.lit("document_fallback")).alias("article_key"), F.length("text").cast("bigint").alias("chars"), "page_start", "page_end", "ambiguous")
    packed = hierarchy.parent_windows(rows, ["source", "article_key"], "place", 900)
    grouped = packed.groupBy("source", "article_key", "window").agg(
        F.count("*").alias("children"), F.min("page_start").cast("bigint").alias("page_start"), F.max("page_end").cast("bigint").alias("page_end"),
        (F.sum("chars") + 2 * (F.count("*") - 1)).alias("chars"), F.count_if("ambiguous").alias("ambiguous"),
    )
    number = F.when(F.length(F.col("window").cast("string")) < 2, F.lpad(F.col("window").cast("string"), 2, "0")).otherwise(F.col("window").cast("string"))
    parent = F.concat(F.regexp_replace("source", r"\.[^.]*$", ""), F.lit(":"), T.article_slug(F.col("article_key")), F.lit(":w"), number)
    return grouped.select(parent.alias("parent_id"), "source", "article_key", F.col("window").alias("window_index"), "children", "page_start", "page_end", "chars", "ambiguous", ((F.col("children") == 1) & (F.col("chars") > 900)).alias("oversized"))


@query(
    f"""WITH {_H}, marked AS (SELECT *, coalesce(article, '') AS article_key, CASE WHEN lag(coalesce(article, '')) OVER (PARTITION BY document_id ORDER BY place) = coalesce(article, '') THEN 0 ELSE 1 END AS fresh FROM told WHERE text IS NOT NULL), grouped AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY document_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM marked), {_windows_sql('document_id, run')}
    SELECT document_id, run, win AS window_index, any_value(article_key) AS article_key, count(*) AS children, CAST(sum(length(text)) + 2*(count(*)-1) AS BIGINT) AS chars FROM grouped JOIN packed USING (row_id, document_id, run) GROUP BY document_id, run, win"""
)
def h_runs(spark: SparkSession, d: str) -> DataFrame:
    """H2': only children that follow one another share a parent."""
    rows = _resolved(spark, d).where("text is not null").select("row_id", "document_id", "place", F.coalesce("article", F.lit("")).alias("article_key"), F.length("text").cast("bigint").alias("chars"))
    packed = hierarchy.parent_windows(hierarchy.runs(rows, "document_id", "place", "article_key"), ["document_id", "run"], "place", 900)
    return packed.groupBy("document_id", "run", F.col("window").alias("window_index")).agg(F.first("article_key").alias("article_key"), F.count("*").alias("children"), (F.sum("chars") + 2 * (F.count("*") - 1)).alias("chars"))


@query(f"WITH {_H} SELECT source, count(*) AS children, count(DISTINCT article) AS articles, " + ", ".join(f"count(*) FILTER (method = '{m}') AS {m}" for m in ("metadata", "heading_inferred", "carried_forward", "document_fallback")) + ", count(*) FILTER (ambiguous) AS ambiguous FROM told GROUP BY source")
def h_registry(spark: SparkSession, d: str) -> DataFrame:
    """H4: the registry's counts by source."""
    methods = ("metadata", "heading_inferred", "carried_forward", "document_fallback")
    return _resolved(spark, d).groupBy("source").agg(F.count("*").alias("children"), F.count_distinct("article").alias("articles"), *[F.count_if(F.col("method") == m).alias(m) for m in methods], F.count_if("ambiguous").alias("ambiguous"))


@query("SELECT row_id, md5(CASE WHEN structure.article IS NULL OR structure.article = text THEN text ELSE structure.article || chr(10) || text END) AS digest FROM chunks WHERE text IS NOT NULL")
def k_headed(spark: SparkSession, d: str) -> DataFrame:
    """K8: what is embedded: the heading, then the text, unless they are equal."""
    head = F.col("structure.article")
    return table(spark, d, "chunks").where("text is not null").select("row_id", F.md5(F.when(head.isNull() | (head == F.col("text")), F.col("text")).otherwise(F.concat(head, F.lit("\n"), "text"))).alias("digest"))
