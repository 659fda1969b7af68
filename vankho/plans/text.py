"""Queries of text functions, validation and profiles, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vankho.functions import checks
from vankho.functions import text as T
from vankho.functions.marks import MISSING_MARKERS, is_missing
from vankho.plans.registry import registry
from vankho.runtime import table

QUERIES, SQL, query = registry()
_C = f"'([a-z0-9{T.LEGAL_LETTERS}/._\\-]+)'"


@query(
    f"""SELECT row_id, len(regexp_extract_all(lower(coalesce(text,'')), '([\\p{{L}}\\p{{N}}]+)')) AS n_a,
    len(regexp_extract_all(lower(coalesce(text,'')), '([\\p{{L}}\\p{{N}}_]+)')) AS n_b,
    len(list_filter(list_transform(regexp_extract_all(lower(coalesce(text,'')), {_C}), lambda x: trim(x, '/._-')), lambda x: x <> '')) AS n_c FROM agribank_internal_policies"""
)
def f_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of the three tokenisers."""
    return table(spark, d, "agribank_internal_policies").select("row_id", *[F.size(T.tokens(F.col("text"), k)).cast("bigint").alias(f"n_{k}") for k in "abc"])


@query(
    """SELECT row_id, md5(trim(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '[\\x{00a0}\\x{200b}\\t]', ' ', 'g'), '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10)||chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')), chr(10)), ' ')) AS digest
    FROM raw_pages WHERE text IS NOT NULL"""
)
def f_clean(spark: SparkSession, d: str) -> DataFrame:
    """cleaned text of every page."""
    return table(spark, d, "raw_pages").where("text is not null").select("row_id", F.md5(T.clean_text(F.col("text"))).alias("digest"))


@query(
    """SELECT row_id, coalesce(try_cast(nullif(regexp_extract(parent_id, ':[^:0-9]*([0-9]+)$', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(parent_id, '([0-9]+)', 1), '') AS BIGINT), 0) AS suffix,
    CASE WHEN regexp_extract(structure.article, '(?:ĐIỀU|Điều|điều)?\\s*([0-9]+[a-z]?)', 1) <> '' THEN 'Điều ' || regexp_extract(structure.article, '(?:ĐIỀU|Điều|điều)?\\s*([0-9]+[a-z]?)', 1) ELSE trim(structure.article) END AS label,
    CASE WHEN regexp_extract(coalesce(structure.article,''), '([0-9]+)', 1) = '' THEN 'doc_fallback' ELSE 'd' || lpad(regexp_extract(coalesce(structure.article,''), '([0-9]+)', 1), 2, '0') END AS slug,
    array_to_string(list_filter([structure.chapter, structure.section, structure.article, structure.clause, structure.point], lambda x: x IS NOT NULL), ' > ') AS path FROM chunks"""
)
def f_labels(spark: SparkSession, d: str) -> DataFrame:
    """Number suffix, article label and slug, structural path."""
    leaves = F.array(*[F.col(f"structure.{x}") for x in ("chapter", "section", "article", "clause", "point")])
    return table(spark, d, "chunks").select(
        "row_id", T.numeric_suffix(F.col("parent_id")).alias("suffix"), T.article_label(F.col("structure.article")).alias("label"),
        T.article_slug(F.col("structure.article")).alias("slug"), F.array_join(F.coalesce(F.array_compact(leaves), F.array().cast("array<string>")), " > ").alias("path"),
    )


_LEVEL = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, p in T.HEADINGS.items()) + " END"


@query(f"SELECT level, count(*) AS n FROM (SELECT {_LEVEL} AS level FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE level IS NOT NULL GROUP BY level")
def f_headings(spark: SparkSession, d: str) -> DataFrame:
    """heading lines by level."""
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.select(T.heading_level(F.col("line")).alias("level")).where("level is not null").groupBy("level").agg(F.count("*").alias("n"))


@query(
    """SELECT row_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(coalesce(evidence,'')), '((?:điều|khoản|chương) [0-9]+)'))), ';') AS refs,
    array_to_string(regexp_extract_all(coalesce(evidence,''), '([0-9]{1,4}(?:/[0-9A-ZĐ_a-zđ.\\-]+)+)'), ';') AS numbers FROM relation_candidates"""
)
def f_references(spark: SparkSession, d: str) -> DataFrame:
    """articles and document numbers that an evidence names."""
    return table(spark, d, "relation_candidates").select("row_id", F.array_join(T.references(F.col("evidence")), ";").alias("refs"), F.array_join(T.doc_numbers(F.col("evidence")), ";").alias("numbers"))


@query("SELECT key, count(*) AS n, min(row_id) AS first_row FROM (SELECT row_id, trim(regexp_replace(lower(question), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS key FROM questions WHERE question IS NOT NULL) GROUP BY key")
def f_dedup_key(spark: SparkSession, d: str) -> DataFrame:
    """questions that are equal but for case and punctuation."""
    q = table(spark, d, "questions").where("question is not null").select("row_id", T.dedup_key(F.col("question")).alias("key"))
    return q.groupBy("key").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


@query(
    """SELECT row_id, CASE WHEN length(text) <= 300 OR strpos(text, 'thì') = 0 THEN substr(text, 1, 300)
    ELSE (CASE WHEN greatest(strpos(text,'thì')-100, 1) > 1 THEN '...' ELSE '' END) || substr(text, greatest(strpos(text,'thì')-100, 1), least(strpos(text,'thì')+3+100, length(text)+1) - greatest(strpos(text,'thì')-100, 1)) || (CASE WHEN least(strpos(text,'thì')+3+100, length(text)+1) <= length(text) THEN '...' ELSE '' END) END AS piece,
    length(CASE WHEN length(text) <= 600 THEN text ELSE substr(text,1,400) || chr(10) || '...' || chr(10) || substr(text, length(text)-200+1, 200) END) AS n
    FROM agribank_internal_policies WHERE text IS NOT NULL"""
)
def f_snippet(spark: SparkSession, d: str) -> DataFrame:
    """Snippet around a word; head and tail."""
    text = F.col("text")
    return table(spark, d, "agribank_internal_policies").where("text is not null").select(
        "row_id", T.snippet(text, F.lit("thì")).alias("piece"), F.length(T.head_tail(text, 400, 200)).cast("bigint").alias("n")
    )


@query(
    """SELECT row_id, '[' || coalesce(nullif(trim(so_ky_hieu),''), nullif(CASE WHEN length(title) > 50 THEN substr(title,1,50)||'...' ELSE title END, ''), 'Doc_' || document_id) || ' | ' ||
    coalesce(nullif(trim(split_part(article,'.',1)),''), nullif(trim(chapter),''), 'Toàn văn') || ' | ' || chunk_id || ']' AS cited FROM agribank_internal_policies"""
)
def f_citation(spark: SparkSession, d: str) -> DataFrame:
    """citation of every policy chunk."""
    c = F.col
    return table(spark, d, "agribank_internal_policies").select("row_id", T.citation(c("so_ky_hieu"), c("title"), c("document_id"), c("article"), c("chapter"), c("chunk_id")).alias("cited"))


@query("SELECT event_id, round(1/(1+exp(-greatest(least(value-50, 700.0), -700.0))), 4) AS p FROM events")
def f_sigmoid(spark: SparkSession, d: str) -> DataFrame:
    """logistic score."""
    return table(spark, d, "events").select("event_id", T.sigmoid(F.col("value") - 50).alias("p"))


@query(
    """SELECT row_id, array_to_string(CASE WHEN len(roles) = 0 OR roles IS NULL THEN ['Guest'] ELSE roles END, '+') AS roles FROM (SELECT row_id,
    coalesce(CASE WHEN json_valid(allowed_roles) AND json_type(allowed_roles) = 'ARRAY' THEN from_json(allowed_roles, '["VARCHAR"]') END,
    list_filter(list_transform(string_split(regexp_replace(allowed_roles, '[\\[\\]"'']', '', 'g'), ','), lambda x: trim(x)), lambda x: x <> '')) AS roles FROM qa_dataset)"""
)
def f_roles(spark: SparkSession, d: str) -> DataFrame:
    """role lists, JSON or parted by commas; none gives Guest."""
    q = table(spark, d, "qa_dataset")
    return q.select("row_id", F.array_join(T.parse_roles(F.col("allowed_roles")), "+").alias("roles"))


@query(
    """SELECT coalesce(error, 'ok') AS error, count(*) AS n FROM (SELECT CASE WHEN coalesce(trim(chunk_id) = '', true) THEN 'chunk_id' WHEN NOT coalesce(strategy IN ('fixed-size','semantic','hierarchical'), false) THEN 'strategy'
    WHEN coalesce(trim(source) = '', true) THEN 'source' WHEN coalesce(page_start < 1, true) THEN 'page_start' WHEN coalesce(page_end < page_start, true) THEN 'page_end' WHEN coalesce(trim(text) = '', true) THEN 'skip' END AS error FROM chunks) GROUP BY 1"""
)
def v_chunks(spark: SparkSession, d: str) -> DataFrame:
    """V1: chunks by the reason that breaks the contract."""
    c = F.col
    error = checks.chunk_error(c("chunk_id"), c("strategy"), c("source"), c("page_start"), c("page_end"), c("text"))
    return table(spark, d, "chunks").groupBy(F.coalesce(error, F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


@query("SELECT label, count(*) AS n, count(*) FILTER (len(embedding) = 64 AND len(list_filter(embedding, lambda x: abs(x) > 1e-9)) > 0) AS good FROM embeddings GROUP BY label")
def v_vectors(spark: SparkSession, d: str) -> DataFrame:
    """V2: vectors that keep the contract, by label."""
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(checks.vector_ok(F.col("embedding"), 64)).alias("good"))


@query("SELECT label, CASE WHEN embedding IS NULL THEN 'null' WHEN len(embedding) <> 64 THEN 'size' WHEN len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0 THEN 'not finite' WHEN len(list_filter(embedding, lambda x: abs(x) > 1e-9)) = 0 THEN 'zero' ELSE 'ok' END AS reason, count(*) AS n FROM embeddings GROUP BY ALL")
def v_vector_reasons(spark: SparkSession, d: str) -> DataFrame:
    """V2: vectors by the reason that breaks the contract."""
    return table(spark, d, "embeddings").groupBy("label", checks.vector_error(F.col("embedding"), 64).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT strategy, count(*) AS n, count(DISTINCT source) AS sources, strategy = 'hierarchical' AS compatible FROM chunks WHERE strategy IS NOT NULL GROUP BY strategy")
def v_compatible(spark: SparkSession, d: str) -> DataFrame:
    """V3: collections by whether their properties equal those asked for."""
    rows = table(spark, d, "chunks").where("strategy is not null").groupBy("strategy").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))
    return rows.withColumn("compatible", F.col("strategy") == "hierarchical")


@query("SELECT c.row_id FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.row_id WHERE e.vec_id IS NULL AND c.text IS NOT NULL")
def s_uncached(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose vectors are not held yet, by key."""
    held = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"))
    return table(spark, d, "chunks").where("text is not null").select("row_id").join(held, "row_id", "left_anti")


@query("SELECT chunk_id, count(*) AS n, count(DISTINCT source) AS files FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id HAVING count(*) > 1")
def s_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers met more than once, within a file or across files."""
    c = table(spark, d, "chunks").where("chunk_id is not null").groupBy("chunk_id").agg(F.count("*").alias("n"), F.count_distinct("source").alias("files"))
    return c.where("n > 1")


@query(
    """SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN contains(text, chr(65533)) THEN 'replaced' END, CASE WHEN regexp_matches(text, 'Ã.|Ä.|Â.') THEN 'mojibake' END,
    CASE WHEN len(regexp_extract_all(text, '[\\p{L}][0-9][\\p{L}]')) >= 3 THEN 'digits' END, CASE WHEN len(regexp_extract_all(text, '[a-zđ][A-ZĐ][a-zđ]')) >= 3 THEN 'mixed' END], lambda x: x IS NOT NULL)) AS flag FROM raw_pages WHERE text IS NOT NULL) GROUP BY flag"""
)
def v_text_layer(spark: SparkSession, d: str) -> DataFrame:
    """V4: pages by flag of a bad text layer."""
    pages = table(spark, d, "raw_pages").where("text is not null")
    return pages.select(F.explode(checks.text_problems(F.col("text"))).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query(
    """SELECT score, count(*) AS n FROM (SELECT CAST(CASE WHEN coalesce(length(trim(text)),0) < 15 THEN 0.2 WHEN len(regexp_extract_all(text, chr(65533))) > 0.03*length(text) THEN 0.3 WHEN len(regexp_extract_all(text, '[\\p{L}][0-9][\\p{L}]')) >= 3 THEN 0.4 ELSE 1.0 END AS DOUBLE) AS score FROM raw_pages) GROUP BY score"""
)
def v_quality(spark: SparkSession, d: str) -> DataFrame:
    """V5: pages by quality score of their text layer."""
    return table(spark, d, "raw_pages").groupBy(checks.text_quality(F.col("text")).alias("score")).agg(F.count("*").alias("n"))


@query(
    """SELECT count(*) AS n, count(*) FILTER (coalesce(length(target_so_ky_hieu) >= 4 AND NOT regexp_matches(target_so_ky_hieu, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$') AND regexp_matches(target_so_ky_hieu, '\\p{L}'), false)) AS good FROM relation_candidates"""
)
def v_numbers(spark: SparkSession, d: str) -> DataFrame:
    """V6: texts that can be a document number."""
    return table(spark, d, "relation_candidates").agg(F.count("*").alias("n"), F.count_if(checks.legal_number_ok(F.col("target_so_ky_hieu"))).alias("good"))


_DATES = ["ngay_ban_hanh", "ngay_co_hieu_luc", "ngay_het_hieu_luc", "ngay_dang_cong_bao"]


@query("SELECT field, count(*) AS n, count(*) FILTER (coalesce(regexp_matches(v, '^[0-9]{2}/[0-9]{2}/[0-9]{4}$') AND try_strptime(v, '%d/%m/%Y') IS NOT NULL, false)) AS good FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS v FROM metadata" for c in _DATES) + ") GROUP BY field")
def v_dates(spark: SparkSession, d: str) -> DataFrame:
    """Date fields that hold a date."""
    fields = table(spark, d, "metadata").select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in _DATES])))
    return fields.groupBy("field").agg(F.count("*").alias("n"), F.count_if(checks.date_ok(F.col("v"))).alias("good"))


@query("SELECT row_id, id FROM metadata WHERE coalesce(regexp_matches(title, '(?i)thẻ|két'), false) OR coalesce(regexp_matches(so_ky_hieu, '(?i)UBND'), false) OR coalesce(contains(lower(co_quan_ban_hanh), 'ngân hàng'), false)")
def v_filter(spark: SparkSession, d: str) -> DataFrame:
    """Any of three columns holds the text; null is no match."""
    m, no = table(spark, d, "metadata"), F.lit(False)
    hit = F.coalesce(F.col("title").rlike("(?iu)thẻ|két"), no) | F.coalesce(F.col("so_ky_hieu").rlike("(?iu)UBND"), no) | F.coalesce(F.contains(F.lower("co_quan_ban_hanh"), F.lit("ngân hàng")), no)
    return m.where(hit).select("row_id", "id")


@query(
    """SELECT coalesce(a.side, '') || coalesce(b.side, '') AS side, count(*) AS n FROM (SELECT DISTINCT id, 'metadata' AS side FROM metadata WHERE id IS NOT NULL) a FULL JOIN (SELECT DISTINCT document_id AS id, 'chunks' AS side FROM chunks WHERE document_id IS NOT NULL) b ON a.id = b.id GROUP BY 1"""
)
def v_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers held by one table, the other or both."""
    a = table(spark, d, "metadata").where("id is not null").select("id", F.lit("metadata").alias("a")).distinct()
    b = table(spark, d, "chunks").where("document_id is not null").select(F.col("document_id").alias("id"), F.lit("chunks").alias("b")).distinct()
    return a.join(b, "id", "full_outer").groupBy(F.concat(F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))).alias("side")).agg(F.count("*").alias("n"))


@query(
    """SELECT kind, count(*) AS refs, count(*) FILTER (missing) AS stale FROM (SELECT 'parent' AS kind, NOT EXISTS (SELECT 1 FROM chunks c WHERE c.parent_id = r) AS missing FROM (SELECT unnest(relevant_parent_ids) AS r FROM questions) WHERE r IS NOT NULL
    UNION ALL SELECT 'child', NOT EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = r) FROM (SELECT unnest(relevant_child_ids) AS r FROM questions) WHERE r IS NOT NULL) GROUP BY kind"""
)
def v_gold_ids(spark: SparkSession, d: str) -> DataFrame:
    """Gold identifiers that no chunk has."""
    questions, chunks = table(spark, d, "questions"), table(spark, d, "chunks")
    out = None
    for kind, refs, key in (("parent", "relevant_parent_ids", "parent_id"), ("child", "relevant_child_ids", "chunk_id")):
        asked = questions.select(F.explode(refs).alias("r")).where("r is not null").groupBy("r").agg(F.count("*").alias("n"))
        held = chunks.select(F.col(key).alias("r"), F.lit(1).alias("held")).where("r is not null").distinct()
        counted = asked.join(held, "r", "left").agg(F.sum("n").alias("refs"), F.coalesce(F.sum(F.when(F.col("held").isNull(), F.col("n"))), F.lit(0)).alias("stale"))
        counted = counted.where("refs is not null").select(F.lit(kind).alias("kind"), "refs", "stale")
        out = counted if out is None else out.unionAll(counted)
    return out


_PROFILED = ["title", "nganh", "linh_vuc", "co_quan_ban_hanh", "chuc_danh", "nguoi_ky", "pham_vi", "tinh_trang_hieu_luc", "loai_van_ban"]
_MISSING = "(" + ", ".join("'" + m + "'" for m in MISSING_MARKERS) + ")"


@query(
    "SELECT field, count(*) AS n, count(*) FILTER (v IS NULL) AS nulls, count(*) FILTER (trim(v) = '') AS empty, count(*) FILTER (v IS NULL OR lower(trim(v)) IN " + _MISSING + ") AS missing, count(DISTINCT v) AS different FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS v FROM metadata" for c in _PROFILED) + ") GROUP BY field"
)
def e_profile(spark: SparkSession, d: str) -> DataFrame:
    """Nulls, empty texts and markers for nothing, by column."""
    fields = table(spark, d, "metadata").select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in _PROFILED])))
    return fields.groupBy("field").agg(
        F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(F.trim("v") == "").alias("empty"), F.count_if(is_missing(F.col("v"))).alias("missing"), F.count_distinct("v").alias("different")
    )


@query("SELECT count(*) AS n, count(DISTINCT chunk_id) AS ids, count(DISTINCT document_id) AS docs, count(*) FILTER (text IS NULL OR trim(text) = '') AS empty, count(*) - count(DISTINCT chunk_id) AS repeated FROM chunks WHERE chunk_id IS NOT NULL")
def e_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Totals, distinct identifiers, empty texts, repeats."""
    c = table(spark, d, "chunks").where("chunk_id is not null")
    out = c.agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids"), F.count_distinct("document_id").alias("docs"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("empty"))
    return out.withColumn("repeated", F.col("n") - F.col("ids"))


@query("SELECT w AS word, count(*) FILTER (contains(lower(text), w)) AS docs FROM (SELECT unnest(['két','thẻ trắng','rủi ro','bảo lãnh','kiểm toán','ledger']) AS w), documents GROUP BY w")
def e_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold each keyword, in one pass."""
    words = ["két", "thẻ trắng", "rủi ro", "bảo lãnh", "kiểm toán", "ledger"]
    text = F.lower("text")
    counts = table(spark, d, "documents").select(text.alias("t")).agg(*[F.count_if(F.contains(F.col("t"), F.lit(w))).alias(f"c{i}") for i, w in enumerate(words)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"c{i}").alias("docs")) for i, w in enumerate(words)])))


@query("SELECT user_id, count(*) AS n, round(avg(value), 4) AS mean, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) >= 50) AS high FROM events GROUP BY user_id")
def s_json(spark: SparkSession, d: str) -> DataFrame:
    """Fields of JSON text."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.count_if(k >= 50).alias("high"))


@query("SELECT loai_van_ban, sha256(loai_van_ban) AS digest, count(*) AS n FROM metadata WHERE loai_van_ban IS NOT NULL GROUP BY loai_van_ban")
def f_digest(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 keys."""
    return table(spark, d, "metadata").where("loai_van_ban is not null").groupBy("loai_van_ban").agg(F.count("*").alias("n")).select("loai_van_ban", F.sha2("loai_van_ban", 256).alias("digest"), "n")
