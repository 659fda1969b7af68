"""Queries of extraction, graph and entity operators, with DuckDB SQL.

Documents are metadata by id; an edge goes from source_id to the document whose number is target_so_ky_hieu as registered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vankho.operators import graph
from vankho.operators.ordered import earliest, latest
from vankho.plans.registry import registry
from vankho.runtime import table

QUERIES, SQL, query = registry()

#: Relation words and edge types; a replaced document is the source of its edge.
TYPES = [("căn cứ", "THAM_CHIEU"), ("bãi bỏ", "THAM_CHIEU"), ("sửa đổi, bổ sung", "SUA_DOI"), ("thay thế", "THAY_THE"), ("dẫn chiếu", "DAN_CHIEU"), ("hướng dẫn", "HUONG_DAN")]
REVERSED = "thay thế"
_CASE = "CASE trigger " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES) + " END"

_EDGES = f"""m AS (SELECT so_ky_hieu, min(id) AS id FROM metadata WHERE id IS NOT NULL GROUP BY 1), raw AS (SELECT r.source_id AS a, m.id AS b, {_CASE} AS type, trigger FROM relation_candidates r JOIN m ON m.so_ky_hieu = r.target_so_ky_hieu WHERE r.source_id IS NOT NULL AND trigger IS NOT NULL),
edges AS (SELECT DISTINCT CASE WHEN trigger = '{REVERSED}' THEN b ELSE a END AS src, CASE WHEN trigger = '{REVERSED}' THEN a ELSE b END AS dst, type FROM raw), v AS (SELECT DISTINCT id FROM metadata WHERE id IS NOT NULL)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    numbers = table(spark, d, "metadata").where("id is not null").groupBy(F.col("so_ky_hieu").alias("target_so_ky_hieu")).agg(F.min("id").alias("b"))
    kind = None
    for word, name in TYPES:
        kind = F.when(F.col("trigger") == word, name) if kind is None else kind.when(F.col("trigger") == word, name)
    raw = table(spark, d, "relation_candidates").where("source_id is not null and trigger is not null").select(F.col("source_id").alias("a"), "target_so_ky_hieu", kind.alias("type"), (F.col("trigger") == REVERSED).alias("turned")).distinct()
    linked = raw.join(numbers, "target_so_ky_hieu")
    return linked.select(F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")).alias("src"), F.when(F.col("turned"), F.col("a")).otherwise(F.col("b")).alias("dst"), "type").distinct()


def vertices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "metadata").where("id is not null").select("id").distinct().withColumn("label", F.lit("Document"))


@query(f"WITH {_EDGES} SELECT 'edge' AS what, type AS name, count(*) AS n FROM edges GROUP BY type UNION ALL SELECT 'node', 'Document', count(*) FROM v")
def g_counts(spark: SparkSession, d: str) -> DataFrame:
    """Vertices by label and edges by type."""
    e = edges(spark, d).groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "name", "n")
    return e.unionAll(vertices(spark, d).groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "name", "n"))


@query(f"WITH {_EDGES} SELECT src, dst, type FROM edges WHERE type IN ('THAY_THE','SUA_DOI') AND src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)")
def g_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of two types with both ends."""
    ids = vertices(spark, d).select("id")
    e = edges(spark, d).where(F.col("type").isin("THAY_THE", "SUA_DOI"))
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type")


@query("SELECT parent_id, chunk_id FROM (SELECT DISTINCT parent_id, chunk_id FROM chunks WHERE parent_id IS NOT NULL AND chunk_id IS NOT NULL) ORDER BY parent_id, chunk_id LIMIT 50")
def g_listing(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty children by parent."""
    c = table(spark, d, "chunks").where("parent_id is not null and chunk_id is not null").select("parent_id", "chunk_id").distinct()
    return c.orderBy("parent_id", "chunk_id").limit(50)


@query(
    f"""WITH {_EDGES}, e AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM edges WHERE type IN ('THAY_THE','SUA_DOI') UNION ALL SELECT dst, src FROM edges WHERE type IN ('THAY_THE','SUA_DOI')) WHERE a <> b), seeds AS (SELECT id FROM v WHERE try_cast(id AS BIGINT) % 20 = 0),
    h1 AS (SELECT s.id AS seed, e.b AS target, 1 AS hop FROM seeds s JOIN e ON e.a = s.id), h2 AS (SELECT h1.seed, e.b AS target, 2 AS hop FROM h1 JOIN e ON e.a = h1.target WHERE e.b <> h1.seed) SELECT seed, target, CAST(min(hop) AS BIGINT) AS hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY seed, target"""
)
def g_hops(spark: SparkSession, d: str) -> DataFrame:
    """Documents within two hops of every seed, with the least distance."""
    seeds = vertices(spark, d).where(F.col("id").try_cast("bigint") % 20 == 0)
    return graph.expand(seeds, edges(spark, d).where(F.col("type").isin("THAY_THE", "SUA_DOI")))


@query(f"WITH {_EDGES} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM (SELECT DISTINCT src, dst FROM edges WHERE type='THAY_THE') x JOIN (SELECT DISTINCT src, dst FROM edges WHERE type='THAY_THE') y ON x.dst = y.src WHERE x.src <> y.dst")
def g_chains(spark: SparkSession, d: str) -> DataFrame:
    """Directed chains of replacement."""
    return graph.chains(edges(spark, d), "THAY_THE")


@query(f"WITH {_EDGES} SELECT id FROM v WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def g_lonely(spark: SparkSession, d: str) -> DataFrame:
    """Documents without an edge."""
    return graph.lonely(vertices(spark, d), edges(spark, d)).select("id")


@query(f"WITH {_EDGES} SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY id")
def g_degrees(spark: SparkSession, d: str) -> DataFrame:
    """In- and out-degrees."""
    return graph.degrees(edges(spark, d))


@query(f"WITH {_EDGES} SELECT v.id, e.dst, e.type FROM v LEFT JOIN edges e ON e.src = v.id")
def g_optional(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its outgoing edges, if any."""
    return vertices(spark, d).select("id").join(edges(spark, d).select(F.col("src").alias("id"), "dst", "type"), "id", "left")


@query(f"WITH {_EDGES}, k AS (SELECT document_id AS id, count(DISTINCT chunk_id) AS clauses FROM chunks GROUP BY 1) SELECT e.type, count(*) AS n, CAST(sum(coalesce(k.clauses, 0)) AS BIGINT) AS clauses FROM edges e LEFT JOIN k ON k.id = e.dst GROUP BY e.type")
def g_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Clauses of the documents that edges lead to."""
    k = table(spark, d, "chunks").groupBy(F.col("document_id").alias("dst")).agg(F.count_distinct("chunk_id").alias("clauses"))
    return edges(spark, d).join(k, "dst", "left").groupBy("type").agg(F.count("*").alias("n"), F.sum(F.coalesce("clauses", F.lit(0))).alias("clauses"))


@query(f"WITH {_EDGES}, cited AS (SELECT DISTINCT document_id AS id FROM chunks WHERE document_id IS NOT NULL) SELECT label, count(*) AS n FROM (SELECT id, 'Document' AS label FROM v UNION ALL SELECT id, 'Stub' FROM (SELECT source_id AS id FROM relation_candidates WHERE source_id IS NOT NULL UNION SELECT id FROM cited) WHERE id NOT IN (SELECT id FROM v)) GROUP BY label")
def g_stubs(spark: SparkSession, d: str) -> DataFrame:
    """Vertices with stubs for unknown ends."""
    a = table(spark, d, "relation_candidates").where("source_id is not null").select(F.col("source_id").alias("src"), F.col("source_id").alias("dst"))
    b = table(spark, d, "chunks").where("document_id is not null").select(F.col("document_id").alias("src"), F.col("document_id").alias("dst"))
    return graph.with_stubs(vertices(spark, d), a.unionAll(b), "Stub").groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT coalesce(trigger, '(none)') AS trigger, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM (SELECT DISTINCT source_id, source_so_ky_hieu, target_so_ky_hieu, trigger FROM relation_candidates) GROUP BY 1")
def e_relations(spark: SparkSession, d: str) -> DataFrame:
    """E5: candidates without repeats, counts and shares by word."""
    keys = ["source_id", "source_so_ky_hieu", "target_so_ky_hieu", "trigger"]
    counted = table(spark, d, "relation_candidates").select(*keys).distinct().groupBy(F.coalesce("trigger", F.lit("(none)")).alias("trigger")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("trigger", "n", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 2).alias("percent"))


_WORDS = [w for w, _ in TYPES[:4]]


@query(
    f"""SELECT row_id, trigger, target FROM (SELECT row_id, source_so_ky_hieu, line, unnest(list_distinct(regexp_extract_all(line, '([0-9]{{1,4}}(?:/[0-9A-ZĐ_a-zđ.\\-]+)+)'))) AS target FROM (SELECT row_id, source_so_ky_hieu, unnest(string_split(evidence, '. ')) AS line FROM relation_candidates WHERE evidence IS NOT NULL)),
    (SELECT unnest([{', '.join("'" + w + "'" for w in _WORDS)}]) AS trigger) WHERE contains(lower(line), trigger) AND coalesce(lower(target) <> lower(source_so_ky_hieu), true)"""
)
def e_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each line with a relation word and a document number; references to the document itself are left out."""
    from vankho.functions.text import doc_numbers

    lines = table(spark, d, "relation_candidates").where("evidence is not null").select("row_id", "source_so_ky_hieu", F.explode(F.split("evidence", r"\. ", -1)).alias("line"))
    found = F.filter(F.array(*[F.lit(w) for w in _WORDS]), lambda w: F.contains(F.lower("line"), w))
    parts = lines.withColumn("found", found).where(F.size("found") > 0).select("row_id", "source_so_ky_hieu", "line", F.explode("found").alias("trigger"))
    out = parts.select("row_id", "source_so_ky_hieu", "trigger", F.explode(F.array_distinct(doc_numbers(F.col("line")))).alias("target"))
    return out.where(F.coalesce(F.lower("target") != F.lower("source_so_ky_hieu"), F.lit(True))).select("row_id", "trigger", "target")


_RULES = [("no source", "source_id IS NULL"), ("no target", "target_so_ky_hieu IS NULL OR trim(target_so_ky_hieu) = ''"), ("no type", "trigger IS NULL"), ("self", "source_so_ky_hieu = target_so_ky_hieu"), ("no evidence", "evidence IS NULL OR length(evidence) < 20")]
_REASONS = "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _RULES) + ")"


@query(f"SELECT CASE WHEN reasons <> '' THEN reasons WHEN again > 1 THEN 'repeated' ELSE 'pass' END AS outcome, count(*) AS n FROM (SELECT reasons, row_number() OVER (PARTITION BY source_id, target_so_ky_hieu, trigger, reasons = '' ORDER BY row_id) AS again FROM (SELECT *, {_REASONS} AS reasons FROM relation_candidates)) GROUP BY 1")
def e_validation(spark: SparkSession, d: str) -> DataFrame:
    """Relations by the rules they break; of those that pass only the first of equal ones counts."""
    checked = table(spark, d, "relation_candidates").withColumn("reasons", F.expr(_REASONS))
    failed = checked.where("reasons <> ''").groupBy(F.col("reasons").alias("outcome")).agg(F.count("*").alias("n"))
    good = checked.where("reasons = ''").groupBy("source_id", "target_so_ky_hieu", "trigger").agg(F.count("*").alias("c"))
    totals = good.agg(F.count("*").alias("passed"), F.sum(F.col("c") - 1).alias("again")).select(F.inline(F.array(F.struct(F.lit("pass").alias("outcome"), F.col("passed").alias("n")), F.struct(F.lit("repeated").alias("outcome"), F.col("again").alias("n")))))
    return failed.unionAll(totals.where("n > 0"))


@query("SELECT m.id, m.loai_van_ban, count(DISTINCT c.chunk_id) AS chunks, min(c.page_start) AS first_page FROM (SELECT id, max_by(loai_van_ban, row_id) AS loai_van_ban FROM metadata WHERE loai_van_ban IS NOT NULL GROUP BY id) m JOIN chunks c ON c.document_id = m.id GROUP BY ALL")
def e_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their contents, the last row of each document."""
    m = latest(table(spark, d, "metadata").where("loai_van_ban is not null").select("id", "loai_van_ban", "row_id"), ["id"], ["row_id"]).where("id is not null")
    c = table(spark, d, "chunks").groupBy(F.col("document_id").alias("id")).agg(F.count_distinct("chunk_id").alias("chunks"), F.min("page_start").alias("first_page"))
    return m.join(c, "id").select("id", "loai_van_ban", "chunks", "first_page")


@query("""SELECT kind, name, count(*) AS rows FROM (SELECT 'issuer' AS kind, trim(regexp_replace(co_quan_ban_hanh, '\\s+', ' ', 'g')) AS name FROM metadata UNION ALL SELECT 'signer', trim(regexp_replace(nguoi_ky, '\\s+', ' ', 'g')) FROM metadata UNION ALL SELECT 'field', trim(regexp_replace(linh_vuc, '\\s+', ' ', 'g')) FROM metadata) WHERE name IS NOT NULL AND lower(name) NOT IN ('', 'chưa phân loại', 'chua phan loai', 'null', 'none', 'nan', 'n/a', 'na', '-', '--', '[]', '{}', '()') GROUP BY kind, name""")
def e_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of three kinds with cleaned names, and the rows that name them."""
    from vankho.functions.marks import is_missing

    kinds = [("issuer", "co_quan_ban_hanh"), ("signer", "nguoi_ky"), ("field", "linh_vuc")]
    rows = table(spark, d, "metadata").select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.trim(F.regexp_replace(c, r"\s+", " ")).alias("name")) for k, c in kinds])))
    return rows.where(~is_missing(F.col("name"))).groupBy("kind", "name").agg(F.count("*").alias("rows"))


@query("SELECT chunk_id, row_id, deleted_at IS NOT NULL AS gone FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC, row_id DESC) AS k FROM chunks WHERE chunk_id IS NOT NULL AND loaded_at IS NOT NULL) WHERE k = 1")
def s_latest(spark: SparkSession, d: str) -> DataFrame:
    """S9a, S13, CG7: keep-last state of a table that is loaded again and again."""
    c = table(spark, d, "chunks").where("chunk_id is not null and loaded_at is not null").select("chunk_id", "row_id", "loaded_at", "deleted_at")
    return latest(c, ["chunk_id"], ["loaded_at", "row_id"]).select("chunk_id", "row_id", F.col("deleted_at").isNotNull().alias("gone"))


@query("SELECT request_id, min(row_id) AS first_row FROM audit_log WHERE request_id IS NOT NULL GROUP BY request_id")
def s_first(spark: SparkSession, d: str) -> DataFrame:
    """Keep-first of requests sent again."""
    a = table(spark, d, "audit_log").where("request_id is not null").select("request_id", "row_id")
    return earliest(a, ["request_id"], ["row_id"]).select("request_id", F.col("row_id").alias("first_row"))


@query("SELECT id, so_ky_hieu AS opened FROM metadata WHERE so_ky_hieu IS NOT NULL")
def s_sealed(spark: SparkSession, d: str) -> DataFrame:
    """Encrypted and opened again (AES-GCM)."""
    key = F.lit("0123456789abcdef")
    sealed = table(spark, d, "metadata").where("so_ky_hieu is not null").select("id", F.base64(F.aes_encrypt("so_ky_hieu", key)).alias("sealed"))
    return sealed.select("id", F.aes_decrypt(F.unbase64("sealed"), key).cast("string").alias("opened"))


@query(f"WITH {_EDGES} SELECT id, '# ' || id || chr(10) || coalesce(string_agg('- [[' || dst || ']] ' || type, chr(10) ORDER BY dst, type), '') AS page FROM (SELECT v.id, e.dst, e.type FROM v LEFT JOIN edges e ON e.src = v.id) GROUP BY id")
def s_wiki(spark: SparkSession, d: str) -> DataFrame:
    """A page of text for every document, with its links."""
    linked = vertices(spark, d).select("id").join(edges(spark, d).select(F.col("src").alias("id"), "dst", "type"), "id", "left")
    pages = linked.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("dst").isNotNull(), F.struct("dst", "type")))).alias("links"))
    lines = F.transform("links", lambda x: F.concat(F.lit("- [["), x["dst"], F.lit("]] "), x["type"]))
    return pages.select("id", F.concat(F.lit("# "), F.col("id"), F.lit("\n"), F.array_join(lines, "\n")).alias("page"))


# further graph queries


@query("SELECT CASE WHEN structure.point IS NOT NULL THEN 'point' WHEN structure.clause IS NOT NULL THEN 'clause' WHEN structure.article IS NOT NULL THEN 'article' WHEN structure.chapter IS NOT NULL THEN 'chapter' ELSE 'none' END AS level, count(*) AS n FROM chunks GROUP BY 1")
def g_levels(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by their level."""
    level = F.coalesce(*[F.when(F.col(f"structure.{x}").isNotNull(), x) for x in ("point", "clause", "article", "chapter")], F.lit("none"))
    return table(spark, d, "chunks").groupBy(level.alias("level")).agg(F.count("*").alias("n"))


_TWO = "e AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges) WHERE a <> b), seeds AS (SELECT id FROM v WHERE try_cast(id AS BIGINT) % 20 = 0)"


@query(f"WITH {_EDGES}, {_TWO}, c AS (SELECT document_id AS id, count(*) AS n FROM chunks GROUP BY 1) SELECT 0::BIGINT AS hops, s.id AS seed, coalesce(c.n, 0) AS chunks FROM seeds s LEFT JOIN c USING (id) UNION ALL SELECT 1, seed, CAST(sum(coalesce(c.n, 0)) AS BIGINT) FROM (SELECT id AS seed, id FROM seeds UNION SELECT s.id, e.b FROM seeds s JOIN e ON e.a = s.id) LEFT JOIN c USING (id) GROUP BY seed")
def g_compare_hops(spark: SparkSession, d: str) -> DataFrame:
    """Context of every seed without and with its neighbours."""
    seeds = vertices(spark, d).where(F.col("id").try_cast("bigint") % 20 == 0).select("id")
    sizes = table(spark, d, "chunks").groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"))
    own = seeds.select(F.col("id").alias("seed"), "id")
    near = graph.expand(seeds, edges(spark, d), 1).select("seed", F.col("target").alias("id"))
    count = lambda reached, hops: reached.join(sizes, "id", "left").groupBy("seed").agg(F.sum(F.coalesce("n", F.lit(0))).alias("chunks")).select(F.lit(hops).cast("bigint").alias("hops"), "seed", "chunks")
    return count(own, 0).unionAll(count(own.unionAll(near), 1))


@query(f"WITH {_EDGES}, o AS (SELECT DISTINCT src, dst FROM edges WHERE type='THAY_THE') SELECT x.src AS a, x.dst AS b, y.dst AS c, z.dst AS d FROM o x JOIN o y ON x.dst = y.src JOIN o z ON y.dst = z.src WHERE x.src <> y.dst AND x.src <> z.dst AND x.dst <> z.dst")
def g_long_chains(spark: SparkSession, d: str) -> DataFrame:
    """Directed chains of three replacements, no document twice."""
    one = edges(spark, d).where("type = 'THAY_THE'").select("src", "dst").distinct()
    last = one.select(F.col("src").alias("c"), F.col("dst").alias("d"))
    return graph.chains(edges(spark, d), "THAY_THE").join(last, "c").where("a <> d and b <> d").select("a", "b", "c", "d")


@query("SELECT id, nguoi_ky, chuc_danh FROM (SELECT DISTINCT id, nguoi_ky, chuc_danh FROM metadata WHERE id IS NOT NULL AND nguoi_ky IS NOT NULL) ORDER BY id, nguoi_ky, chuc_danh NULLS FIRST LIMIT 50")
def g_signers(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty links from a document to who signed it."""
    return table(spark, d, "metadata").where("id is not null and nguoi_ky is not null").select("id", "nguoi_ky", "chuc_danh").distinct().orderBy("id", "nguoi_ky", "chuc_danh").limit(50)


@query(f"WITH {_EDGES} SELECT m.nguoi_ky, e.dst AS document, count(DISTINCT c.chunk_id) AS clauses FROM (SELECT DISTINCT id, nguoi_ky FROM metadata WHERE nguoi_ky IS NOT NULL AND id IS NOT NULL) m JOIN edges e ON e.src = m.id JOIN chunks c ON c.document_id = e.dst GROUP BY ALL")
def g_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths from a signer over a document to the clauses of what it refers to."""
    signed = table(spark, d, "metadata").where("nguoi_ky is not null and id is not null").select(F.col("id").alias("src"), "nguoi_ky").distinct()
    clauses = table(spark, d, "chunks").groupBy(F.col("document_id").alias("document")).agg(F.count_distinct("chunk_id").alias("clauses")).where("document is not null")
    return signed.join(edges(spark, d).select("src", "dst", "type"), "src").join(clauses, F.col("dst") == F.col("document")).select("nguoi_ky", "document", "clauses").distinct()


@query("SELECT row_id, state FROM (SELECT r.row_id, extracted_at, CASE WHEN m.so_ky_hieu IS NOT NULL THEN 'VERIFIED' ELSE 'PROPOSED' END AS state FROM relation_candidates r LEFT JOIN (SELECT DISTINCT so_ky_hieu FROM metadata) m ON m.so_ky_hieu = r.target_so_ky_hieu) WHERE state <> 'VERIFIED' ORDER BY extracted_at DESC NULLS LAST, row_id LIMIT 100")
def g_review(spark: SparkSession, d: str) -> DataFrame:
    """The review queue of relations that are not verified, the newest first."""
    known = table(spark, d, "metadata").select(F.col("so_ky_hieu").alias("target_so_ky_hieu")).where("target_so_ky_hieu is not null").distinct()
    open_ = table(spark, d, "relation_candidates").select("row_id", "extracted_at", "target_so_ky_hieu").join(known, "target_so_ky_hieu", "left_anti")
    return open_.orderBy(F.desc_nulls_last("extracted_at"), "row_id").limit(100).select("row_id", F.lit("PROPOSED").alias("state"))


_NEXT = "nx AS (SELECT row_id AS src, lead(row_id) OVER (PARTITION BY document_id ORDER BY coalesce(try_cast(nullif(regexp_extract(structure.article, '([0-9]+)', 1), '') AS BIGINT), 0), row_id) AS dst FROM chunks WHERE document_id IS NOT NULL)"


def _hints(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from vankho.operators.lexical import bm25
    from vankho.plans.retrieval import _corpus, _questions, c_next

    found = bm25(_corpus(spark, d), _questions(spark, d), 5).select("query_id", "id")
    owner = table(spark, d, "chunks").select(F.col("row_id").alias("id"), "document_id")
    return found.join(owner, "id"), c_next(spark, d)


def _hint_sql(k: int = 5) -> str:
    from vankho.plans.retrieval import _bm25_sql

    return f"{_bm25_sql(k)}, {_EDGES.replace('raw AS', 'rel AS').replace('FROM raw)', 'FROM rel)')}, {_NEXT}, hit AS (SELECT query_id, lex.id, c.document_id FROM lex JOIN chunks c ON c.row_id = lex.id)"


_HINTS = _hint_sql()


@query(f"WITH {_HINTS}, h AS (SELECT DISTINCT query_id, 'edge' AS kind, e.type AS name, e.dst AS target FROM hit JOIN edges e ON e.src = hit.document_id UNION ALL SELECT query_id, 'next', 'NEXT', CAST(nx.dst AS VARCHAR) FROM hit JOIN nx ON nx.src = hit.id WHERE nx.dst IS NOT NULL) SELECT query_id, kind, name, target FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY name, target) AS r FROM h) WHERE r <= 5")
def g_hints(spark: SparkSession, d: str) -> DataFrame:
    """The first five edges and following chunks of what was found for each question."""
    hit, following = _hints(spark, d)
    e = hit.join(edges(spark, d).withColumnRenamed("src", "document_id"), "document_id").select("query_id", F.lit("edge").alias("kind"), F.col("type").alias("name"), F.col("dst").alias("target")).distinct()
    n = hit.join(following.withColumnRenamed("src", "id"), "id").select("query_id", F.lit("next").alias("kind"), F.lit("NEXT").alias("name"), F.col("dst").cast("string").alias("target"))
    from pyspark.sql import Window

    order = Window.partitionBy("query_id", "kind").orderBy("name", "target")
    return e.unionAll(n).withColumn("r", F.row_number().over(order)).where("r <= 5").drop("r")


@query(f"WITH {_HINTS}, ok AS (SELECT DISTINCT id FROM metadata WHERE tinh_trang_hieu_luc = 'Còn hiệu lực' AND id IS NOT NULL), h AS (SELECT DISTINCT query_id, e.type AS name, e.dst AS target FROM hit JOIN edges e ON e.src = hit.document_id JOIN ok a ON a.id = e.src JOIN ok b ON b.id = e.dst) SELECT query_id, name, target FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY name, target) AS r FROM h) WHERE r <= 10")
def g_secure_hints(spark: SparkSession, d: str) -> DataFrame:
    """Edges of what was found, both of whose ends may be shown: here documents in force."""
    from pyspark.sql import Window

    hit, _ = _hints(spark, d)
    ok = table(spark, d, "metadata").where("tinh_trang_hieu_luc = 'Còn hiệu lực' and id is not null").select("id").distinct()
    e = edges(spark, d).join(ok.withColumnRenamed("id", "src"), "src", "left_semi").join(ok.withColumnRenamed("id", "dst"), "dst", "left_semi")
    found = hit.join(e.withColumnRenamed("src", "document_id"), "document_id").select("query_id", F.col("type").alias("name"), F.col("dst").alias("target")).distinct()
    return found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("name", "target"))).where("r <= 10").drop("r")


@query("SELECT row_id, strategy FROM chunks WHERE NOT coalesce(strategy = 'semantic' AND source LIKE 'TT%', false)")
def g_scoped_delete(spark: SparkSession, d: str) -> DataFrame:
    """What stays when the rows of one scope are deleted; null is out of every scope."""
    scope = (F.col("strategy") == "semantic") & F.col("source").like("TT%")
    return table(spark, d, "chunks").where(~F.coalesce(scope, F.lit(False))).select("row_id", "strategy")


@query(f"WITH {_EDGES}, l AS (SELECT DISTINCT src, dst FROM edges) SELECT v.id AS page, (SELECT count(*) FROM l WHERE l.src = v.id) AS out_links, (SELECT count(*) FROM l WHERE l.dst = v.id) AS in_links, (SELECT count(*) FROM l WHERE l.src = v.id AND l.dst NOT IN (SELECT id FROM v)) AS broken FROM v")
def g_wiki(spark: SparkSession, d: str) -> DataFrame:
    """Links of the written pages read back: out- and in-degree and links without a page; all zero is an orphan page."""
    from vankho.functions.text import wiki_links

    pages = s_wiki(spark, d)
    links = pages.select(F.col("id").alias("src"), F.explode(F.array_distinct(wiki_links(F.col("page")))).alias("dst"))
    known = pages.select(F.col("id").alias("dst"), F.lit(1).alias("known"))
    out = links.join(known, "dst", "left").groupBy(F.col("src").alias("page")).agg(F.count("*").alias("out_links"), F.count_if(F.col("known").isNull()).alias("broken"))
    into = links.groupBy(F.col("dst").alias("page")).agg(F.count("*").alias("in_links"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return pages.select(F.col("id").alias("page")).join(out, "page", "left").join(into, "page", "left").select("page", zero("out_links"), zero("in_links"), zero("broken"))


@query(f"WITH {_EDGES}, t AS (SELECT id, max_by(loai_van_ban, row_id) AS kind FROM metadata WHERE loai_van_ban IS NOT NULL AND id IS NOT NULL GROUP BY id) SELECT type, CASE WHEN a.kind IS NULL OR b.kind IS NULL THEN 'missing end' WHEN type = 'THAY_THE' AND a.kind <> b.kind THEN 'other kind' ELSE 'ok' END AS outcome, count(*) AS n FROM edges e LEFT JOIN t a ON a.id = e.src LEFT JOIN t b ON b.id = e.dst GROUP BY ALL")
def v_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Edges by whether both ends exist and are of the kinds that their type asks for: a document replaces one of its kind."""
    kinds = table(spark, d, "metadata").where("loai_van_ban is not null and id is not null").groupBy("id").agg(F.max_by("loai_van_ban", "row_id").alias("kind"))
    both = edges(spark, d).join(kinds.select(F.col("id").alias("src"), F.col("kind").alias("a")), "src", "left").join(kinds.select(F.col("id").alias("dst"), F.col("kind").alias("b")), "dst", "left")
    outcome = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing end").when((F.col("type") == "THAY_THE") & (F.col("a") != F.col("b")), "other kind").otherwise("ok")
    return both.groupBy("type", outcome.alias("outcome")).agg(F.count("*").alias("n"))


_KEYS = [("metadata", "id", "row_id"), ("chunks", "chunk_id", "document_id"), ("qa_dataset", "id", "source_chunk_id")]


@query(
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows, count(*) FILTER ({k} IS NULL) AS no_key, count({k}) - count(DISTINCT {k}) AS repeated FROM {t}" for t, k, _ in _KEYS) + ") JOIN ("
    "SELECT 'metadata' AS name, 0::BIGINT AS orphans UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT id FROM metadata WHERE id IS NOT NULL) UNION ALL SELECT 'qa_dataset', count(*) FROM qa_dataset WHERE source_chunk_id IS NOT NULL AND source_chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL)) USING (name)"
)
def e_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows, missing and repeated keys, and references to other tables that lead nowhere."""
    own = None
    for name, key, _ in _KEYS:
        c = table(spark, d, name).agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.count_if(F.col(key).isNull()).alias("no_key"), (F.count(key) - F.count_distinct(key)).alias("repeated"))
        own = c if own is None else own.unionAll(c)

    def orphans(name: str, ref: str, target: str, key: str) -> DataFrame:
        held = table(spark, d, target).select(F.col(key).alias(ref)).where(F.col(ref).isNotNull()).distinct()
        return table(spark, d, name).where(F.col(ref).isNotNull()).select(ref).join(held, ref, "left_anti").agg(F.lit(name).alias("name"), F.count("*").alias("orphans"))

    found = orphans("chunks", "document_id", "metadata", "id").unionAll(orphans("qa_dataset", "source_chunk_id", "chunks", "chunk_id"))
    return own.join(found, "name", "left").select("name", "rows", "no_key", "repeated", F.coalesce("orphans", F.lit(0).cast("bigint")).alias("orphans"))


@query("SELECT kind, coalesce(official, name) AS canonical, count(*) AS rows, count(DISTINCT name) AS aliases FROM (SELECT 'issuer' AS kind, trim(co_quan_ban_hanh) AS name FROM metadata WHERE trim(co_quan_ban_hanh) <> '') LEFT JOIN (SELECT lower(ten_thuong_goi) AS alias, min(ten_chinh_thuc) AS official FROM issuing_bodies WHERE ten_thuong_goi IS NOT NULL GROUP BY 1) ON lower(name) = alias GROUP BY ALL")
def e_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Names by their official form, where an everyday name is known for it, and how many writings each has."""
    names = table(spark, d, "metadata").select(F.lit("issuer").alias("kind"), F.trim("co_quan_ban_hanh").alias("name")).where("name <> ''")
    known = table(spark, d, "issuing_bodies").where("ten_thuong_goi is not null").groupBy(F.lower("ten_thuong_goi").alias("alias")).agg(F.min("ten_chinh_thuc").alias("official"))
    joined = names.join(known, F.lower("name") == F.col("alias"), "left")
    return joined.groupBy("kind", F.coalesce("official", "name").alias("canonical")).agg(F.count("*").alias("rows"), F.count_distinct("name").alias("aliases"))


@query(
    """SELECT 'document' AS entity_type, id AS entity_id, coalesce(so_ky_hieu, '') AS code, '' AS province, coalesce(loai_van_ban, '') AS kind FROM metadata WHERE id IS NOT NULL UNION ALL SELECT 'body', CAST(body_id AS VARCHAR), coalesce(ma_hieu, ''), coalesce(tinh, ''), '' FROM issuing_bodies UNION ALL SELECT 'clause', chunk_id, '', '', coalesce(strategy, '') FROM chunks WHERE chunk_id IS NOT NULL"""
)
def e_wide(spark: SparkSession, d: str) -> DataFrame:
    """Three sources in one wide table, missing fields empty."""
    documents = table(spark, d, "metadata").where("id is not null").select(F.lit("document").alias("entity_type"), F.col("id").alias("entity_id"), F.col("so_ky_hieu").alias("code"), F.col("loai_van_ban").alias("kind"))
    bodies = table(spark, d, "issuing_bodies").select(F.lit("body").alias("entity_type"), F.col("body_id").cast("string").alias("entity_id"), F.col("ma_hieu").alias("code"), F.col("tinh").alias("province"))
    clauses = table(spark, d, "chunks").where("chunk_id is not null").select(F.lit("clause").alias("entity_type"), F.col("chunk_id").alias("entity_id"), F.col("strategy").alias("kind"))
    return documents.unionByName(bodies, allowMissingColumns=True).unionByName(clauses, allowMissingColumns=True).na.fill("")


@query("SELECT a.id, coalesce(nullif(a.linh_vuc, ''), b.linh_vuc) AS linh_vuc, coalesce(nullif(a.nganh, ''), b.nganh) AS nganh FROM (SELECT id, max_by(linh_vuc, row_id) AS linh_vuc, max_by(nganh, row_id) AS nganh FROM (SELECT id, row_id, coalesce(linh_vuc, '') AS linh_vuc, coalesce(nganh, '') AS nganh FROM metadata WHERE id IS NOT NULL) GROUP BY id) a LEFT JOIN (SELECT id, max(nullif(linh_vuc, '')) AS linh_vuc, max(nullif(nganh, '')) AS nganh FROM metadata GROUP BY id) b USING (id)")
def e_enriched(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each document; fields that it lacks come from its other rows."""
    m = table(spark, d, "metadata").where("id is not null").select("id", "row_id", "linh_vuc", "nganh")
    last = m.groupBy("id").agg(*[F.max_by(F.coalesce(c, F.lit("")), "row_id").alias(c) for c in ("linh_vuc", "nganh")], *[F.max(F.nullif(F.col(c), F.lit(""))).alias("any_" + c) for c in ("linh_vuc", "nganh")])
    return last.select("id", *[F.coalesce(F.nullif(F.col(c), F.lit("")), "any_" + c).alias(c) for c in ("linh_vuc", "nganh")])
