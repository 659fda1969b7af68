"""Queries of access control, audit and report views, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vankho.operators import access, fusion
from vankho.operators.dense import cosine_top
from vankho.functions.text import tokens
from vankho.operators.lexical import bm25_scores
from vankho.operators.ordered import running_total
from vankho.plans.registry import registry
from vankho.runtime import cut, table

QUERIES, SQL, query = registry()

#: Words of the two restricted classes and the roles that may read them; a parameter of `classify`.
CLASSES = [(["tuyển dụng", "bảng lương", "thử việc"], ["Admin", "HR_Manager"]), (["rủi ro", "tín dụng", "nợ xấu"], ["Admin", "Risk_Officer", "Employee"])]
_LIST = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
_ACL = "acl AS (SELECT row_id, document_id, text, CASE " + " ".join(f"WHEN list_bool_or(list_transform({_LIST(w)}, lambda w: contains(lower(body), w))) THEN {_LIST(r)}" for w, r in CLASSES) + f" ELSE {_LIST(access.ROLES)} END AS roles FROM (SELECT *, concat_ws(' ', title, chapter, article, text) AS body FROM agribank_internal_policies))"


def acl(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat_ws(" ", "title", "chapter", "article", "text")
    return table(spark, d, "agribank_internal_policies").select("row_id", "document_id", "text", access.classify(body, CLASSES, access.ROLES).alias("roles"))


@query(f"WITH {_ACL} SELECT array_to_string(roles, '+') AS roles, count(*) AS n FROM acl GROUP BY 1")
def rb_classes(spark: SparkSession, d: str) -> DataFrame:
    """RB1: chunks by the roles that may read them."""
    return acl(spark, d).groupBy(F.array_join("roles", "+").alias("roles")).agg(F.count("*").alias("n"))


@query(f"WITH {_ACL} SELECT role, count(*) FILTER (role = 'Admin' OR list_contains(roles, role)) AS readable, round(100.0*count(*) FILTER (role = 'Admin' OR list_contains(roles, role))/count(*), 2) AS percent FROM acl, (SELECT unnest({_LIST(access.ROLES)}) AS role) GROUP BY role")
def rb_counts(spark: SparkSession, d: str) -> DataFrame:
    """RB9, U11: readable chunks per role, in one pass."""
    rows = acl(spark, d)
    sums = rows.agg(F.count("*").alias("n"), *[F.count_if(access.allowed(F.array(F.lit(r)), F.col("roles"))).alias(r) for r in access.ROLES])
    return sums.select("n", F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("readable")) for r in access.ROLES]))).select("role", "readable", F.round(F.lit(100.0) * F.col("readable") / F.col("n"), 2).alias("percent"))


@query(f"WITH {_ACL} SELECT document_id, array_to_string(list_sort(list_distinct(flatten(list(roles)))), '+') AS roles FROM acl WHERE document_id IS NOT NULL GROUP BY document_id")
def rb_documents(spark: SparkSession, d: str) -> DataFrame:
    """RB8: a document's roles are those of its chunks."""
    roles = acl(spark, d).where("document_id is not null").select("document_id", F.explode("roles").alias("role"))
    return roles.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("role")), "+").alias("roles"))


_VALID = f"list_filter(list_distinct(user_role), lambda r: list_contains({_LIST(access.ROLES)}, r))"


@query(f"SELECT row_id, CASE WHEN user_role IS NULL OR len({_VALID}) = 0 THEN 'Guest' ELSE array_to_string(list_sort({_VALID}), '+') END AS roles FROM audit_log")
def rb_roles(spark: SparkSession, d: str) -> DataFrame:
    """RB2, RB3: known roles of every request, Guest where there is none."""
    return table(spark, d, "audit_log").select("row_id", F.array_join(F.array_sort(access.valid_roles(F.col("user_role"))), "+").alias("roles"))


_ROLE = "CASE usecase WHEN 'HR' THEN 'HR_Manager' WHEN 'Risk' THEN 'Risk_Officer' ELSE 'Guest' END"
_T = "regexp_extract_all(lower({}), '([\\p{{L}}\\p{{N}}]+)')"
_SECURE = f"""{_ACL}, corpus AS (SELECT row_id AS id, {_T.format('text')} AS t FROM acl WHERE text IS NOT NULL), post AS (SELECT id, term, max(l) AS l, count(*) AS tf FROM (SELECT id, len(t) AS l, unnest(t) AS term FROM corpus) GROUP BY id, term),
size AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM corpus), raw AS (SELECT term, ln((docs-df+0.5)/(df+0.5)) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), size), idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25*(SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
q AS (SELECT row_id AS query_id, {_ROLE} AS role, {_T.format('question')} AS t FROM qa_dataset WHERE row_id % 20 = 0 AND question IS NOT NULL), asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(t) AS term FROM q) GROUP BY ALL),
scored AS (SELECT query_id, id, round(sum(times*idf*tf*2.5/(tf+1.5*(0.25+0.75*l/mean))), 4) AS score FROM asked JOIN idf USING (term) JOIN post USING (term), size GROUP BY query_id, id),
ranked AS (SELECT s.*, list_contains(a.roles, q.role) AS ok, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, id) AS r FROM scored s JOIN q USING (query_id) JOIN acl a ON a.row_id = s.id),
seen AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY query_id ORDER BY r) AS cum FROM ranked), outside AS (SELECT query_id, count(*) FILTER (NOT ok AND cum < 5) AS filtered_out FROM seen GROUP BY query_id)"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("usecase") == "HR", "HR_Manager").when(F.col("usecase") == "Risk", "Risk_Officer").otherwise("Guest")
    return table(spark, d, "qa_dataset").where("row_id % 20 = 0 and question is not null").select(F.col("row_id").alias("query_id"), F.col("question").alias("text"), role.alias("role"))


def _secured(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = acl(spark, d), _asked(spark, d)
    scored = bm25_scores(rows.where("text is not null").select(F.col("row_id").alias("id"), "text"), asked)
    lists = rows.select(F.col("row_id").alias("id"), "roles")
    # written once: what is allowed and what is counted as forbidden read the same scores
    return cut(scored.join(asked.select("query_id", "role"), "query_id").join(lists, "id").select("query_id", "id", "score", access.allowed(F.array("role"), F.col("roles")).alias("ok")))


@query(f"WITH {_SECURE} SELECT query_id, id, score, CAST(cum AS BIGINT) AS rank, filtered_out FROM seen JOIN outside USING (query_id) WHERE ok AND cum <= 5")
def rb_secure(spark: SparkSession, d: str) -> DataFrame:
    """RB4-RB7, U10: the best rows that a role may read, and how many forbidden ones stood above."""
    return access.secure_top(_secured(spark, d))


_FORBIDDEN = " OR ".join("(NOT list_contains(" + _LIST(r) + ", role) AND (" + " OR ".join(f"contains(lower(body), '{w}')" for w in words) + ")" + "".join(" AND NOT (" + " OR ".join(f"contains(lower(body), '{w}')" for w in earlier) + ")" for earlier, _ in CLASSES[:i]) + ")" for i, (words, r) in enumerate(CLASSES))


@query(f"WITH {_SECURE}, top AS (SELECT query_id, id FROM seen WHERE ok AND cum <= 5), read AS (SELECT q.role, concat_ws(' ', p.title, p.chapter, p.article, p.text) AS body FROM top JOIN q USING (query_id) JOIN agribank_internal_policies p ON p.row_id = top.id) SELECT count(*) AS rows, count(*) FILTER ({_FORBIDDEN}) AS leaks FROM read")
def rb_leaks(spark: SparkSession, d: str) -> DataFrame:
    """RB10: results that their role may not read (there must be none), judged by the words of the texts read anew, not by the lists."""
    top = access.secure_top(_secured(spark, d)).select("query_id", "id")
    body = F.lower(F.concat_ws(" ", "title", "chapter", "article", "text"))
    texts = table(spark, d, "agribank_internal_policies").select(F.col("row_id").alias("id"), body.alias("body"))
    read = top.join(_asked(spark, d).select("query_id", "role"), "query_id").join(texts, "id")
    leak, free = F.lit(False), F.lit(True)
    for words, roles in CLASSES:
        held = F.coalesce(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("body"), w)), F.lit(False))
        leak = leak | (free & held & ~F.col("role").isin(roles))
        free = free & ~held
    return read.agg(F.count("*").alias("rows"), F.count_if(leak).alias("leaks"))


@query("SELECT action, status, count(*) AS n, count(DISTINCT request_id) AS requests, CAST(sum(rbac_filtered_count) AS BIGINT) AS filtered, round(avg(len(retrieved_document_ids)), 4) AS documents FROM audit_log GROUP BY action, status")
def au_counts(spark: SparkSession, d: str) -> DataFrame:
    """AU1, U9: audit events by action and status."""
    docs = F.when(F.col("retrieved_document_ids").isNotNull(), F.size("retrieved_document_ids"))
    return table(spark, d, "audit_log").groupBy("action", "status").agg(
        F.count("*").alias("n"), F.count_distinct("request_id").alias("requests"), F.sum("rbac_filtered_count").alias("filtered"), F.round(F.avg(docs), 4).alias("documents")
    )


@query("SELECT strftime(ingested_at, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (status = 'DENIED') AS denied FROM (SELECT request_id, max_by(ingested_at, row_id) AS ingested_at, max_by(status, row_id) AS status FROM audit_log WHERE request_id IS NOT NULL AND status IS NOT NULL AND ingested_at IS NOT NULL GROUP BY request_id) GROUP BY 1")
def au_daily(spark: SparkSession, d: str) -> DataFrame:
    """AU2, S16: requests and denials per day, requests sent again counted once."""
    a = table(spark, d, "audit_log").where("request_id is not null and status is not null and ingested_at is not null")
    once = a.groupBy("request_id").agg(F.max_by("ingested_at", "row_id").alias("at"), F.max_by("status", "row_id").alias("status"))
    return once.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "DENIED").alias("denied"))


@query("SELECT user_id_demo, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (), 4) AS percent FROM audit_log WHERE user_id_demo IS NOT NULL GROUP BY user_id_demo")
def au_users(spark: SparkSession, d: str) -> DataFrame:
    """Requests and shares by user."""
    c = table(spark, d, "audit_log").where("user_id_demo is not null").groupBy("user_id_demo").agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("total")))).select("user_id_demo", "n", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 4).alias("percent"))


_EVENT_TYPES = ["click", "error", "purchase", "view"]


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS \"{t}\"" for t in _EVENT_TYPES) + " FROM events GROUP BY user_id")
def u_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Counts turned into columns."""
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", _EVENT_TYPES).count().na.fill(0)


@query(
    """WITH s AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi, least(20, greatest(5, CAST(floor(sqrt(count(*))) AS BIGINT))) AS bins FROM documents WHERE n_chars IS NOT NULL), b AS (SELECT least(CAST(floor((n_chars-lo)/CAST(hi-lo+1 AS DOUBLE)*bins) AS BIGINT), bins-1) AS bin FROM documents, s WHERE n_chars IS NOT NULL)
    SELECT i AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(0, bins-1)) AS i FROM s) LEFT JOIN (SELECT bin, count(*) AS n FROM b GROUP BY bin) ON i = bin"""
)
def u_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Equal-width histogram, empty bins kept."""
    docs = table(spark, d, "documents").where("n_chars is not null")
    s = docs.agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.least(F.lit(20), F.greatest(F.lit(5), F.floor(F.sqrt(F.count("*"))))).cast("bigint").alias("bins"))
    place = F.least(F.floor((F.col("n_chars") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * F.col("bins")), F.col("bins") - 1)
    counts = docs.crossJoin(F.broadcast(s)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return s.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1)).alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    """SELECT coalesce(a.id, b.id) AS id, coalesce(a.pos, b.pos) AS pos, a.row_id AS chunk_row, b.row_id AS relation_row FROM (SELECT document_id AS id, row_id, row_number() OVER (PARTITION BY document_id ORDER BY row_id) AS pos FROM chunks WHERE document_id IS NOT NULL) a
    FULL JOIN (SELECT source_id AS id, row_id, row_number() OVER (PARTITION BY source_id ORDER BY row_id) AS pos FROM relation_candidates WHERE source_id IS NOT NULL) b ON a.id = b.id AND a.pos = b.pos"""
)
def u_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """U4: each document's chunks and relations next to each other by position."""

    def placed(name: str, key: str, out: str) -> DataFrame:
        rows = table(spark, d, name).where(F.col(key).isNotNull()).select(F.col(key).alias("id"), "row_id")
        return running_total(rows, ["id"], "row_id", F.lit(1), "before").select("id", (F.col("before") + 1).alias("pos"), F.col("row_id").alias(out))

    return placed("chunks", "document_id", "chunk_row").join(placed("relation_candidates", "source_id", "relation_row"), ["id", "pos"], "full_outer").select("id", "pos", "chunk_row", "relation_row")


@query("SELECT row_id, stage, ms FROM (SELECT row_id, 'filtered' AS stage, rbac_filtered_count AS ms FROM audit_log UNION ALL SELECT row_id, 'documents', len(retrieved_document_ids) FROM audit_log) WHERE ms IS NOT NULL")
def u_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """Columns turned into rows."""
    docs = F.when(F.col("retrieved_document_ids").isNotNull(), F.size("retrieved_document_ids").cast("bigint"))
    wide = table(spark, d, "audit_log").select("row_id", F.col("rbac_filtered_count").alias("filtered"), docs.alias("documents"))
    return wide.unpivot("row_id", ["filtered", "documents"], "stage", "ms").where("ms is not null")


# further views

_MATCHED = f"list_filter(user_role, lambda r, i: list_contains({_LIST(CLASSES[1][1])}, r) AND list_position(user_role, r) = i)"


@query(f"SELECT row_id, array_to_string(CASE WHEN list_contains(user_role, 'Admin') THEN ['Admin'] ELSE {_MATCHED} END, '+') AS matched, coalesce(list_contains(user_role, 'Admin') OR len({_MATCHED}) > 0, false) AS allowed FROM audit_log")
def rb_matched(spark: SparkSession, d: str) -> DataFrame:
    """RB2: the roles of every request that let it read the second class, in the user's order."""
    roles = F.col("user_role")
    admin = F.coalesce(F.array_contains(roles, access.ADMIN), F.lit(False))
    matched = F.filter(F.array_distinct(roles), lambda r: F.array_contains(F.array(*[F.lit(x) for x in CLASSES[1][1]]), r))
    text = F.array_join(F.when(admin, F.array(F.lit(access.ADMIN))).otherwise(matched), "+")
    return table(spark, d, "audit_log").select("row_id", text.alias("matched"), (admin | (F.coalesce(F.size(matched), F.lit(0)) > 0)).alias("allowed"))


_ROLE_ROWS = f"{_ACL}, roled AS (SELECT a.row_id AS id, r.role FROM acl a, (SELECT unnest({_LIST(access.ROLES)}) AS role) r WHERE r.role = 'Admin' OR list_contains(a.roles, r.role))"


@query(
    f"""WITH {_SECURE}, lexed AS (SELECT query_id, id, CAST(cum AS BIGINT) AS rank FROM seen WHERE ok AND cum <= 20), vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x*x))) AS n FROM embeddings),
    near AS (SELECT q.query_id, b.id, round(1 - list_dot_product(a.v, b.v)/(a.n*b.n), 6) + 0.0 AS distance FROM q JOIN vec a ON a.id = q.query_id JOIN acl ON q.role = 'Admin' OR list_contains(acl.roles, q.role) JOIN vec b ON b.id = acl.row_id), densed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM near) WHERE rank <= 20)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, least(coalesce(bm25_rank, 1099511627776), coalesce(dense_rank, 1099511627776)), dense_rank NULLS LAST, bm25_rank NULLS LAST, id) AS fused_rank FROM (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.rank AS bm25_rank, b.rank AS dense_rank, round(CAST(coalesce(1.0/(60+a.rank),0)+coalesce(1.0/(60+b.rank),0) AS DOUBLE), 6) AS rrf FROM lexed a FULL JOIN densed b ON a.query_id=b.query_id AND a.id=b.id)"""
)
def rb_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """RB5: lexical and dense lists, each of rows that the role may read alone, fused by reciprocal ranks."""
    lexical = access.secure_top(_secured(spark, d), 20).select("query_id", "id", "rank")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    lists, asked = acl(spark, d).select(F.col("row_id").alias("id"), "roles"), _asked(spark, d)
    dense = None
    for role in ("HR_Manager", "Risk_Officer", "Guest"):
        own = vectors.join(lists.where(access.allowed(F.array(F.lit(role)), F.col("roles"))).select("id"), "id", "left_semi")
        of_role = vectors.withColumnRenamed("id", "query_id").join(asked.where(F.col("role") == role).select("query_id"), "query_id", "left_semi")
        found = cosine_top(own, of_role, 20)
        dense = found if dense is None else dense.unionByName(found)
    return fusion.reciprocal(lexical, dense).select("query_id", "id", "bm25_rank", "dense_rank", "rrf", "fused_rank")


@query(f"WITH {_SECURE} SELECT query_id, id, cum AS rank, p.document_id, p.title, 'ALLOWED' AS access_decision FROM (SELECT query_id, id, CAST(cum AS BIGINT) AS cum FROM seen WHERE ok AND cum <= 5) JOIN agribank_internal_policies p ON p.row_id = id")
def rb_decisions(spark: SparkSession, d: str) -> DataFrame:
    """RB6, RB7: secure results with their metadata and the decision."""
    meta = table(spark, d, "agribank_internal_policies").select(F.col("row_id").alias("id"), "document_id", "title")
    return access.secure_top(_secured(spark, d)).join(meta, "id", "left").select("query_id", "id", "rank", "document_id", "title", F.lit("ALLOWED").alias("access_decision"))


@query(f"WITH {_SECURE}, every AS (SELECT s.query_id, s.id, score, r.role, row_number() OVER (PARTITION BY s.query_id, r.role ORDER BY score DESC, s.id) AS rank FROM scored s JOIN acl a ON a.row_id = s.id, (SELECT unnest({_LIST(access.ROLES)}) AS role) r WHERE r.role = 'Admin' OR list_contains(a.roles, r.role)) SELECT query_id, role, id, rank FROM every WHERE rank <= 3")
def u_roles(spark: SparkSession, d: str) -> DataFrame:
    """The same question under every role side by side."""
    rows, asked = acl(spark, d), _asked(spark, d)
    scored = bm25_scores(rows.where("text is not null").select(F.col("row_id").alias("id"), "text"), asked)
    lists = rows.select(F.col("row_id").alias("id"), "roles")
    each = scored.join(lists, "id").select("query_id", "id", "score", "roles", F.explode(F.array(*[F.lit(r) for r in access.ROLES])).alias("role")).where(access.allowed(F.array("role"), F.col("roles")))
    order = Window.partitionBy("query_id", "role").orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 3").select("query_id", "role", "id", "rank")


@query("SELECT row_id, request_id, upper(trim(status)) AS status, len(list_distinct(retrieved_document_ids)) AS documents, CASE WHEN coalesce(len(list_distinct(retrieved_document_ids)), 0) = 0 AND coalesce(rbac_filtered_count, 0) > 0 THEN 'DENIED' ELSE 'SUCCESS' END AS decision FROM audit_log WHERE request_id IS NOT NULL")
def au_events(spark: SparkSession, d: str) -> DataFrame:
    """AU1, AU2: audit events as they are built: status in capitals, distinct documents; nothing found and something filtered is a denial."""
    docs = F.when(F.col("retrieved_document_ids").isNotNull(), F.size(F.array_distinct(F.array_compact("retrieved_document_ids"))).cast("bigint"))
    denied = (F.coalesce(docs, F.lit(0)) == 0) & (F.coalesce("rbac_filtered_count", F.lit(0)) > 0)
    return table(spark, d, "audit_log").where("request_id is not null").select("row_id", "request_id", F.upper(F.trim("status")).alias("status"), docs.alias("documents"), F.when(denied, "DENIED").otherwise("SUCCESS").alias("decision"))


_CORE = ["két", "thẻ trắng", "hợp đồng"]
_AUT = "regexp_extract_all(lower({}), '([\\p{{L}}\\p{{N}}]+)')"


@query(f"SELECT row_id, coalesce(list_bool_or(list_transform({_LIST(_CORE)}, lambda w: contains(lower(question), w) AND contains(lower(ground_truth), w))), false) OR len(list_intersect(list_filter({_AUT.format('question')}, lambda x: length(x) >= 4), list_filter({_AUT.format('ground_truth')}, lambda x: length(x) >= 4))) >= 2 AS relevant FROM qa_dataset WHERE question IS NOT NULL AND ground_truth IS NOT NULL")
def au_guard(spark: SparkSession, d: str) -> DataFrame:
    """AU3: an answer is relevant if it shares a core term with the question, else two longer words."""
    q, a = F.lower("question"), F.lower("ground_truth")
    core = F.exists(F.array(*[F.lit(w) for w in _CORE]), lambda w: F.contains(q, w) & F.contains(a, w))
    long = lambda c: F.filter(tokens(c), lambda x: F.length(x) >= 4)
    both = F.size(F.array_intersect(long(F.col("question")), long(F.col("ground_truth")))) >= 2
    return table(spark, d, "qa_dataset").where("question is not null and ground_truth is not null").select("row_id", (core | both).alias("relevant"))


@query("SELECT row_id, id FROM metadata WHERE linh_vuc = 'Rủi ro'")
def u_equal(spark: SparkSession, d: str) -> DataFrame:
    """U8: rows of one domain."""
    return table(spark, d, "metadata").where(F.col("linh_vuc") == "Rủi ro").select("row_id", "id")
