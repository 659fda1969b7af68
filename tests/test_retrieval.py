import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vankho.functions import checks
from vankho.functions import text as T
from vankho.operators import access, chunking, fusion, graph, lexical
from vankho.operators.dense import cosine_top
from vankho.operators.lexical import bm25, bm25_scores
from vankho.operators.ordered import following, forward_fill, latest, running_total


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).collect()[0].r


def test_tokens(spark):
    assert one(spark, lambda c: T.tokens(c), "Điều 4, a_b!") == ["điều", "4", "a", "b"]
    assert one(spark, lambda c: T.tokens(c, "b"), "Điều 4, a_b!") == ["điều", "4", "a_b"]
    assert one(spark, lambda c: T.tokens(c, "c"), "Theo 46/2023/NĐ-CP.") == ["theo", "46/2023/nđ-cp"]
    assert one(spark, lambda c: T.tokens(c), None) == []


def test_labels_and_citation(spark):
    assert one(spark, T.article_label, "điều 4. Phạm vi") == "Điều 4"
    assert one(spark, T.article_slug, "Điều 4") == "d04"
    assert one(spark, T.article_slug, None) == "doc_fallback"
    assert one(spark, T.numeric_suffix, "x:d01:w07") == 7
    assert one(spark, lambda c: T.citation(F.lit(" "), F.lit("t" * 60), F.lit("1"), c, F.lit("Chương 1"), F.lit("k")), "Điều 2. Gì đó") == "[" + "t" * 50 + "... | Điều 2 | k]"


def test_html_text_and_roles(spark):
    assert one(spark, T.html_text, "<style>x</style><p>A&nbsp; b</p><script>1</script><div>c</div>") == "A b\nc"
    assert one(spark, T.parse_roles, '["A", "B"]') == ["A", "B"]
    assert one(spark, T.parse_roles, "[A, 'B']") == ["A", "B"]
    assert one(spark, T.parse_roles, "") == ["Guest"]


def test_checks(spark):
    assert one(spark, lambda c: checks.vector_ok(c, 2), [0.0, 1.0], "array<double>")
    assert not one(spark, lambda c: checks.vector_ok(c, 2), [0.0, float("nan")], "array<double>")
    assert not one(spark, lambda c: checks.vector_ok(c, 2), [0.0, 0.0], "array<double>")
    assert not one(spark, lambda c: checks.vector_ok(c, 2), None, "array<double>")
    assert not one(spark, lambda c: checks.date_ok(c), "31/02/2020")


def test_reciprocal_rank_fusion(spark):
    lex = spark.createDataFrame([(1, "X", 1), (1, "A", 2)], "query_id int, id string, rank bigint")
    den = spark.createDataFrame([(1, "X", 1, 0.1), (1, "B", 2, 0.2)], "query_id int, id string, rank bigint, distance double")
    rows = fusion.reciprocal(lex, den).orderBy("fused_rank").collect()
    assert rows[0].id == "X" and rows[0].rrf == round(2 / 61, 6)
    assert {r.id for r in rows} == {"X", "A", "B"}
    weighted = fusion.reciprocal(lex, den, dense_weight=0.0).where("id = 'B'").collect()[0]
    assert weighted.rrf == 0.0


def test_across_queries_and_parents(spark):
    lists = spark.createDataFrame([(1, 0, 1.5, "c", 1), (1, 1, 1.0, "c", 2)], "query_id int, variant int, weight double, id string, rank bigint")
    assert fusion.across_queries(lists).collect()[0].score == round(1.5 / 61 + 1 / 62, 6)
    children = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2)], "query_id int, id string, rank bigint")
    owner = spark.createDataFrame([("a", "P"), ("b", "P"), ("c", "Q")], "id string, parent_id string")
    top = fusion.parents_of(children, owner).orderBy("rank").collect()
    assert (top[0].parent_id, top[0].score) == ("P", round(1 / 61 + 1 / 63, 6))


def test_budget_passes_over_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, "a", 1, 900), (1, "b", 2, 500), (1, "c", 3, 90)], "query_id int, parent_id string, rank bigint, chars bigint")
    assert [r.parent_id for r in fusion.within_budget(rows, 1000).orderBy("place").collect()] == ["a", "c"]
    assert [r.parent_id for r in fusion.within_budget(rows, 10).collect()] == ["a"]


def test_bm25_against_plain_python(spark):
    docs = {1: "thẻ trắng mất", 2: "thẻ đen", 3: "két két bạc thẻ", 4: "", 5: None, 6: "bạc"}
    query = "két thẻ thẻ"
    corpus = spark.createDataFrame(list(docs.items()), "id bigint, text string")
    got = {r.id: r.score for r in bm25(corpus, spark.createDataFrame([(9, query)], "query_id bigint, text string")).collect()}
    toks = {i: (t or "").split() for i, t in docs.items()}
    n, mean = len(docs), sum(map(len, toks.values())) / len(docs)
    vocabulary = {w for t in toks.values() for w in t}
    idf = {w: math.log((n - df + 0.5) / (df + 0.5)) for w in vocabulary for df in [sum(w in t for t in toks.values())]}
    average = sum(idf.values()) / len(idf)
    idf = {w: (0.25 * average if v < 0 else v) for w, v in idf.items()}
    for i, t in toks.items():
        score = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in query.split() if w in t)
        assert got.get(i, 0) == pytest.approx(score, abs=1e-4)


@pytest.mark.parametrize("words", [300, 12, 3])
def test_bm25_in_blocks_keeps_the_best_of_all_scores(spark, monkeypatch, words):
    """Blocks of queries and rows, frequent and rare words, equal texts, and weights below zero (3 words, all frequent)."""
    for name, value in {"QUERY_BLOCK": 7, "ROW_BLOCK": 60, "ROWS": 16, "TOGETHER": 3, "FULL": 4}.items():
        monkeypatch.setattr(lexical, name, value)
    rnd = random.Random(words)
    text = lambda n: " ".join(f"w{min(rnd.randrange(words), rnd.randrange(words))}" for _ in range(n))
    texts = [text(rnd.randrange(3 if words == 3 else 0, 9)) for _ in range(150)]
    corpus = spark.createDataFrame([(i * 7 % 1009, rnd.choice(texts)) for i in range(300)] + [(2000, None), (2001, "")], "id bigint, text string")
    queries = spark.createDataFrame([(i, text(rnd.randrange(0, 6))) for i in range(20)] + [(90, None), (91, "nowhere")], "query_id bigint, text string")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    want = bm25_scores(corpus, queries).withColumn("rank", F.row_number().over(best)).where("rank <= 5")
    found = bm25(corpus, queries, 5)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # before, every score of every query was joined and shuffled
    assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("kind", ["a", "b", "c"])
def test_bm25_counts_the_tokens_that_spark_finds(spark, kind):
    """Letters of several lengths in bytes, letters that lower to two characters or by their place, NULs, joints, empty and null texts."""
    texts = ["Điều 12/2023/TT-NHNN, điều_lệ -a/b.-", None, "", " ..- ", "İstanbul ΣΟΦΟΣ σ", "a\0b", "ⅷ x² 𝒳y 中文 ９", "tie\u0302\u0301ng", "\0", "ĐIỀU điều Điều"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    want = [list(r.t) for r in df.orderBy("id").select(T.tokens(F.col("text"), kind).alias("t")).collect()]
    terms, code, owner = lexical._tokens(pa.array(texts), lexical._Letters(kind))
    assert [[terms[int(c)].as_py() for c in code[owner == i]] for i in range(len(texts))] == want


@pytest.mark.parametrize(("words", "few"), [(40, False), (12, True), (40, True)])
def test_bm25_adds_up_what_queries_share_once(monkeypatch, words, few):
    """Sums shared by queries against sums of each row, with little room for shared ones, also for weights of zero and below."""
    for name, value in {"DEPTH": 2, "PENDING": 30, "TOGETHER": 3, "FULL": 24, "WORTH": 2, "RARE": 4}.items():
        monkeypatch.setattr(lexical, name, value)
    monkeypatch.setattr(lexical, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c), "partitionId": classmethod(lambda c: 0)}))
    rnd = random.Random(words)
    text = lambda n: " ".join(f"w{min(rnd.randrange(words), rnd.randrange(words))}" for _ in range(n))
    rows = [(i * 7 % 1009, text(rnd.randrange(0, 9))) for i in range(300)]
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "text": [t for _, t in rows]})
    asked = [" ".join(dict.fromkeys(text(rnd.randrange(1, 9)).split())) for _ in range(60)]
    weights = [[[2.0, -1.0, 0.0][int(w[1:]) % 3] if few else 1.0 + int(w[1:]) / 7 for w in q.split()] for q in asked]
    best = lexical._Best(pa.array(asked), pa.array(weights, pa.list_(pa.float64())), 4.0, 5, 4)
    assert best.pairs and sum(map(len, best.sums)) < sum(map(len, best.columns))  # before, every term of every query was added up by itself
    for block in lexical._blocked(64, "a")(iter([batch])):
        best.add({n: block[n][0] for n in block.schema.names})
    for q, (terms, w) in enumerate(zip(asked, weights)):
        want = []
        for i, t in rows:
            own = t.split()
            parts = [x * own.count(y) * 2.5 / (own.count(y) + 1.5 * (0.25 + 0.75 * len(own) / 4.0)) for x, y in zip(w, terms.split()) if y in own]
            if parts:
                want.append((-math.copysign(math.floor(abs(sum(parts)) * 1e4 + 0.5), sum(parts)) / 1e4, i))
        assert list(zip((-best.score[q, : best.count[q]]).tolist(), best.id[q, : best.count[q]].tolist())) == sorted(want)[:5]


def test_cosine_in_blocks(spark):
    rnd = np.random.default_rng(1)
    m = rnd.normal(size=(60, 8))
    m[7] = m[3]
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(100, None), (101, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    got = cosine_top(df, df.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 5, query_block=2, row_block=17)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 20, 40):
        d = np.round(1 - unit @ unit[q], 6)
        want = sorted(range(60), key=lambda i: (d[i], i))[:5]
        assert [r.id for r in got.where(f"query_id = {q}").orderBy("rank").collect()] == want


def test_chunkers(spark):
    text = "".join(f"từ{i} " for i in range(300)).strip()
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "ngắn")], "doc_id bigint, text string")
    got = {}
    for r in chunking.fixed_size(docs, 100, 20).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    want, start = [], 0
    while True:
        end = min(start + 100, len(text))
        if end < len(text) and (space := text.rfind(" ", start, end)) > start + 50:
            end = space
        want.append((start, end))
        if start + 100 >= len(text):
            break
        start += 80
    assert got == {1: want, 4: [(0, 4)]}
    sentences = spark.createDataFrame([(1, "Aaaa bbbb. Cccc dddd. Eeee ffff.")], "doc_id bigint, text string")
    assert [r.text for r in chunking.sentence_chunks(sentences, 22, 5).orderBy("pos").collect()] == ["Aaaa bbbb. Cccc dddd.", "Eeee ffff."]


def test_ordered_blocks_equal_plain_windows(spark):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(4)}", i, rnd.choice([None, i])) for i in rnd.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "k string, p bigint, v bigint")
    w = Window.partitionBy("k").orderBy("p")
    want = df.select("k", "p", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("f"), F.lead("p").over(w).alias("n"), F.coalesce(F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("t"))
    got = running_total(following(forward_fill(df, ["k"], "p", "v", "f", 16), ["k"], "p", "p", "n", 16), ["k"], "p", F.col("p"), "t", 16)
    assert sorted(want.collect()) == sorted(got.select("k", "p", "f", "n", "t").collect(), key=tuple) or {tuple(r) for r in want.collect()} == {tuple(r) for r in got.select("k", "p", "f", "n", "t").collect()}
    assert {(r.k, r.p) for r in latest(df, ["k"], ["p"]).collect()} == {(k, max(p for kk, p, _ in rows if kk == k)) for k, *_ in rows}


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "T"), ("b", "c", "T"), ("c", "d", "T"), ("a", "a", "T"), ("a", "b", "T")], "src string, dst string, type string")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {(r.target, r.hop) for r in graph.expand(seeds, edges, 2).collect()} == {("b", 1), ("c", 2)}
    assert {tuple(r) for r in graph.chains(edges, "T").collect()} == {("a", "b", "c"), ("b", "c", "d"), ("a", "a", "b")}
    vertices = spark.createDataFrame([("a", "D"), ("z", "D")], "id string, label string")
    assert [r.id for r in graph.lonely(vertices, edges).collect()] == ["z"]
    assert graph.with_stubs(vertices, edges, "S").where("label = 'S'").count() == 3


def test_secure_top_counts_what_it_hides(spark):
    rows = [(1, i, float(10 - i), i % 2 == 0) for i in range(8)] + [(2, 5, 1.0, False), (3, 1, 1.0, True)]
    got = access.secure_top(spark.createDataFrame(rows, "query_id int, id bigint, score double, ok boolean"), 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.rank, r.filtered_out) for r in got] == [(1, 0, 1, 1), (1, 2, 2, 1), (3, 1, 1, 0)]


def test_roles(spark):
    assert one(spark, access.valid_roles, ["X", "Guest", "Guest"], "array<string>") == ["Guest"]
    assert one(spark, access.valid_roles, None, "array<string>") == ["Guest"]
    assert one(spark, lambda c: access.allowed(F.array(F.lit("Guest")), c), None, "array<string>") is False
    assert one(spark, lambda c: access.allowed(F.array(F.lit("Admin")), c), None, "array<string>") is True


def test_order_of_chunks_does_not_wrap_at_a_million_rows(spark, tmp_path):
    from vankho.plans.retrieval import c_next, h_resolve

    ids = [999_999, 1_000_000, 1_999_999, 2_000_000]
    rows = [(i, "d", str(i), "s", ("Điều 1", "Chương I" if i == ids[0] else None), None) for i in ids]
    df = spark.createDataFrame(rows, "row_id bigint, document_id string, chunk_id string, source string, structure struct<article:string,chapter:string>, parent_id string")
    df.write.parquet(str(tmp_path / "chunks.parquet"))
    assert {tuple(r) for r in c_next(spark, str(tmp_path)).collect()} == set(zip(ids, ids[1:]))
    assert {r.chapter for r in h_resolve(spark, str(tmp_path)).collect()} == {"Chương I"}


def test_factor_searches_once(spark, monkeypatch):
    from vankho.plans import answers, retrieval

    calls = []

    def counted(*args):
        calls.append(args)
        return bm25(*args)

    for module in (answers, retrieval):
        monkeypatch.setattr(module, "bm25", counted)
    assert answers.x_factor(spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1  # before, the children were searched a second time for their parents


@pytest.mark.parametrize("name", ["x_rerank", "x_comparison"])
def test_only_candidates_texts_are_split_for_the_rerank(spark, name):
    from vankho.plans import answers, retrieval

    found = {**retrieval.QUERIES, **answers.QUERIES}[name](spark, "/root/testdata/sf0.001")
    lines = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    split = [i for i, x in enumerate(lines) if "regexp_extract_all(lower(coalesce(text#" in x]
    join = max(i for i, x in enumerate(lines) if "Join LeftOuter" in x)
    assert split and max(split) < join  # before, the tokens of every chunk were found and shuffled
