import random

import pytest
from pyspark.sql import functions as F

from vankho.functions import text as T
from vankho.operators import chunking, fusion, hierarchy
from vankho.operators.lexical import bm25_every
from vankho.operators.ordered import forward_fill, greedy_windows

CHUNK = "row_id bigint, document_id string, place bigint, text string, structure struct<chapter:string,section:string,article:string,clause:string,point:string>, clash string"


def _chunks(spark, rows):
    return spark.createDataFrame([(i, d, i, t, (c, None, a, None, None), "x") for i, (d, t, c, a) in enumerate(rows)], CHUNK)


def test_greedy_windows_against_a_loop(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(20)}", i, rnd.choice([0, 5, 40, 99, 100, 130])) for i in range(1500)]
    got = {r.place: r.window for r in greedy_windows(spark.createDataFrame(rows, "key string, place bigint, n bigint").repartition(7), ["key"], "place", "n", 100, 2).collect()}
    state = {}
    for key, place, n in rows:
        w, used = state.get(key, (0, None))
        state[key] = (w, used + 2 + n) if used is not None and used + 2 + n <= 100 else (w + 1, n)
        assert got[place] == state[key][0]


def test_resolution_order(spark):
    rows = [
        ("a", "mở đầu", None, None), ("a", "Chương II\n## Điều 4. Phạm vi", None, None), ("a", "tiếp theo", None, None), ("a", "Điều 9. Khác", "Chương III", "điều 5a"),
        ("a", "theo Điều 7 và quy định tại Điều 8", None, None), ("b", None, None, None),
    ]
    got = {r.row_id: (r.chapter, r.article, r.method, r.ambiguous) for r in hierarchy.resolve(_chunks(spark, rows), "document_id", "place").collect()}
    assert got == {
        0: (None, None, "document_fallback", True), 1: ("Chương II", "Điều 4", "heading_inferred", False), 2: ("Chương II", "Điều 4", "carried_forward", False),
        3: ("Chương III", "Điều 5a", "metadata", True), 4: ("Chương III", "Điều 5a", "carried_forward", False), 5: (None, None, "document_fallback", True),
    }


def test_a_heading_within_a_text_counts_later(spark):
    rows = [("a", "Điều 1. Đầu", None, None), ("a", "phần còn lại của điều trên rất dài\nĐiều 2. Sau", None, None), ("a", "nội dung", None, None)]
    got = {r.row_id: (r.article, r.context) for r in hierarchy.resolve_from_start(_chunks(spark, rows), "document_id", "place").collect()}
    assert got == {0: ("Điều 1", "Điều 1"), 1: ("Điều 1", "Điều 2"), 2: ("Điều 2", "Điều 2")}


def test_runs(spark):
    rows = [("a", i, k) for i, k in enumerate(["x", "x", None, None, "x", "y"])]
    got = [r.run for r in hierarchy.runs(spark.createDataFrame(rows, "key string, place bigint, label string"), "key", "place", "label").orderBy("place").collect()]
    assert got == [1, 1, 2, 2, 3, 4]


def test_fill_before_the_row(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(["a", None, "b", None])], "key string, place bigint, v string")
    got = [r.out for r in forward_fill(df, ["key"], "place", "v", "out", block=2, own=False).orderBy("place").collect()]
    assert got == [None, "a", "a", "b"]


@pytest.mark.parametrize("text", ["", "   ", "ngắn", "một hai ba bốn năm sáu bảy tám", "x" * 45, "từ " * 40 + "y" * 30])
def test_pieces(text):
    pieces = T.pieces_within(text, 10)
    assert all(0 < len(p) <= 10 for p in pieces)
    assert "".join("".join(pieces).split()) == "".join(text.split())


def test_units(spark):
    text = "Đoạn một ngắn.\n\nĐoạn hai dài hơn nhiều. Nó có hai câu; câu sau còn dài hơn câu trước.\nDòng mới"
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, " ", "x")], "doc_id bigint, text string, pos string")
    got = chunking.unit_chunks(docs, 40).orderBy("doc_id", "pos").collect()
    assert {r.doc_id for r in got} == {1} and all(len(r.text) <= 40 for r in got)
    assert "".join("".join(r.text for r in got).split()) == "".join(text.split())


def test_labels(spark):
    df = spark.createDataFrame([(1, "Theo [E1] và [e2], [E7]  [E1].", {"E1": "A", "E2": "B"}), (2, "không nhãn", {}), (3, None, {"E1": "A"})], "id bigint, answer string, shown map<string,string>")
    got = {r.id: (r.answer, r.labels, r.unknown) for r in fusion.cited(df, "answer", "shown").collect()}
    assert got[1] == ("Theo A và B, A.", ["E1", "E2"], 1) and got[2] == ("không nhãn", [], 0) and got[3][0] is None


def test_every_document_is_ranked(spark):
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(["két bạc", "thẻ", "sổ quỹ", None, ""])], "id bigint, text string").where("text is not null")
    asked = spark.createDataFrame([(1, "két"), (2, "!!")], "query_id bigint, text string")
    got = [(r.id, r.score > 0) for r in bm25_every(corpus, asked, 3).orderBy("rank").collect()]
    assert got == [(0, True), (1, False), (2, False)]


def test_text_forms(spark):
    row = spark.createDataFrame([("---\ntitle: Két\nid: 7\n---\n[[a|b]] [[c#d]] [[e]]", "```json\n{\"k\": 1}\n```", 'a/b: "c"?  d_')], "page string, fenced string, name string")
    got = row.select(T.front_matter(F.col("page")).alias("m"), T.wiki_links(F.col("page")).alias("l"), T.unfenced(F.col("fenced")).alias("j"), T.file_name(F.col("name")).alias("f")).first()
    assert got.m == {"title": "Két", "id": "7"} and got.l == ["a", "c", "e"] and got.j == '{"k": 1}' and got.f == "a_b_c_d"
