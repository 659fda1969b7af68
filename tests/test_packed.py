import json

import pytest

from vankho.operators.packed import unpack

PLAIN = [
    ("Guest", ["Guest"]),
    ('["A", "B"]', ["A", "B"]),
    ("['A', 'Nhóm \"Ca đêm\"']", ["A", 'Nhóm "Ca đêm"']),
    ('["A", "Nhóm \\"Ca đêm\\""]', ["A", 'Nhóm "Ca đêm"']),
    ('"A","Nhóm ""Ca đêm"""', ["A", 'Nhóm "Ca đêm"']),
    ("(A|B|C)", ["A", "B", "C"]),
    ("{A  B  C}", ["A", "B", "C"]),
    ("A；B\tC、D", ["A", "B", "C", "D"]),
    ("Staff,,Auditor_L2,", ["Staff", "Auditor_L2"]),
    ("Giám đốc chi nhánh|Auditor_L2", ["Giám đốc chi nhánh", "Auditor_L2"]),
    ("A B", ["A", "B"]),
    ('["A, B", "C"', ["A, B", "C"]),
    ("['Trưởng phòng (HR, L2)', 'T']", ["Trưởng phòng (HR, L2)", "T"]),
    ('["Ki\\u1ec3m so\\u00e1t"]', ["Kiểm soát"]),
    ("A, A", ["A", "A"]),
    (" , A", ["A"]),
    *[(x, []) for x in (None, "", "  ", "null", "NaN", "-", "[]", "N/A")],
]
BRACKETED = [
    ("[1/2/X | Điều 2; điểm b | d1];[3/4/Y | Điều 1, khoản 2 | d2]", ["[1/2/X | Điều 2; điểm b | d1]", "[3/4/Y | Điều 1, khoản 2 | d2]"]),
    ('["[a | b | c]", "d – e – f"]', ["[a | b | c]", "d – e – f"]),
    ("[a | b | c]", ["[a | b | c]"]),
    ("[a | b | c]\n[d | e | f], ", ["[a | b | c]", "[d | e | f]"]),
    ('["a – b', ["a – b"]),
]


@pytest.mark.parametrize(("cases", "bracketed"), [(PLAIN, False), (BRACKETED, True)])
def test_written_forms(spark, cases, bracketed):
    df = spark.createDataFrame([(i, text, "x") for i, (text, _) in enumerate(cases)], "row_id bigint, v string, pos string")
    got = {}
    for r in unpack(df, "v", bracketed).orderBy("row_id", "pos").collect():
        got.setdefault(r.row_id, []).append((r.pos, r.item_value))
    for i, (text, want) in enumerate(cases):
        assert got.get(i, []) == list(enumerate(want, 1)), text


def test_json_round_trip(spark):
    lists = [["a"], ["a, b", 'say "x"', "c;d"], ["đ | e", "f/g", "h i", "(j)"]]
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=bool(i % 2))) for i, v in enumerate(lists)], "row_id bigint, v string")
    got = {r.row_id: r.v for r in unpack(df, "v").groupBy("row_id").agg({"item_value": "collect_list"}).toDF("row_id", "v").collect()}
    assert {k: sorted(v) for k, v in got.items()} == {i: sorted(v) for i, v in enumerate(lists)}


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], "row_id bigint, v string")
    assert unpack(empty, "v").count() == 0
    long = spark.createDataFrame([(1, "|".join(f"v{i}" for i in range(20000)))], "row_id bigint, v string")
    assert unpack(long, "v").count() == 20000
