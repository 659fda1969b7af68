import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vankho.functions.docnum import Issuers, with_number_key
from vankho.operators.orphans import in_stretches, orphan_references, pending_snapshots

REF = "key string, at timestamp_ntz, row_id bigint, source_table string, day string"
PAR = "key string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"


def _cases(seed, n_refs=300, n_parents=80):
    rnd = random.Random(seed)
    start = datetime(2025, 1, 1)
    when = lambda: start + timedelta(hours=rnd.randrange(24 * 90))
    key = lambda: "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(25)}"
    refs = [(key() if rnd.random() > 0.03 else None, when() if rnd.random() > 0.03 else None, i, rnd.choice("ab"), "clash") for i in range(n_refs)]
    parents = [(key(), when() if rnd.random() > 0.1 else None, when() if rnd.random() < 0.5 else None) for _ in range(n_parents)]
    return refs, parents


def _held(key, at, parents):
    return any(k == key and a is not None and a <= at and (z is None or z > at) for k, a, z in parents)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    refs, parents = _cases(seed)
    got = {r.row_id for r in orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR)).collect()}
    want = {i for k, at, i, *_ in refs if k is not None and at is not None and not _held(k, at, parents)}
    assert got == want


def test_snapshots_against_brute_force(spark):
    refs, parents = _cases(7)
    rows = pending_snapshots(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR)).collect()
    ends = {"2025-01": datetime(2025, 2, 1), "2025-02": datetime(2025, 3, 1), "2025-03": datetime(2025, 4, 1)}
    for r in rows:
        end = ends[r.period] - timedelta(microseconds=1)
        want = sum(1 for k, at, _, s, _ in refs if k and at and s == r.source_table and at <= end and not _held(k, end, parents))
        assert r.pending == want


def test_stretches_equal_one_run(spark):
    refs, parents = _cases(11)
    r, p = spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR)
    whole = {x.row_id for x in orphan_references(r, p).collect()}
    starts = [datetime(2025, 1, 20, 7), datetime(2025, 2, 1), datetime(2025, 2, 25), datetime(2026, 1, 1)]
    found, state = in_stretches(r, p, starts)
    assert {x.row_id for x in found.collect()} == whole
    # what waits at the end is what the snapshot of the last month says
    waits = {x.source_table: x.n for x in state.where("held <= 0 and source_table is not null").groupBy("source_table").agg(F.sum("asked").alias("n")).collect()}
    last = {x.source_table: x.pending for x in pending_snapshots(r, p).where("period = '2025-03'").collect()}
    assert waits == last


def test_moments(spark):
    t = datetime(2025, 1, 5, 10)
    refs = spark.createDataFrame([("a", t, 1, "x", ""), ("b", t, 2, "x", ""), ("c", t, 3, "x", "")], REF)
    parents = spark.createDataFrame([("a", t, None), ("b", t - timedelta(days=40), t), ("c", t, t)], PAR)
    assert {r.row_id for r in orphan_references(refs, parents).collect()} == {2, 3}


def test_empty_tables(spark):
    none_r, none_p = spark.createDataFrame([], REF), spark.createDataFrame([], PAR)
    one = spark.createDataFrame([("a", datetime(2025, 1, 1), 1, "x", "")], REF)
    assert orphan_references(none_r, none_p).count() == 0
    assert orphan_references(one, none_p).count() == 1


KNOWN = Issuers(("hdcv", "nhdt", "stc", "ubnd", "bkhdb"), (("ngan hang dieu tiet quoc gia", "nhdt"), ("nha bang dieu tiet", "nhdt"), ("uy ban nhan dan", "ubnd")))


@pytest.mark.parametrize(
    ("typed", "key"),
    [
        ("922 / 2021/TT - NHĐT", "922/2021/tt-nhdt"), ("8455_2016_nq_hđcv", "8455/2016/nq-hdcv"), ("Số: 04042/2008-TT/NHĐT)", "4042/2008/tt-nhdt"),
        ("nq-stc 8687/2023", "8687/2023/nq-stc"), ("7268_21_CT_UBND", "7268/2021/ct-ubnd"), ("296\\2OOO\\QĐ-UBND", "296/2000/qd-ubnd"),
        ("Quyết định 8855/2019 của Ngân hàng Điều tiết Quốc gia", "8855/2019/qd-nhdt"), ("Nhà băng Điều tiết - Chỉ thị 5152/2019)", "5152/2019/ct-nhdt"),
        ("5990.2014.NQ.HHĐCV", "5990/2014/nq-hdcv"), ("9273.2001.NQ.NĐHT", "9273/2001/nq-nhdt"), ("2020/445/CT-STC", "445/2020/ct-stc"), ("no number", "no number"), (None, ""),
    ],
)
def test_number_key(spark, typed, key):
    df = with_number_key(spark.createDataFrame([(typed, "x")], "v string, key2 string"), "v", KNOWN)
    assert df.select(F.col("key")).collect()[0].key == key
