import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vankho.sources import files
from vankho.streaming.live import denied_by_window, orphan_changes


def test_chunk_files(spark, tmp_path):
    chunk = {"chunk_id": "c1", "strategy": "semantic", "source": "s", "page_start": 1, "page_end": 1, "text": "x", "structure": {"article": "Điều 1"}}
    (tmp_path / "a.json").write_text(json.dumps([chunk]))
    (tmp_path / "b.json").write_text(json.dumps({"chunks": [{**chunk, "chunk_id": "c2", "strategy": "hierarchical"}]}))
    rows = files.read_chunks(spark, str(tmp_path)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.file, r.place) for r in rows] == [("c1", "a.json", 1), ("c2", "b.json", 1)]
    assert [r.chunk_id for r in files.read_chunks(spark, str(tmp_path), "semantic").collect()] == ["c1"]


def test_csv_audit_and_fingerprints(spark, tmp_path):
    (tmp_path / "t.csv").write_text('﻿id,v\n01,"a\nb"\n')
    assert files.read_table_text(spark, str(tmp_path / "t.csv")).collect()[0].asDict() == {"id": "01", "v": "a\nb"}
    log = tmp_path / "log"
    files.append_audit(spark.createDataFrame([("r1", "OK", "k")], "request_id string, status string, api_key string"), str(log))
    (log / "bad.json").write_text("{broken\n")
    assert [r.asDict() for r in files.read_audit(spark, str(log)).collect()] == [{"request_id": "r1", "status": "OK"}]
    assert files.fingerprints(spark, str(tmp_path / "t.csv")).collect()[0].bytes == 17


def test_html_blocks(spark):
    html = "<div><p>Một</p><table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table></div><div>lá</div><h2>Hai</h2>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")
    got = files.html_blocks(df, "html").orderBy("place").collect()
    assert [(r.tag, r.text) for r in got] == [("p", "Một"), ("table", "| a | b |\n| --- | --- |\n| 1 | 2 |"), ("div", "lá"), ("h2", "Hai")]


def test_publish(spark, tmp_path):
    files.publish(spark.range(3).toDF("id"), str(tmp_path / "x"), "1")
    files.publish(spark.range(5).toDF("id"), str(tmp_path / "x"), "2")
    assert files.published(spark, str(tmp_path / "x")).count() == 5


@pytest.mark.parametrize("batches", [1, 3])
def test_orphan_stream(spark, tmp_path, batches):
    day = lambda n: datetime(2025, 1, n)
    events = [("a", day(1), "reference"), ("a", day(2), "load"), ("a", day(3), "reference"), ("a", day(4), "delete"), ("b", day(5), "load"), ("b", day(6), "reference"), ("a", day(7), "load")]
    source, out = tmp_path / "in", tmp_path / "out"
    for i in range(batches):
        part = events[i * len(events) // batches : (i + 1) * len(events) // batches]
        spark.createDataFrame(part, "key string, at timestamp, kind string").coalesce(1).write.mode("append").parquet(str(source / f"b={i}"))
    stream = spark.readStream.schema("key string, at timestamp, kind string").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(source / "b=*"))
    q = orphan_changes(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(out))
    q.awaitTermination(120)
    got = [(r.key, r.at.day, r.event, r.n) for r in spark.read.parquet(str(out)).orderBy("at").collect()]
    assert got == [("a", 1, "opened", 1), ("a", 2, "resolved", 1), ("a", 4, "reopened", 2), ("a", 7, "resolved", 2)]
    # the state kept by stretches of time says the same of every moment between
    from vankho.operators.orphans import in_stretches

    refs = spark.createDataFrame([(k, at, "t") for k, at, kind in events if kind == "reference"], "key string, at timestamp, source_table string")
    loads = {("a", day(2)): day(4), ("b", day(5)): None, ("a", day(7)): None}
    parents = spark.createDataFrame([(k, at, gone) for (k, at), gone in loads.items()], "key string, loaded_at timestamp, deleted_at timestamp")
    sign = {"opened": 1, "reopened": 1, "resolved": -1}
    for end in (2, 3, 5, 8):
        until = day(end)
        _, state = in_stretches(refs.where(F.col("at") < until), parents.where(F.col("loaded_at") < until).withColumn("deleted_at", F.when(F.col("deleted_at") < until, F.col("deleted_at"))), [])
        waits = state.where("held <= 0 and source_table is not null").agg(F.coalesce(F.sum("asked"), F.lit(0))).first()[0]
        assert waits == sum(sign[e] * n for _, at, e, n in got if at < end)


def test_denied_stream(spark, tmp_path):
    rows = [("r1", datetime(2025, 1, 1, 1), "DENIED"), ("r1", datetime(2025, 1, 1, 1), "DENIED"), ("r2", datetime(2025, 1, 1, 1, 30), "SUCCESS"), ("r3", datetime(2025, 2, 1), "DENIED")]
    spark.createDataFrame(rows, "request_id string, ingested_at timestamp, status string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("request_id string, ingested_at timestamp, status string").parquet(str(tmp_path / "in"))
    q = denied_by_window(stream).writeStream.format("memory").queryName("denied").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start.hour, r.n, r.denied) for r in spark.table("denied").where("start < '2025-01-02'").collect()}
    assert (1, 2, 1) in got


def test_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, text string")
    files.export_report(df, str(tmp_path / "r"), "Counts")
    assert spark.read.csv(str(tmp_path / "r/csv"), header=True).count() == 2
    page = "\n".join(r.value for r in spark.read.text(str(tmp_path / "r/markdown")).collect())
    assert page.startswith("# Counts") and "| 1 | a b |" in page


def test_publish_asks_first(spark, tmp_path):
    with pytest.raises(ValueError):
        files.publish(spark.range(3).toDF("id"), str(tmp_path / "x"), "1", F.col("id") < 2)
    assert not (tmp_path / "x").exists()
    files.publish(spark.range(3).toDF("id"), str(tmp_path / "x"), "1", F.col("id") < 3)
    ids = spark.createDataFrame([(1,), (7,)], "id bigint")
    assert files.published_rows(spark, str(tmp_path / "x"), ids, "id").count() == 1
    assert files.uncached(ids, files.published(spark, str(tmp_path / "x")), "id").collect()[0].id == 7
