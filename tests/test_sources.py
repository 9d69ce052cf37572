"""Readers, writers and the streaming extension."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import tables as R
from sparkloom.streaming import windows as W


def test_case_csv(spark, tmp_path):
    for case, text in (("case_001", "1,0:10,1,0:20,Suturing\n2,0:00,2,0:05,\n"), ("case_002", "1,1,1,2,Other\n")):
        (tmp_path / case).mkdir()
        (tmp_path / case / "tasks.csv").write_text("start_part,start_time,stop_part,stop_time,groundtruth_taskname\n" + text)
    (tmp_path / "case_003").mkdir()
    rows = R.case_csv(spark, str(tmp_path), "tasks.csv", R.TASKS).orderBy("case", "row_no").collect()
    assert [(r.case, r.start_part, r.groundtruth_taskname) for r in rows] == [("case_001", 1.0, "Suturing"), ("case_001", 2.0, None), ("case_002", 1.0, "Other")]


def test_json_rows(spark, tmp_path):
    good = {"id": "1", "video": "v", "t_start": 0.0, "t_end": 1.0, "question": "q", "answers": ["a"]}
    p = tmp_path / "qa.json"
    p.write_text(json.dumps([good, good | {"id": "2"}]))
    need = ("id", "video", "question", "answers")
    rows = R.conform(R.json_rows(spark, str(p), R.QA, need))
    assert rows.count() == 2 and rows.first().sample_weight == 1.0
    p2 = tmp_path / "bad.json"
    p2.write_text(json.dumps([good, good | {"answers": []}]))
    with pytest.raises(Exception, match="row without"):
        R.json_rows(spark, str(p2), R.QA, need).collect()


def test_parts_and_files(spark, tmp_path):
    meta = spark.createDataFrame([("c", "x_part_002.mp4", None, 300, 30.0), ("c", "y", None, 300, 0.0)], R.PARTS)
    assert [(r.part, r.duration) for r in R.video_parts(meta).collect()] == [(2, 10.0), (1, 0.0)]
    for k in (0, 1):
        (tmp_path / "abc").mkdir(exist_ok=True)
        (tmp_path / "abc" / f"frame_{k}.jpg").write_bytes(b"12345")
    assert sorted((r.key, r.frame, r.length) for r in R.frame_files(spark, str(tmp_path)).collect()) == [("abc", 0, 5), ("abc", 1, 5)]
    (tmp_path / "s" / "case1").mkdir(parents=True)
    (tmp_path / "s" / "case2").mkdir()
    (tmp_path / "s" / "case1" / "case1_question.json").write_text('"What?"')
    (tmp_path / "s" / "case1" / "case1.json").write_text('["a", "b"]')
    (tmp_path / "s" / "case2" / "case2_question.json").write_text('"Why?"')
    assert sorted((r.case, r.question, r.answers) for r in R.paired_samples(spark, str(tmp_path / "s")).collect()) == [("case1", "What?", ["a", "b"]), ("case2", "Why?", None)]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(2, "a"), (1, "b")], "ord int, k string")
    R.write_rows(rows, str(tmp_path / "p"), order="ord", partition_by=("k",))
    assert spark.read.parquet(str(tmp_path / "p")).filter("k = 'a'").first().ord == 2
    R.write_report(rows, str(tmp_path / "r"))
    assert len(json.loads(spark.read.text(str(tmp_path / "r")).first().value)) == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select((F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3)).alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = W.window_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.sql("SELECT * FROM counted").collect()))
    assert got == sorted(map(tuple, W.window_counts(rows).collect())) and got
