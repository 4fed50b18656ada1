import json

from pyspark.sql import functions as F

from tidemark.sources import adapters, enrich
from tidemark.streaming import folds


def test_streaming_change_points(spark, tmp_path):
    src = spark.createDataFrame([(1, 0.0, 1.0), (1, 4.0, 5.0), (1, 20.0, 1.0), (1, 40.0, 2.0)], "stream_id long, at double, strength double")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = folds.change_points(s).writeStream.format("memory").queryName("cp").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["at"] for r in spark.table("cp").collect()) == [4.0, 20.0]


def test_bucket_maxima_is_a_batch_query_too(spark):
    e = spark.createDataFrame([(1, "2020-01-01 00:10:00", 1.0), (1, "2020-01-01 00:50:00", 3.0), (1, "2020-01-01 01:00:00", 2.0)], "stream_id long, t string, strength double").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r["strength"], r["n"]) for r in folds.bucket_maxima(e).collect()) == [(2.0, 1), (3.0, 2)]


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"segments": [{"start": 1, "end": 0, "text": " a\n b "}, {"text": " "}, {"start": 5, "end": 9, "text": "c"}]}))
    (tmp_path / "b.json").write_text("{broken")
    got = [tuple(r) for r in adapters.transcripts(spark, str(tmp_path)).orderBy("index").collect()]
    assert got == [("a", 1, 1.0, 1.0, "a b"), ("a", 3, 5.0, 9.0, "c")]


def test_enrichers_and_manifest(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "")], "id long, text string")
    got = {r["id"]: (r["attempt_count"], r["passed"]) for r in enrich.enriched(rows).collect()}
    assert got == {1: (1, True), 2: (2, False)}
    files = spark.createDataFrame([("a/b", "u1", "video"), ("a/b", "u2", "video"), ("c", "u3", "pdf"), ("d", "u4", "video")], "name string, url string, type string")
    assert sorted(r["name"] for r in enrich.manifest(files, spark.createDataFrame([("d",)], "name string")).collect()) == ["a_b", "a_b_2"]
