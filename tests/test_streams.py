from pyspark.sql import functions as F

from engram.streaming import streams


def test_log_stream(spark, tmp_path):
    schema = "generation long, id string, op string, v int"
    for k, rows in enumerate([[(1, "a", "upsert", 1), (2, "b", "upsert", 2)], [(3, "a", "delete", 0), (4, "c", "upsert", 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
        streams.apply_log(stream, str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()
        live = {r["id"] for r in streams.state(spark, str(tmp_path / "state"), k).collect()}
        assert live == [{"a", "b"}, {"b", "c"}][k]
    seen = []
    streams.changes(spark.readStream.schema(schema).parquet(str(tmp_path / "log")), lambda df, n: seen.extend(r["generation"] for r in df.collect()), str(tmp_path / "feed"), after=2).awaitTermination()
    assert sorted(seen) == [3, 4]


def test_session_stream(spark, tmp_path):
    schema = "key long, at timestamp"
    minute = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    for part in ([(1, minute(0)), (1, minute(100))], [(1, minute(900))], [(2, minute(1430))]):
        spark.createDataFrame(part, "key long, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "turns"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "turns"))
    q = streams.sessions(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("started_ms").collect()
    assert [(r["key"], r["n_turns"]) for r in rows][0] == (1, 2)
