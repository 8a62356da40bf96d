from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docloom.streaming import jobs, misses, runs

SCHEMA = "query_hash string, error_type string, source_type_filter string, detected_at timestamp"
START = datetime(2024, 1, 1)


def events(minutes, key="a"):
    return [(key, "no_results", None, START + timedelta(minutes=m)) for m in minutes]


def kept(rows):
    return sorted((r.query_hash, int((r.detected_at - START).total_seconds() // 60)) for r in rows)


def test_hourly_limit(spark):
    df = spark.createDataFrame(events([0, 40, 70, 70]) + events([0, 59, 60, 61, 119, 120, 500], "b"), SCHEMA)
    assert kept(misses.hourly(df, misses.KEYS).collect()) == [("a", 0), ("a", 70), ("b", 0), ("b", 60), ("b", 120), ("b", 500)]


def test_hourly_limit_as_a_stream(spark, tmp_path):
    for i, part in enumerate([events([0, 40]), events([70, 75], "a") + events([10], "b"), events([130, 135])]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = misses.hourly_stream(stream).writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(90)
    got = kept(spark.sql("SELECT * FROM kept").collect())
    assert got == [("a", 0), ("a", 70), ("a", 130), ("b", 10)]


def test_counts_with_late_data(spark, tmp_path):
    spark.createDataFrame(events([0, 10, 70, 200]), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = misses.counts_by_hour(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(90)
    assert sorted(r.n for r in spark.sql("SELECT * FROM counts").collect()) == [1, 1, 2]


def test_detection(spark):
    rows = [("q ", "hybrid", 0, None), ("Q", "hybrid", 3, 0.01), ("q", "fts", 3, 0.01), ("q", "hybrid", 3, 0.025)]
    df = spark.createDataFrame(rows, "query string, mode string, n_results int, top_score double").withColumns({"top_chunk_id": F.lit(1), "source_type_filter": F.lit(None).cast("string"), "ts": F.lit(START)})
    found = misses.detected(df).collect()
    assert sorted((r.error_type, r.top_score, r.query) for r in found) == [("low_confidence", 0.01, "q"), ("no_results", None, "q")]
    assert len({r.query_hash for r in found}) == 1


def test_job_stream(spark, tmp_path):
    schema = "id long, paper_id long, job_type string, params string"
    spark.createDataFrame([(1, 1, "scan", "{}"), (2, 1, "scan", "{}"), (3, 2, "scan", "bad"), (4, 3, "odd", "{}")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    handlers = {"scan": lambda mine: mine.where("params <> 'bad'").select("id", F.lit("ok").alias("result"))}
    jobs.run_jobs(stream, handlers, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(90)
    assert sorted(tuple(r)[:4] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "scan", "completed", "ok"), (3, "scan", "failed", None), (4, "odd", "failed", "no handler")]


def test_windows_and_sessions_leave_late_rows_out(spark, tmp_path):
    """A row behind the watermark of an earlier batch is dropped, by windows and sessions."""
    schema = "event_id long, user_id long, event_type string, ts timestamp, value double"
    row = lambda i, user, minutes: (i, user, "click", START + timedelta(minutes=minutes), 1.0)
    parts = [[row(1, 1, 0), row(2, 1, 200)], [row(4, 2, 205)], [row(3, 1, 10), row(5, 1, 215), row(6, 2, 300)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    counts = runs.run_to_end(runs.windowed(stream), "update", ["start", "event_type"])
    got = {(r.start - START).total_seconds() // 3600: r.n for r in counts.collect()}
    assert got == {0: 1, 3: 3, 5: 1}  # the row at minute 10 came two batches after minute 200
    found = sorted((r.user_id, (r.start - START).total_seconds() // 60, r.n) for r in runs.run_to_end(runs.sessions(stream), "complete").collect())
    assert found == [(1, 0, 1), (1, 200, 2), (2, 205, 1), (2, 300, 1)]


def test_a_stream_without_rows(spark, tmp_path):
    schema = "event_id long, user_id long, event_type string, ts timestamp, value double"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert runs.run_to_end(runs.sessions(stream), "complete").count() == 0
