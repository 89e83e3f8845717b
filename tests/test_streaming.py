import datetime as dt

from fluxlode.streaming import survey


def rows(values, line=1):
    return [(i, dt.datetime(2026, 7, 1, 0, 0, i), float(v), line) for i, v in enumerate(values)]


def run(spark, tmp_path, make, name, batches, mode):
    schema = "point_id long, timestamp timestamp, mag_raw double, line_id int"
    for n, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del n
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_windowed_stats(spark, tmp_path):
    got = run(spark, tmp_path, survey.windowed_stats, "stats", [rows([1, 2, 3]), rows([5], 2)], "complete")
    assert {(r.line_id, r.n, r["mean"]) for r in got} == {(1, 3, 2.0), (2, 1, 5.0)}


def test_duplicates_go(spark, tmp_path):
    got = run(spark, tmp_path, survey.deduplicated, "once", [rows([1, 2]), rows([1, 2, 3])], "append")
    assert sorted(r.mag_raw for r in got) == [1.0, 2.0, 3.0]


def test_alarms_keep_state_between_batches(spark, tmp_path):
    first, second = rows([0, 0, 0, 0, 0, 0, 100, 0])[:6], rows([0, 0, 0, 0, 0, 0, 100, 0])[6:]
    got = run(spark, tmp_path, lambda s: survey.difference_alarms(s, 5.0), "alarms", [first, second], "append")
    assert len(got) >= 2 and max(abs(r.d4) for r in got) > 10
