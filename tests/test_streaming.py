"""The streaming operators over files as they arrive."""

from longitrack.streaming import stitching


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = stitching.windowed_activity(stream).writeStream.outputMode("complete").format("memory").queryName("activity").start()
    try:
        q.processAllAvailable()
        got = {(r.window_start, r.user_id): r.n for r in spark.sql("SELECT * FROM activity").collect()}
    finally:
        q.stop()
    assert got == {(r.window_start, r.user_id): r.n for r in stitching.windowed_activity(events).collect()}
