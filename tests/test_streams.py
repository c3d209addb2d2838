import pandas as pd

from quotelens.streaming import streams


def test_stitch_words():
    assert streams.stitch_words("a b c d e".split(), "c d e f".split()) == ["f"]
    assert streams.stitch_words(["x"], ["y", "z"]) == ["y", "z"]


def test_quota_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=7 * i)).to_pydatetime()) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp")
    df.write.parquet(str(tmp_path / "events"))
    batch = {tuple(r) for r in streams.quota(df).collect()}
    s = streams.quota(spark.readStream.schema(df.schema).parquet(str(tmp_path / "events")))
    q = s.writeStream.outputMode("complete").format("memory").queryName("quota_out").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("SELECT * FROM quota_out").collect()} == batch


def test_stitched_stream(spark, tmp_path):
    df = spark.createDataFrame([("k", 0, "one two three four five"), ("k", 1, "three four five six")], "key string, part long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "parts"))
    s = streams.stitched(spark.readStream.schema(df.schema).parquet(str(tmp_path / "parts")))
    q = s.writeStream.outputMode("append").format("memory").queryName("stitch_out").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("SELECT * FROM stitch_out ORDER BY part").collect()
    assert [r.text for r in rows] == ["one two three four five", "six"]
