from emberframe.streaming.windows import windowed_counts


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(60)
    got = {(r.window_start, r.event_type): r.n for r in spark.table("counts").collect()}
    assert got == {(r.window_start, r.event_type): r.n for r in windowed_counts(source).collect()}
