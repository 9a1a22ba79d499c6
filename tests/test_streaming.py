"""Streams against the same computation in one batch."""

from pyspark.sql import functions as F

from cadenza.streaming import notes as stream


def _run(query, spark, name, mode):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(2, "event_id").write.parquet(f"{tmp_path}/events")
    source = stream.event_stream(spark, f"{tmp_path}/events")
    counts = _run(stream.windowed_counts(source, "1 day", "3650 days"), spark, "counted", "complete")
    want = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    assert {(r.window.start, r.event_type): r.n for r in counts.collect()} == {(r.window.start, r.event_type): r.n for r in want.collect()}
    levels = _run(stream.kalman(source), spark, "levels", "update").groupBy("user_id").agg(
        F.max_by("level", "n").alias("level"), F.max("n").alias("n")
    )
    totals = {r.user_id: r["count"] for r in events.groupBy("user_id").count().collect()}
    assert {r.user_id: r.n for r in levels.collect()} == totals
