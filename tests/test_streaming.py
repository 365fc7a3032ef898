"""The streaming forms on files that arrive one by one."""

from pyspark.sql import functions as F

from pointerflow.streaming import gaps


def test_windows_close_and_late_rows_drop(spark, tmp_path):
    schema = "event_time timestamp, module string, participant string, is_click boolean"
    for i, times in enumerate((("2024-01-01 00:01", "2024-01-01 00:02"), ("2024-01-01 01:00",), ("2024-01-01 00:03", "2024-01-01 02:00"))):
        rows = [(t, "m", "p", k == 0) for k, t in enumerate(times)]
        spark.createDataFrame(rows, "event_time string, module string, participant string, is_click boolean").withColumn("event_time", F.col("event_time").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = gaps.click_rates(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(60)
    got = sorted((str(r.window_start), r.events, r.clicks) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("2024-01-01 00:00:00", 2, 1), ("2024-01-01 01:00:00", 1, 1)]
