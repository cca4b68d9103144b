from pyspark.sql import functions as F

from tallyforge.operators import metrics
from tallyforge.plans.behaviour import curated
from tallyforge.streaming.trend import hourly_trend


def test_stream_equals_the_batch_trend(spark, small, tmp_path):
    events = curated(spark, small).withColumn("event_time", F.col("event_time").cast("timestamp"))
    events.repartitionByRange(3, "event_time").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = hourly_trend(stream).writeStream.outputMode("complete").format("memory").queryName("trend").start()
    query.processAllAvailable()
    query.stop()
    columns = ["event_date", "event_hour", "events", "views", "carts", "removes", "purchases", "revenue_minor"]
    got = spark.table("trend").select(columns).collect()
    assert sorted(got) == sorted(metrics.trend_by_hour(events).select(columns).collect())
