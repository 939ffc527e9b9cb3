from pyspark.sql import functions as F

from parcelyard.streaming import windowed_means


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    shape = lambda df: df.select("ts", (F.col("user_id") % 12).alias("parcel"), F.col("event_type").alias("metabolite"), "value")
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = windowed_means(shape(stream), "1 day", "365 days").writeStream.outputMode("update").format("memory").queryName("means").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = lambda df: sorted((str(r["start"]), r["parcel"], r["metabolite"], round(r["mean"], 6), r["n"]) for r in df.collect())
    assert rows(spark.table("means")) == rows(windowed_means(shape(batch), "1 day", "365 days"))
