"""Streams over an event log: windowed counts with a watermark, and the latest request of each user.

Engine baseline beyond what the library's domain asks for: late data, keyed state, exactly-once output by batch number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.session import save


def _folder(spark: SparkSession) -> str:
    import uuid

    save(spark.range(0))  # makes sure that the shared folder is known
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/stream-{uuid.uuid4().hex}"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of an event table, a folder of Parquet files or a single one (a pattern takes both); ts as a timestamp."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """Run a streaming aggregate over all there is, and return the last row of each key; batches overwrite themselves."""
    spark = stream.sparkSession
    at = _folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    value = F.struct(*[c for c in out.columns if c not in (*keys, "batch")])
    return out.groupBy(*keys).agg(F.max_by(value, "batch").alias("v")).select(*keys, "v.*")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Streaming counts and sums by window and type."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def latest_requests(events: DataFrame) -> DataFrame:
    """Streaming state by user: the number of requests and the latest one (by time, then id)."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", "event_id")).alias("x")).select("user_id", "n", F.col("x.event_id").alias("event_id"))
