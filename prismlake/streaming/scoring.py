"""Extension: score vectors as they arrive, against a fixed bank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prismlake.functions import metrics, vec
from prismlake.operators import heatmap


def score_stream(arriving: DataFrame, bank: DataFrame, target: str, checkpoint: str, low: float = 90, high: float = 99) -> StreamingQuery:
    """Band scores of each micro-batch of (vec_id, embedding), appended to a Parquet table. The bank has p and v."""

    def batch(rows: DataFrame, number: int) -> None:
        patches = vec.patches(rows.select("vec_id", "embedding")).withColumn("v", vec.unit("v"))
        heat = heatmap.min_cosine(patches, bank, ["vec_id"])
        scored = metrics.band_score(heat, ["vec_id"], "d", low, high).withColumn("batch", F.lit(number))
        scored.write.mode("overwrite").parquet(f"{target}/batch={number}")  # a repeated batch replaces itself

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_scores(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Mean and largest value by type and time window; later events than the watermark are dropped by definition."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("most"), F.count("*").alias("n"))


def read_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema("vec_id long, embedding array<float>, label int").parquet(folder)
