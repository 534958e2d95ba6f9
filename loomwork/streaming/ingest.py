"""Extension, beyond the batch operators: the same rules over growing folders, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload


def response_stream(spark: SparkSession, path: str, archive: str | None = None) -> DataFrame:
    """Response rows of JSONL files as they arrive in a folder; files that are done move to `archive` if one is named."""
    reader = spark.readStream.format("text")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    value = F.col("value")
    rows = reader.load(path).where(payload.is_object(value))
    field = lambda k: F.get_json_object(value, f"$.{k}")
    return rows.select(
        field("custom_id").alias("custom_id"),
        F.when(field("error") != "null", field("error")).alias("error"),
        field("response").alias("response"),
    )


def first_seen(stream: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """One row of each id within the watermark's reach."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def latest_by_key(stream: DataFrame, key: str, order: str, target: str, checkpoint: str):
    """Keep a Parquet table with the last row of each id. Every micro-batch writes a new version beside the old one, so
    a batch that fails half-way or is replayed changes nothing."""
    from ..operators.dedupe import last_by

    def upsert(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new, old = f"{target}/version={epoch}", f"{target}/version={epoch - 1}"
        rows = batch
        if epoch > 0:
            rows = spark.read.schema(batch.schema).parquet(old).unionByName(batch)
        last_by(rows, key, F.col(order)).write.mode("overwrite").parquet(new)

    return stream.writeStream.foreachBatch(upsert).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()


def windowed_counts(
    stream: DataFrame, event_time: str, kind: str, value: str, width: str = "1 day", delay: str = "2 days"
) -> DataFrame:
    """Rows and sums by time window and kind, late rows within the delay included."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width).alias("w"), kind).agg(
        F.count("*").alias("n"), F.sum(value).alias("total")
    ).select(F.col("w.start").alias("window_start"), kind, "n", "total")
