"""Detections that arrive as files, suppressed image by image: an extension, with the batch operators inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.suppression import suppress


def stream(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def suppressed(source: DataFrame, out: str, checkpoint: str, method: str = "nms", threshold: float = 0.5, keys: tuple[str, ...] = ("image_id",)):
    """Starts a query that writes each batch's kept detections. An image's detections must come in one file, so no state is kept between batches;
    a batch that runs again overwrites its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        suppress(batch, method, threshold, keys).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
