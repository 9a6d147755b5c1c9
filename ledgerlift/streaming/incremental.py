"""Copy files as they arrive: the batch clean-up under Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerlift.operators.rows import normalize_all_text


def read_new_files(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Stream over a folder of parquet files; the checkpoint remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def copy_new_files(spark: SparkSession, folder: str, schema: T.StructType, target: str, checkpoint: str) -> None:
    """Append cleaned rows of all files not copied yet, then stop. A restart resumes where the last run ended."""
    rows = normalize_all_text(read_new_files(spark, folder, schema))
    job = (
        rows.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
