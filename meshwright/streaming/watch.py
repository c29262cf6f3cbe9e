"""Models as they arrive in a folder: the batch engine over each micro-batch of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, rules: dict | str = "retaining_wall", files_a_batch: int = 100) -> StreamingQuery:
    """Write the checks of each new file to ``out`` as Parquet, a folder a batch: a batch that runs again overwrites itself."""
    from ..api import Models

    arrivals = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_a_batch).load(folder).selectExpr("_metadata.file_path AS path")

    def run(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # at most files_a_batch names
        if paths:
            Models(spark, paths).checks(rules).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
