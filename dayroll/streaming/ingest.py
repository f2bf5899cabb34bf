"""Pushes as a stream: each micro-batch is merged into the store; any day may be rewritten at any time, so there is no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.push import ingest
from ..sources.store import Store


def stream_pushes(spark: SparkSession, source: str, store: Store, checkpoint: str, now: str, on_report=None, lines: bool = False) -> StreamingQuery:  # noqa: ANN001
    """Read payload files as they come and merge them: one payload a file, or a line. A batch that is run again gives the same
    rows; within a batch files are taken in the order of their names, lines in that of the file. on_report gets (batch id, report)."""
    files = spark.readStream.format("text").option("wholetext", str(not lines).lower()).load(source).select("value", F.col("_metadata.file_path").alias("file"))

    def merge(batch: DataFrame, n: int) -> None:
        got = ingest(store, batch.withColumn("at", F.struct("file", F.monotonically_increasing_id())), now, "value", "at")
        if on_report:
            on_report(n, got)

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
