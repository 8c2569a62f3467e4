"""Live capture: a stream of executions folded, batch by batch, into the command table.

The merge commutes, so late and unordered events need no watermark.  Each micro-batch writes a command
table of its own under its batch id; a replayed batch overwrites what it wrote, so nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.functions.redact import ignored, scrub
from strandline.operators.store import commands_of, merge_commands


def redacted_executions(raw: DataFrame) -> DataFrame:
    """Captured rows (with ``raw`` commands) as executions; private and empty commands are dropped."""
    rows = raw.where(~ignored(F.col("raw"))).withColumn("s", scrub("raw"))
    rows = rows.withColumns({"text": F.col("s.text"), "redacted": F.col("s.redactions")}).drop("s", "raw")
    return rows.where(F.length("text") > 0)


def upsert_stream(executions: DataFrame, path: str, checkpoint: str, now_ms: int, every: str | None = None) -> StreamingQuery:
    """Start a query that keeps per-batch command tables under ``path``; without ``every`` it drains what is there and ends."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        commands_of(batch, now_ms).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = executions.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The command table: all batches merged."""
    batches = spark.read.parquet(path).drop("batch")
    return merge_commands(batches.limit(0), batches)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Merged batches as one table, written elsewhere; readers switch, then old batches can go."""
    current(spark, path).write.mode("overwrite").parquet(f"{target}/batch=-1")
