"""Extension: the current version of each run, kept up to date from a stream of the append-only log.

The batch engine has no streams; this is the same latest-version rule on Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def current(runs: DataFrame) -> DataFrame:
    """The last version of each run of a streaming or static log, by ``recorded_at``; state is one row a run."""
    rest = [c for c in runs.columns if c not in ("run_id", "recorded_at")]
    best = F.max(F.struct("recorded_at", *rest)).alias("_v")
    return runs.groupBy("run_id").agg(best).select("run_id", "_v.*")


def status_counts(runs: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Log rows by status in windows of event time; rows later than ``delay`` are dropped by the watermark."""
    return runs.withWatermark("recorded_at", delay).groupBy(F.window("recorded_at", width).alias("w"), "status").agg(F.count("*").alias("n")).select("w.start", "w.end", "status", "n")


def keep_current(runs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Maintain a Parquet snapshot of current runs; each batch replaces it whole, so a repeated batch changes nothing."""

    def replace(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    writer = current(runs).writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
