"""Incremental runs. Streaming is an extension: the catalogue's own increments are anti-joins and a phase log."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidentia.operators.scans import keep_first, latest_status, next_pending


# Phases of a run in order, and those that are left out once completed; the others run again each time.
PHASES = ("ingest_tier1", "extract", "deduplicate", "compare", "ml_embed", "conjecture_from_comparisons", "verify")
GATED = ("ingest_tier1", "extract", "deduplicate")


class PhaseLog:
    """Phases and their statuses, appended to a Parquet table; the last row of a phase counts."""

    def __init__(self, spark: SparkSession, path: str, phases: Sequence[str]) -> None:
        self.spark, self.path, self.phases = spark, path, list(phases)

    def set(self, phase: str, status: str) -> None:
        row = self.spark.range(1).select(F.lit(phase).alias("phase"), F.lit(status).alias("status"), F.current_timestamp().alias("at"))
        row.write.mode("append").parquet(self.path)

    def statuses(self) -> DataFrame:
        log = self.spark.read.schema("phase string, status string, at timestamp").parquet(self.path)
        return latest_status(log, "phase", ["at", "status"], "status")

    def next(self) -> str | None:
        row = next_pending(self.statuses(), self.phases).first()
        return row["phase"] if row else None


class Checkpoints:
    """Values by name, appended to a Parquet table; the last one counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def set(self, name: str, value: str) -> None:
        self.spark.range(1).select(F.lit(name).alias("name"), F.lit(value).alias("value"), F.current_timestamp().alias("at")).write.mode("append").parquet(self.path)

    def get(self, name: str, default: str | None = None) -> str | None:
        if not _exists(self.spark, self.path):
            return default
        rows = self.spark.read.schema("name string, value string, at timestamp").parquet(self.path).filter(F.col("name") == name)
        row = rows.groupBy("name").agg(F.max_by("value", "at").alias("value")).first()
        return row["value"] if row else default


def run_phases(log: PhaseLog, steps: Mapping[str, Callable[[], object]], gated: Sequence[str] = GATED) -> list[str]:
    """Runs the steps in the log's order, writing each one's start and end; returns the names of those that ran.

    A gated phase that is completed is left out, others run every time. A failure is written and raised.
    """
    done = {r["phase"] for r in log.statuses().filter("status = 'completed'").collect()} if _exists(log.spark, log.path) else set()
    ran = []
    for phase in log.phases:
        if phase not in steps or phase in gated and phase in done:
            continue
        log.set(phase, "started")
        try:
            steps[phase]()
        except Exception:
            log.set(phase, "failed")
            raise
        log.set(phase, "completed")
        ran.append(phase)
    return ran


def stream_keep_first(source: DataFrame, target: str, key: str, checkpoint: str, order: Sequence[str]) -> StreamingQuery:
    """Append rows of new keys from a stream to the Parquet table ``target``, once each, whatever arrives again.

    Each micro-batch is an anti-join with the table; a batch that is run again after a failure
    finds its own rows there and adds none.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        first = keep_first(batch, [key], list(order))
        known = spark.read.schema(batch.schema).option("ignoreMissingFiles", "true").parquet(target).select(key) if _exists(spark, target) else None
        (first.join(known, key, "left_anti") if known is not None else first).select(*batch.columns).write.mode("append").parquet(target)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def windowed_counts(events: DataFrame, time: str, kind: str, window: str, late: str) -> DataFrame:
    """Counts and sums by event-time window and kind; rows later than ``late`` behind the watermark no longer count."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count("*").alias("n"))
