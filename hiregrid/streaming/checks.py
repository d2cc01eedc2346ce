"""Source checks as a stream: late data within a watermark, repeats dropped, windows of health, a latest-state table by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.frames import latest


def read_checks(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    """A stream of check files; `checked_at` becomes a timestamp."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path).withColumn("checked_at", F.col("checked_at").cast("timestamp"))


def without_repeats(checks: DataFrame, late: str = "1 day") -> DataFrame:
    """Each check once by id, as far back as the watermark."""
    return checks.withWatermark("checked_at", late).dropDuplicatesWithinWatermark(["id"])


def health_windows(checks: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Per window and source: checks, healthy ones, errors, jobs found. Tumbling, or sliding if `slide` is given."""
    span = F.window("checked_at", window, slide) if slide else F.window("checked_at", window)
    s = F.col("status")
    return checks.withWatermark("checked_at", late).groupBy(span.alias("span"), "source").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(s.isin("success", "zero")).alias("healthy"), F.count_if(s == "error").alias("errors"), F.sum("jobs_found").alias("jobs_found"),
    ).select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), "source", "checks", "healthy", "errors", "jobs_found")


def check_sessions(checks: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Runs of an entity's checks without a longer gap."""
    return checks.withWatermark("checked_at", late).groupBy(F.session_window("checked_at", gap).alias("span"), "entity_id").agg(F.count(F.lit(1)).alias("checks"), F.max("jobs_found").alias("most_jobs")).select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), "entity_id", "checks", "most_jobs")


def keep_latest_state(checks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest check per entity and source in versions `path/v=<batch>`; a replayed batch writes the same version again."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("entity_id", "source", "id", "status", "jobs_found", "checked_at")
        if number:
            new = new.unionByName(spark.read.parquet(f"{path}/v={number - 1}"))
        latest(new, ["entity_id", "source"], ["id", "status", "jobs_found", "checked_at"], ["checked_at", "id"]).write.mode("overwrite").parquet(f"{path}/v={number}")

    return checks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


