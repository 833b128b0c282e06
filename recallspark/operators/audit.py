"""Audit trail: records without texts, log file, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.functions.pytext import is_blank
from recallspark.runtime import path_exists
from recallspark.schemas import AUDIT, empty

# Actions of the log.
APPROVED = "QUERY_APPROVED"
DENIED = "QUERY_DENIED"

# Fixed value: ISO 8601 with microseconds and offset; the session zone is moved to UTC.
_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"


def _utc_now() -> Column:
    now = F.current_timestamp()
    return F.date_format(F.to_utc_timestamp(now, F.current_timezone()), _ISO)


def audit_records(outcomes: DataFrame, at: Column | None = None) -> DataFrame:
    """One record per reviewed query: length of the question, never its text.

    A question without hits leaves no record.
    """
    ready = F.col("status") == "READY"
    return outcomes.filter(F.col("status") != "NO_HITS").select(
        (at if at is not None else _utc_now()).alias("timestamp"),
        F.when(ready, APPROVED).otherwise(DENIED).alias("action"),
        F.length("question").cast("long").alias("question_length"),
        F.when(ready, F.col("chunks_used")).otherwise(F.lit(0)).cast("long").alias("chunks_sent"),
    )


def append_audit(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Records with their place in the log as `at`; no rows when the log is missing.

    Blank lines are skipped; any other line that is not a record fails the read.
    """
    if not path_exists(spark, path):
        return empty(spark, AUDIT).withColumn("at", F.struct(F.lit("").alias("file_path")))
    lines = spark.read.text(path).select(
        F.struct(
            F.col("_metadata.file_modification_time").alias("modified_at"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("line_id"),
        ).alias("at"),
        "value",
    )
    record = F.from_json("value", AUDIT, {"mode": "FAILFAST"})
    return lines.filter(~is_blank(F.col("value"))).select("at", record.alias("_r")).select("_r.*", "at")


def audit_summary(records: DataFrame, order: str = "at") -> DataFrame:
    """Totals, and first and last time by place in the log; no row for an empty log."""
    approved = F.col("action") == APPROVED
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(approved).alias("approved"),
        F.count_if(F.col("action") == DENIED).alias("denied"),
        F.coalesce(F.sum(F.when(approved, F.col("chunks_sent"))), F.lit(0)).alias("chunks_sent"),
        F.min_by("timestamp", order).alias("first_query"),
        F.max_by("timestamp", order).alias("last_query"),
    ).filter("total > 0")
