"""Project rows, their status, logs and repeated artifact writes."""

from pyspark.sql import functions as F


def create_projects(requests, created_at=None):
    """New project rows with default fields and status ``created``.

    A request without ``project_id`` gets a random one.
    """
    supplied = F.col("project_id").cast("string") if "project_id" in requests.columns else F.lit(None)
    nothing = F.lit("")
    return requests.select(
        F.coalesce(supplied, F.uuid()).alias("project_id"),
        "project_name",
        F.lit("created").alias("status"),
        (F.localtimestamp() if created_at is None else created_at).alias("created_at"),
        nothing.alias("handwritten_pdf"),
        nothing.alias("scanned_pdf"),
        F.array().cast("array<string>").alias("images"),
    )


def latest_artifact(writes):
    """The last write of every project and artifact."""
    kept = [c for c in writes.columns if c not in ("project_id", "artifact")]
    last = writes.groupBy("project_id", "artifact").agg(
        F.max_by(F.struct(*kept), "write_seq").alias("_w")
    )
    return last.select("project_id", "artifact", "_w.*")


def project_status(logs):
    return logs.groupBy("project_id").agg(F.max_by("status", "seq").alias("status"))


def stage_log_rollup(logs):
    """Counts, errors and durations by step and status, with totals per step
    and over all; ``grouping_id`` tells a total (1, 3) from a null step or status (0)."""
    return logs.rollup("step", "status").agg(
        F.grouping_id().cast("bigint").alias("grouping_id"),
        F.count(F.lit(1)).alias("n"),
        F.count("error").alias("n_errors"),
        F.sum("duration_ms").alias("total_ms"),
        F.round(F.avg("duration_ms"), 6).alias("avg_ms"),
    )
