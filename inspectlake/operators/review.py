"""Approvals, human edits and the review screen."""

from pyspark.sql import functions as F

from inspectlake import settings as S
from inspectlake.functions import text as T

DECISIONS = ["approved", "rejected"]


def approval_status(events):
    """The latest decision of every project that has one."""
    decided = events.filter(F.col("action").isin(DECISIONS))
    return decided.groupBy("project_id").agg(F.max_by("action", "seq").alias("approval_status"))


def approval_default(projects, statuses):
    """Every project with its status, ``pending`` without a decision."""
    return projects.join(statuses, "project_id", "left").withColumn(
        "approval_status", F.coalesce("approval_status", F.lit("pending"))
    )


def approved_rows(rows, statuses):
    """The rows of approved projects, before any other work is done on them."""
    approved = statuses.filter("approval_status = 'approved'").select("project_id")
    return rows.join(approved, "project_id", "left_semi")


def approval_gate(projects, statuses, summary):
    """One mapping summary per project; empty until the project is approved."""
    gated = approval_default(projects, statuses).join(summary, "project_id", "left")
    approved = F.col("approval_status") == "approved"

    def counted(name):
        return F.when(approved, F.coalesce(name, F.lit(0))).otherwise(F.lit(0)).alias(name)

    return gated.select(
        "project_id",
        "approval_status",
        counted("n_mapped"),
        counted("n_unmapped"),
        F.when(approved, F.lit(S.MAPPED_CONFIDENCE)).otherwise(F.lit(0.0)).alias("confidence_score"),
        F.when(approved, F.coalesce("evidence", T.mapped_count(F.lit(0))))
        .otherwise(F.lit("Awaiting user approval"))
        .alias("evidence"),
    )


def review_overlay(extracted, events):
    """Extracted values with the latest edits over them and new keys added.

    ``extracted(project_id, key, value)`` has one row per key.  An edit always
    wins over an extracted value, so both are one aggregation and no join.
    """
    edits = events.filter("action = 'edit'").select(
        "project_id", F.col("field_name").alias("key"), F.col("new_value").alias("value"), "seq",
        F.lit(1).alias("_edit"),
    )
    rows = extracted.select(
        "project_id", "key", "value", F.lit(None).cast("bigint").alias("seq"), F.lit(0).alias("_edit")
    ).unionByName(edits)
    return rows.groupBy("project_id", "key").agg(
        F.max_by("value", F.struct("_edit", "seq")).alias("value"),
        F.bool_or(F.col("_edit") == 1).alias("edited"),
    )


def review_view(analyses, texts=(), lists=(), keys=None):
    """Display columns: lists joined by a comma, ``N/A`` for an empty list or an absent key.

    A text that is given as null stays null.  A key is absent if there is no
    such column, or if the map column ``keys`` is named and lacks it.
    """

    def text(c):
        given = F.col(c) if c in analyses.columns else F.lit("N/A")
        return F.when(F.map_contains_key(keys, c), given).otherwise("N/A") if keys else given

    shown = {
        **{c: text(c) for c in texts},
        **{c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("N/A")) for c in lists},
    }
    return analyses.withColumns(shown)
