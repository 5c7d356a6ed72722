"""Planned image sizes, retry budgets and checks of image analyses."""

from pyspark.sql import functions as F

from inspectlake import settings as S


def resize_plan(images, max_side=S.MAX_IMAGE_SIDE):
    """Planned size: the longer side shrinks to ``max_side``, sizes truncate."""
    longer = F.greatest("width", "height")
    scale = F.lit(float(max_side)) / longer.cast("double")

    def planned(side):
        return F.when(longer > max_side, (F.col(side) * scale).cast("int")).otherwise(F.col(side))

    return images.withColumn("new_width", planned("width")).withColumn("new_height", planned("height"))


def confidence_queue(rows, threshold=S.CONFIDENCE_THRESHOLD, column="confidence_score"):
    """Rows for manual review."""
    return rows.filter(F.col(column) < threshold)


def _outside(col, words):
    return col.isNotNull() & ~col.isin(words)


def vocab_check(analyses):
    """Flags for values outside the vocabularies and limits.

    ``visible_damage`` is a list.  The vocabularies are short fixed lists, so
    the check is a projection, without a join.
    """
    words = F.filter(F.split(F.trim("mini_caption"), r"\s+"), lambda w: w != "")
    unknown = F.array_except("visible_damage", F.array(*[F.lit(d) for d in S.DAMAGE]))
    return (
        analyses.withColumn("bad_condition", _outside(F.col("overall_condition"), S.CONDITIONS))
        .withColumn("bad_area", _outside(F.col("building_area"), S.AREAS))
        .withColumn("bad_damage", F.size(unknown) > 0)
        .withColumn("bad_confidence", ~F.col("confidence").between(0.0, 1.0))
        .withColumn("long_caption", F.size(words) > S.MINI_CAPTION_WORDS)
    )
