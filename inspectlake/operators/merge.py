"""Key/value rows from all sources, and the last value of every key."""

from pyspark.sql import functions as F

from inspectlake import settings as S
from inspectlake.operators.ordered import dealt
from inspectlake.operators.records import PAGE_FIELDS

HANDWRITTEN, SCANNED, IMAGES = 1, 2, 3
ROW = ["project_id", "phase", "ord", "src_key", "value"]


def page_pairs(records, ord_col="ord"):
    """Key/value rows of handwritten page records; every field is present.

    ``records`` must not hold failed pages, which have no fields.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(f).alias("src_key"), F.col(f).alias("value")) for f in PAGE_FIELDS])
    )
    return records.select("project_id", F.col(ord_col).alias("ord"), pairs.alias("_p")).select(
        "project_id", F.lit(HANDWRITTEN).cast("bigint").alias("phase"), "ord", "_p.*"
    )


def map_pairs(rows, ord_col="ord", phase=SCANNED):
    """Key/value rows of a ``data`` map, null values kept."""
    return rows.select(
        "project_id",
        F.lit(phase).cast("bigint").alias("phase"),
        F.col(ord_col).alias("ord"),
        F.explode("data").alias("src_key", "value"),
    )


#: Parts a project's responses are dealt in, so that one with very many of them is in several tasks.
PROJECT_PARTS = 16


def dealt_by_project(responses, ord_col="ord"):
    """The responses of a written table dealt by project and ``_part``, over tasks that grow with the table."""
    part = F.pmod(F.xxhash64(ord_col), F.lit(PROJECT_PARTS))
    return dealt(responses.withColumn("_part", part), "project_id", "_part")


def _with_keys(records, skip_failed):
    rows = records.filter("error is null")
    return rows.filter("not startswith(evidence, 'Error: ')") if skip_failed else rows


def last_images(records, ord_col="ord", skip_failed=False):
    """The last image record with keys of every project.

    Such a record has every key, so ``last_wins_merge`` takes nothing from an earlier one;
    without those, a key/value row is made per project and not per image.  Of records dealt
    by ``dealt_by_project``, at most one per project and part goes through the exchange.
    """
    kept = F.struct(ord_col, *S.IMAGE_KEYS, "evidence", "error")
    last = _with_keys(records, skip_failed).groupBy("project_id").agg(F.max_by(kept, ord_col).alias("_r"))
    return last.select("project_id", "_r.*")


def image_pairs(records, ord_col="ord", skip_failed=False):
    """Key/value rows of image records; lists are the JSON text that came.

    A short error record has no keys.  A failed image still has its defaults
    and overrides earlier images, unless ``skip_failed`` is set.
    """
    rows = _with_keys(records, skip_failed)
    pairs = F.array(*[F.struct(F.lit(f).alias("src_key"), F.col(f).alias("value")) for f in S.IMAGE_KEYS])
    return rows.select("project_id", F.col(ord_col).alias("ord"), F.explode(pairs).alias("_p")).select(
        "project_id", F.lit(IMAGES).cast("bigint").alias("phase"), "ord", "_p.*"
    )


def union_sources(handwritten, scanned, images):
    """All key/value rows; ``phase`` keeps the order of the sources."""
    parts = [
        p.withColumn("phase", F.lit(n).cast("bigint"))
        for n, p in ((HANDWRITTEN, handwritten), (SCANNED, scanned), (IMAGES, images))
    ]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(
        parts[2], allowMissingColumns=True
    )


def _renaming(keys):
    return F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])


def rename_keys(pairs, document_keys=S.DOCUMENT_KEYS, image_keys=S.IMAGE_KEYS):
    """Keep the listed keys of each source under their stored names."""
    key = F.when(
        F.col("phase") == IMAGES, F.try_element_at(_renaming(image_keys), F.col("src_key"))
    ).otherwise(F.try_element_at(_renaming(document_keys), F.col("src_key")))
    return pairs.withColumn("key", key).filter("key is not null").drop("src_key")


def last_wins_merge(pairs):
    """The last value of every project and key; a null value counts."""
    return pairs.groupBy("project_id", "key").agg(
        F.max_by("value", F.struct("phase", "ord")).alias("value")
    )
