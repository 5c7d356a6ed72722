"""Project tables and artifacts in shared storage."""

from functools import reduce

from pyspark.sql import functions as F

from inspectlake.operators.ordered import tasks_for
from inspectlake.operators.projects import latest_artifact
from inspectlake.sources.versions import new_folder, read_manifest, write_manifest

PROJECT = (
    "project_id string, project_name string, status string, created_at timestamp_ntz, "
    "handwritten_pdf string, scanned_pdf string, images array<string>, saved_at timestamp_ntz"
)
ARTIFACT = "project_id bigint, artifact string, write_seq bigint, payload string"

# The outputs a project has; others are kept too.
ARTIFACTS = ["document_output", "image_output", "mapping", "processing_log"]


#: Folders a project store is dealt into by a hash of the project.
BUCKETS = 64


def _bucket(project, buckets):
    return F.pmod(F.xxhash64(project.cast("string")), F.lit(buckets)).cast("int")


def save_projects(projects, path, buckets=BUCKETS):
    """Add projects to the store; a later save of a project replaces it.

    A project is always in the folder of its bucket, so the number of buckets of a store
    must not change.
    """
    rows = projects.drop("saved_at").withColumns({"saved_at": F.localtimestamp(), "bucket": _bucket(F.col("project_id"), buckets)})
    rows.write.mode("append").partitionBy("bucket").json(path)


def load_projects(spark, path, requested=None, multi_line=False, buckets=BUCKETS):
    """Stored projects; with ``requested(project_id)``, those and no others.

    The requested ids reach the store first: only the folders of their buckets are read, and
    only their rows are aggregated.  A requested project that is not stored becomes a row
    whose ``error`` says so.  ``multi_line`` reads indented files of one project each; files
    outside of bucket folders are always read.
    """
    stored = spark.read.schema(f"{PROJECT}, bucket int").option("multiLine", multi_line).json(path)
    if requested is not None:
        wanted = requested.select(F.col("project_id").cast("string")).distinct()
        # At most ``buckets`` numbers.
        numbers = [r.bucket for r in wanted.select(_bucket(F.col("project_id"), buckets).alias("bucket")).distinct().collect()]
        stored = stored.filter(F.col("bucket").isin(numbers) | F.col("bucket").isNull()).join(wanted, "project_id", "left_semi")
    stored = stored.drop("bucket")
    whole = F.struct(*stored.columns)
    stored = stored.groupBy("project_id").agg(F.max_by(whole, F.coalesce("saved_at", F.lit("1970-01-01").cast("timestamp_ntz"))).alias("_p"))
    stored = stored.select("_p.*").drop("saved_at")
    if requested is None:
        return stored.withColumn("error", F.lit(None).cast("string"))
    found = stored.withColumn("_found", F.lit(True))
    missing = F.concat(F.lit("Project "), F.col("project_id"), F.lit(" not found"))
    return (
        wanted.join(found, "project_id", "left")
        .withColumn("error", F.when(F.col("_found").isNull(), missing))
        .drop("_found")
    )


def write_artifacts(rows, path, file_format="parquet"):
    """Store artifact writes; a later write of a project's artifact replaces it.

    ``rows(project_id, artifact, write_seq, payload)`` are appended, in one
    folder per artifact, and ``read_artifacts`` returns the last write of each.
    Rewriting a file or keeping a folder per project would not hold for many
    projects; an interrupted append leaves the last state as it was.
    """
    rows.write.mode("append").partitionBy("artifact").format(file_format).save(path)


def read_artifacts(spark, path, file_format="parquet"):
    return latest_artifact(spark.read.schema(ARTIFACT).format(file_format).load(path))


def compact_artifacts(spark, path, new_path, file_format="parquet"):
    """Write only the last state of every artifact to a new folder."""
    write_artifacts(read_artifacts(spark, path, file_format), new_path, file_format)


LIST = "project_id bigint, artifact string, write_seq bigint, ordinal bigint, payload string"


def write_lists(rows, path):
    """Store outputs that are lists, one row per entry: (project_id, artifact, write_seq, ordinal, payload).

    A later write of a project's list replaces all of it.  Entries stay rows, so a project
    with very many of them is never one value.
    """
    rows.write.mode("append").partitionBy("artifact").parquet(path)


def read_lists(spark, path):
    """The entries of the last write of every list."""
    stored = spark.read.schema(LIST).parquet(path)
    keys = ["project_id", "artifact"]
    last = stored.groupBy(*keys).agg(F.max("write_seq").alias("write_seq"))
    return stored.join(last, [*keys, "write_seq"], "left_semi").select("project_id", "artifact", "write_seq", "ordinal", "payload")


CATALOG = ("form_fields", "sections", "tags")


def _read_catalog(spark, path, commits):
    """The tables of ``commits`` (pages too), each page as of the last commit that has it."""
    place = F.element_at(F.create_map(*[x for k, c in enumerate(commits) for x in (F.lit(c), F.lit(k))]), F.col("_commit"))
    stored = {name: spark.read.parquet(*[f"{path}/{c}/{name}" for c in commits]) for name in (*CATALOG, "pages")}
    last = stored["pages"].groupBy("page_id").agg(F.max_by("_commit", place).alias("_commit"))
    # Both sides dealt alike, over as many tasks as the longest table needs.
    tasks, key = max(tasks_for(rows) for rows in stored.values()), ["page_id", "_commit"]
    last = last.repartition(tasks, *key)
    return {name: rows.repartition(tasks, *key).join(last, key, "left_semi") for name, rows in stored.items()}


def save_catalog(path, fields, sections, tags, pages=None, compact_every=30):
    """Add the fields, the section tree and the tags of scraped pages, all or nothing.

    Pages that were saved before are replaced as a whole, others stay.  ``pages(page_id)``
    names the pages of this save, so that one without any field, section or tag replaces what
    it had; those of the three tables by default.  The tables are written to a new folder and
    count when the manifest that names it is committed; a save that stops before leaves the
    catalog as it was, and of two saves at once one is later.
    """
    spark = fields.sparkSession
    parts = dict(zip(CATALOG, (fields, sections, tags)))
    if pages is None:
        pages = reduce(lambda a, b: a.unionByName(b), [rows.select("page_id") for rows in parts.values()])
    folder = new_folder("catalog")
    for name, rows in (parts | {"pages": pages.select("page_id").distinct()}).items():
        rows.withColumn("_commit", F.lit(folder)).write.parquet(f"{path}/{folder}/{name}")
    while True:
        version, content = read_manifest(spark, path)
        commits = [*content.get("commits", []), folder]
        if len(commits) > compact_every:
            merged = new_folder("catalog")
            for name, rows in _read_catalog(spark, path, commits).items():
                rows.withColumn("_commit", F.lit(merged)).write.parquet(f"{path}/{merged}/{name}")
            commits = [merged]
        if write_manifest(spark, path, version + 1, {"commits": commits}):
            return


def load_catalog(spark, path):
    """The three tables of ``save_catalog``, each page as last saved."""
    _, content = read_manifest(spark, path)
    stored = _read_catalog(spark, path, content["commits"])
    return tuple(stored[name].drop("_commit") for name in CATALOG)
