"""Uploaded files as rows."""

from pyspark.sql import functions as F

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def _with_type(files):
    return files.withColumn("doc_type", F.regexp_extract("path", r"uploads/([^/]+)/", 1)).withColumn(
        "project_id", F.regexp_extract("path", r"([^/]+)/uploads/", 1)
    )


def ingest_files(spark, root, glob=None):
    """``(project_id, doc_type, path, length, content)`` of all files under ``root``.

    The type is the folder under ``uploads/``, the project the folder above
    it.  A query that does not use ``content`` does not read it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _with_type(reader.load(root)).select("project_id", "doc_type", "path", "length", "content")


def image_glob(spark, root):
    """The ``.jpg`` and ``.png`` files only; others are not listed."""
    return ingest_files(spark, root, "*.{jpg,png}")


def stream_files(spark, root, glob=None, files_per_trigger=1000):
    """The same rows as a stream of newly arrived files."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema(BINARY)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_trigger)
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _with_type(reader.load(root)).select("project_id", "doc_type", "path", "length", "content")
