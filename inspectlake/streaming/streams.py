"""The incremental parts: arriving files, requests, review events and logs.

Each sink writes one folder per micro-batch and overwrites it, or leaves it, when a batch
is run again, so a restart adds no rows.  State is kept in versioned tables
(``sources/versions.py``), not in executors.
"""

from pyspark.sql import functions as F

from inspectlake import settings as S
from inspectlake.operators import review
from inspectlake.operators.cache import cache_ttl_fold
from inspectlake.sources.versions import KeyedTable


def stream_parquet(spark, path, schema, files_per_trigger=100):
    """A parquet file or folder as a stream.

    A file source takes folders and patterns; the bracket makes a pattern that
    matches just this path.
    """
    folder, name = path.rstrip("/").rsplit("/", 1)
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{folder}/[{name[0]}]{name[1:]}")
    )


def run_available(rows, checkpoint, write_batch=None, out=None, mode="append"):
    """Process what is there and stop; progress is kept in ``checkpoint``."""
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True)
    if write_batch:
        query = writer.foreachBatch(write_batch).start()
    else:
        query = writer.format("parquet").option("path", out).start()
    query.awaitTermination()


def _batch_writer(out):
    def write(rows, batch_id):
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return write


def stream_ingest(files, out, checkpoint):
    """Append newly arrived files to the input table."""
    run_available(files, checkpoint, out=out)


LAST_WRITES = "cache_key string, last_us bigint"


def stream_cache(requests, out, checkpoint, ttl=S.CACHE_TTL_SECONDS, compact_every=20):
    """Write the requests of a stream that miss the cache to ``out/misses``, with exact expiry.

    The last write of every key is a versioned table in ``out/writes``.  A micro-batch reads
    it as of the batch before, takes the expiry chain of its own requests from there on
    (``cache_ttl_fold``, so a hot key is spread over tasks), writes its misses and then
    commits the new last writes.  A batch that is run again before its commit finds the same
    state and writes the same misses to the same folder; after it, nothing.  Rows are put
    in order within a micro-batch; batches must come in time order.
    """

    def write(rows, batch_id):
        spark = rows.sparkSession
        writes = KeyedTable(spark, f"{out}/writes", LAST_WRITES, ["cache_key"], "last_us", compact_every)
        if writes.has(batch_id):
            return
        folder = f"{out}/misses/batch_id={batch_id}"
        cache_ttl_fold(rows, ttl, writes.state()).select("cache_key", "req_id", "at_us").write.mode("overwrite").parquet(folder)
        writes.commit(batch_id, spark.read.parquet(folder).groupBy("cache_key").agg(F.max("at_us").alias("last_us")))

    run_available(requests, checkpoint, write)


def cache_misses(spark, out):
    """(cache_key, req_id, at_us) of all misses of ``stream_cache``."""
    return spark.read.parquet(f"{out}/misses").drop("batch_id")


REVIEWED = "project_id bigint, kind string, field_name string, seq bigint, action string, new_value string"


def _reviewed(spark, out, schema, compact_every):
    return KeyedTable(spark, out, schema, ["project_id", "kind", "field_name"], "seq", compact_every)


def stream_review(events, out, checkpoint, compact_every=20):
    """Keep decisions and edits current as review events arrive.

    A batch is reduced to the last event per project and field and committed to a keyed
    table, which merges its batches into one snapshot from time to time.
    """
    schema = ", ".join(f"{f} {events.schema[c].dataType.simpleString() if c else 'string'}" for f, c in (("project_id", "project_id"), ("kind", None), ("field_name", "field_name"), ("seq", "seq"), ("action", "action"), ("new_value", "new_value")))

    def write(rows, batch_id):
        decision = F.col("action").isin(review.DECISIONS)
        field = F.when(~decision, F.col("field_name"))
        kind = F.when(decision, "decision").otherwise("edit")
        used = rows.filter(decision | (F.col("action") == "edit"))
        table = _reviewed(rows.sparkSession, out, schema, compact_every)
        table.commit(batch_id, table.latest(used.select("project_id", kind.alias("kind"), field.alias("field_name"), "seq", "action", "new_value")))

    run_available(events, checkpoint, write)


def review_state(spark, out, schema=REVIEWED):
    """Status and edits as of the last batch: one snapshot and the batches after it."""
    return _reviewed(spark, out, schema, 0).state()


def log_windows(logs, width="1 hour"):
    """Step counts and errors per tumbling window; ``logs.at`` is a timestamp."""
    return logs.groupBy(F.window("at", width).alias("_w"), "step").agg(
        F.count(F.lit(1)).alias("n"), F.count("error").alias("n_errors")
    ).select(F.col("_w.start").alias("window_start"), "step", "n", "n_errors")


def stream_log_windows(logs, out, checkpoint, width="1 hour", delay="24 hours"):
    """Windowed step counts of a log stream.

    Each batch writes the windows it changed; rows later than ``delay`` are
    dropped and the state of older windows with them.
    """
    timed = logs.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay)
    run_available(log_windows(timed, width), checkpoint, _batch_writer(out), mode="update")


def latest_windows(spark, out):
    """The last count of every window and step."""
    rows = spark.read.parquet(out)
    last = rows.groupBy("window_start", "step").agg(
        F.max_by(F.struct("n", "n_errors"), "batch_id").alias("_c")
    )
    return last.select("window_start", "step", "_c.n", "_c.n_errors")
