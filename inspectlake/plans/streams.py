"""Queries run as streams over the supplied tables, up to what is there."""

from pyspark.sql import functions as F

from inspectlake.fixtures import SQL, with_fixtures, with_private_names
from inspectlake.plans.caching import CHAIN
from inspectlake.plans.storage import documents_in, write_uploads
from inspectlake.session import work_dir
from inspectlake.sources.files import stream_files
from inspectlake.streaming import streams as Q


def stream_fixture(spark, sf_dir, name):
    """A fixture over ``events`` with the table read as a stream."""

    def stream_of(source):
        path = f"{sf_dir}/{source}.parquet"
        return Q.stream_parquet(spark, path, spark.read.parquet(path).schema)

    return spark.sql(with_private_names(SQL[name], stream_of, "inspectlake_stream"))


def stream_ingest(spark, sf_dir):
    root, out = write_uploads(spark, sf_dir), work_dir(spark, "ingested")
    Q.stream_ingest(stream_files(spark, root, "*.txt"), out, work_dir(spark, "progress"))
    return documents_in(spark.read.parquet(out))


def stream_cache(spark, sf_dir):
    out = work_dir(spark, "misses")
    Q.stream_cache(stream_fixture(spark, sf_dir, "fx_user_request"), out, work_dir(spark, "progress"))
    return Q.cache_misses(spark, out).select("req_id")


def stream_review(spark, sf_dir):
    out = work_dir(spark, "review")
    Q.stream_review(stream_fixture(spark, sf_dir, "fx_review_event"), out, work_dir(spark, "progress"))
    return Q.review_state(spark, out).select("project_id", "kind", "field_name", "seq", "action", "new_value")


def stream_log_windows(spark, sf_dir):
    out = work_dir(spark, "windows")
    Q.stream_log_windows(stream_fixture(spark, sf_dir, "fx_log"), out, work_dir(spark, "progress"))
    return Q.latest_windows(spark, out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


QUERIES = {
    "stream_ingest": stream_ingest,
    "stream_cache": stream_cache,
    "stream_review": stream_review,
    "stream_log_windows": stream_log_windows,
}

ORACLES = {
    "stream_ingest": """select 'p1' as project_id, case doc_id % 3 when 0 then 'handwritten' when 1 then 'scanned' else 'images' end as doc_type,
 doc_id, md5(text) as text_md5 from documents""",
    "stream_cache": with_fixtures(
        CHAIN.format(source="fx_user_request") + "select req_id from misses", "fx_user_request"
    ).replace("with ", "with recursive ", 1),
    "stream_review": with_fixtures(
        """, used as (select *, case when action = 'edit' then 'edit' else 'decision' end as kind,
 case when action = 'edit' then field_name end as field from fx_review_event where action <> 'view')
select project_id, kind, field as field_name, seq, action, new_value from used
 qualify row_number() over (partition by project_id, kind, field order by seq desc) = 1""",
        "fx_review_event",
    ),
    "stream_log_windows": with_fixtures(
        """select date_trunc('hour', "at") as window_start, step, count(*) as n, count(error) as n_errors from fx_log group by all""", "fx_log"
    ),
}
