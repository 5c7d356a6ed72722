"""Queries over the result cache, retries and inference."""

from pyspark.sql import functions as F

from inspectlake import settings as S
from inspectlake.fixtures import fixture, with_fixtures
from inspectlake.functions import text as T
from inspectlake.operators import cache as C
from inspectlake.operators import infer as N


def _requests(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_request")


def _cache(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_cache")


def cache_key(spark, sf_dir):
    return _requests(spark, sf_dir).select(
        "req_id", T.cache_key(F.col("image_path"), F.col("prompt")).alias("cache_key")
    )


def _matched(spark, sf_dir):
    return C.match_cache(_requests(spark, sf_dir), _cache(spark, sf_dir))


def cache_lookup(spark, sf_dir):
    return C.cache_lookup(_matched(spark, sf_dir)).select("req_id", "image_path", "prompt", "result")


def cache_miss(spark, sf_dir):
    return C.cache_miss(_matched(spark, sf_dir)).select("req_id", "image_path", "prompt")


def union_hits_misses(spark, sf_dir):
    matched = _matched(spark, sf_dir)
    fresh = C.cache_miss(matched).withColumn("result", F.concat(F.lit("fresh "), "image_path"))
    return C.union_hits_misses(C.cache_lookup(matched), fresh).select("req_id", "result", "cached")


def cache_ttl_fold(spark, sf_dir):
    return C.cache_ttl_fold(fixture(spark, sf_dir, "fx_user_request")).select("req_id", F.col("at").alias("requested_at"))


def retry_outcome(spark, sf_dir):
    outcome = C.retry_outcome(fixture(spark, sf_dir, "fx_attempt"))
    return outcome.withColumn("attempts_used", F.col("attempts_used").cast("bigint"))


class Stated:
    """Stands in for a model in the registered query: its answer restates the request."""

    def infer(self, requests):
        return [f'{{"room": "{prompt} of {path}", "confidence": 0.9}}' for path, prompt in requests]


def cached_infer(spark, sf_dir):
    results, _ = N.cached_infer(fixture(spark, sf_dir, "fx_user_request"), _cache(spark, sf_dir), Stated, "stated")
    return results.select("req_id", "result", "success", "cached")


QUERIES = {
    "cache_key": cache_key,
    "cache_lookup": cache_lookup,
    "cache_miss": cache_miss,
    "union_hits_misses": union_hits_misses,
    "cache_ttl_fold": cache_ttl_fold,
    "retry_outcome": retry_outcome,
    "cached_infer": cached_infer,
}

# The latest success before each request, and whether it is still live.
LOOKUP = """, writes as (select image_path, prompt, cached_at, max_by(result, entry_id) as result from fx_cache where success group by all),
looked as (select r.*, w.cached_at, w.result from fx_request r asof left join writes w
 on r.image_path = w.image_path and r.prompt = w.prompt and r.requested_at >= w.cached_at),
matched as (select req_id, image_path, prompt, requested_at, coalesce(requested_at < cached_at + interval 24 hours, false) as hit, result from looked)
"""
# The misses of a sequence of requests, one expiry after the other.
CHAIN = """, instants as (select image_path, prompt, requested_at, min(req_id) as req_id from {source} group by all),
chain as (
 select image_path, prompt, min(requested_at) as at from instants group by all
 union all select c.image_path, c.prompt, (select min(i.requested_at) from instants i where i.image_path = c.image_path and i.prompt = c.prompt
  and i.requested_at >= c.at + interval 24 hours) from chain c where c.at is not null),
misses as (select i.* from instants i join chain c on c.image_path = i.image_path and c.prompt = i.prompt and c.at = i.requested_at)
"""


def _cached(text):
    return with_fixtures(LOOKUP + text, "fx_request", "fx_cache")


ORACLES = {
    "cache_key": with_fixtures(
        f"select req_id, '{S.CACHE_KEY_PREFIX}' || md5(image_path || ':' || prompt) as cache_key from fx_request", "fx_request"
    ),
    "cache_lookup": _cached("select req_id, image_path, prompt, result from matched where hit"),
    "cache_miss": _cached("select req_id, image_path, prompt from matched where not hit"),
    "union_hits_misses": _cached(
        "select req_id, case when hit then result else 'fresh ' || image_path end as result, hit as cached from matched"
    ),
    "cache_ttl_fold": with_fixtures(
        CHAIN.format(source="fx_user_request") + "select req_id, requested_at from misses", "fx_user_request"
    ).replace("with ", "with recursive ", 1),
    "retry_outcome": with_fixtures(
        """, used as (select *, min(case when ok then attempt end) over (partition by project_id, task_id) as first_ok,
 max(attempt) over (partition by project_id, task_id) as last_try from fx_attempt where attempt <= 3)
select project_id, task_id, first_ok is not null as succeeded, cast(coalesce(first_ok, last_try) as bigint) as attempts_used,
 case when first_ok is null then max(error) filter (where attempt = last_try) end as error,
 cast(coalesce(sum(power(2, attempt - 1)) filter (where not ok and attempt < coalesce(first_ok, 3)), 0) as bigint) as backoff_seconds
 from used group by project_id, task_id, first_ok, last_try""",
        "fx_attempt",
    ),
    "cached_infer": with_fixtures(
        LOOKUP.replace("fx_request", "fx_user_request")
        + ", missed as (select req_id, image_path, prompt, requested_at from matched where not hit)"
        + CHAIN.format(source="missed")
        + """select m.req_id, case when hit then result else '{"room": "' || m.prompt || ' of ' || m.image_path || '", "confidence": 0.9}' end as result,
 true as success, s.req_id is null as cached from matched m left join misses s on s.req_id = m.req_id""",
        "fx_user_request", "fx_cache",
    ).replace("with ", "with recursive ", 1),
}
