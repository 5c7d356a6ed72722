"""Reuse of earlier inference results through a cache table with exact expiry.

``cache(entry_id, image_path, prompt, cached_at, success, result)`` holds what
was written; only successes count, a later write replaces an earlier one, and
an entry serves requests in ``[cached_at, cached_at + ttl)``.
"""

from functools import reduce

from pyspark.sql import functions as F

from inspectlake import settings as S
from inspectlake.functions import text as T
from inspectlake.operators.ordered import as_of
from inspectlake.session import saved


def with_cache_key(rows, path="image_path", prompt="prompt"):
    return rows.withColumn("cache_key", T.cache_key(F.col(path), F.col(prompt)))


def _with_key(rows, path="image_path", prompt="prompt"):
    """Add ``_key``, the 16 bytes that ``cache_key`` writes in 32 digits: what lookups carry through exchanges."""
    return rows.withColumn("_key", _digest(T.cache_key(F.col(path), F.col(prompt))))


def _digest(cache_key):
    return F.unhex(F.right(cache_key, F.lit(32)))


def _seconds(n):
    return F.make_dt_interval(secs=F.lit(float(n)))


def second_of(ts):
    """Whole seconds since 1970 of a timestamp without time zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)


def micros_of(ts):
    """Whole microseconds since 1970 of a timestamp without time zone."""
    return second_of(ts) * 1_000_000 + F.date_format(ts, "SSSSSS").cast("bigint")


def _instants(requests):
    return requests.select("_key", F.col("requested_at").alias("at")).distinct().withColumn("at_us", micros_of(F.col("at")))


def live_entries(instants, cache, ttl=S.CACHE_TTL_SECONDS):
    """(_key, requested_at, entry_id, cached_at) for each instant that a live entry answers.

    An as-of join on ids and times: no result is read here.  Of several successes written
    at once, the one with the greatest id counts.
    """
    entries = cache.filter("success").groupBy("_key", "cached_at").agg(F.max("entry_id").alias("entry_id"))
    entries = entries.withColumn("at_us", micros_of(F.col("cached_at")))
    found = as_of(instants, entries, ["_key"], "at_us", ["cached_at", "entry_id"], ttl * 1_000_000, in_order=True)
    live = F.col("at") < F.col("cached_at") + _seconds(ttl)
    return found.filter(live).select("_key", F.col("at").alias("requested_at"), "entry_id", "cached_at")


def match_cache(requests, cache, ttl=S.CACHE_TTL_SECONDS):
    """Every request with ``hit`` and the stored ``result``.

    Requests meet ids first; the results join last, once per entry that is stored, so
    they are in no exchange before that.
    """
    requests, cache = _with_key(requests), _with_key(cache)
    live = live_entries(_instants(requests), cache, ttl)
    matched = requests.join(live, ["_key", "requested_at"], "left")
    entry = ["_key", "cached_at", "entry_id"]
    results = cache.filter("success").select(*entry, "result").dropDuplicates(entry)
    kept = [c for c in matched.columns if c not in entry]
    found = matched.join(results, entry, "left").select(*kept, "result", F.col("entry_id").isNotNull().alias("hit"))
    return with_cache_key(found)


def cache_lookup(matched):
    """The requests a live entry answers, with its result."""
    return matched.filter("hit").drop("hit")


def cache_miss(matched):
    """The requests that need inference."""
    return matched.filter("not hit").drop("hit", "result")


def union_hits_misses(hits, fresh):
    """Cached and fresh results in one table; ``cached`` tells them apart."""
    return hits.withColumn("cached", F.lit(True)).unionByName(
        fresh.withColumn("cached", F.lit(False)), allowMissingColumns=True
    )


def cache_writes(fresh):
    """New cache rows; a failed inference is never stored."""
    return fresh.filter("success").select(
        F.col("req_id").alias("entry_id"),
        "image_path",
        "prompt",
        F.col("requested_at").alias("cached_at"),
        "success",
        "result",
    )


def cache_ttl_fold(requests, ttl=S.CACHE_TTL_SECONDS, writes=None):
    """The requests that miss when all go through one cache in time order.

    The first request of a key misses, then the first one at least ``ttl`` after the last
    miss: a hit does not extend the entry.  ``writes`` (cache_key, last_us) holds the last
    writes of earlier requests, if there are any; no request is earlier than these.

    Each instant points at the first one of its key at least ``ttl`` later (an as-of pass).
    The misses are the chain of these pointers from the first instant on.  Each round adds
    as many misses as there are and doubles the reach of the pointers, so the rounds are the
    logarithm of the longest chain, which the covered time bounds.  Every round is two joins
    on the number that an instant got when it was written, so that rounds carry two numbers
    a row and no key; instants without a further one drop out.
    """
    ttl_us = ttl * 1_000_000
    instants = _with_key(requests).groupBy("_key", F.col("requested_at").alias("at")).agg(F.min("req_id").alias("req_id"))
    instants = saved(instants.withColumns({"at_us": micros_of(F.col("at")), "_id": F.monotonically_increasing_id()}), "instants")
    # Requests without a path, prompt or time meet no other, so they are in no chain.
    instants = instants.filter(F.col("_key").isNotNull() & F.col("at_us").isNotNull())
    open_ones = instants
    if writes is not None:
        writes = writes.select(_digest(F.col("cache_key")).alias("_key"), "last_us")
        open_ones = instants.join(writes, "_key", "left").filter(F.col("last_us").isNull() | (F.col("at_us") >= F.col("last_us") + ttl_us))
    spans = open_ones.groupBy("_key").agg(F.min_by("_id", "at_us").alias("_id"), (F.max("at_us") - F.min("at_us")).alias("_span"))
    firsts = saved(spans.drop("_key"), "round")
    longest = firsts.agg(F.max(F.floor(F.col("_span") / ttl_us))).first()[0] or 0
    # Backwards in time, the first instant from a time on is the latest one up to it.
    back = instants.select("_key", "_id", (-F.col("at_us") - ttl_us).alias("_t"))
    ahead = as_of(back, instants.select("_key", (-F.col("at_us")).alias("_t"), F.col("_id").alias("_next")), ["_key"], "_t", ["_next"], ttl_us)
    jump = ahead.filter("_next is not null").select("_id", "_next")
    missed = firsts.select("_id")
    # A chain over ``longest`` expiry times has at most that many steps after its first miss.
    rounds = int(longest).bit_length()
    for k in range(rounds):
        jump = saved(jump, "round")
        further = missed.join(jump, "_id").select(F.col("_next").alias("_id"))
        missed = saved(missed.unionByName(further), "round")
        then = jump.select(F.col("_id").alias("_next"), F.col("_next").alias("_then"))
        jump = jump.join(then, "_next").select("_id", F.col("_then").alias("_next"))
    found = instants.join(missed, "_id", "left_semi")
    cache_key = F.concat(F.lit(S.CACHE_KEY_PREFIX), F.lower(F.hex("_key")))
    return found.select(cache_key.alias("cache_key"), "at", "req_id", "at_us")


def retry_outcome(attempts, keys=("project_id", "task_id"), tries=S.MAX_TRIES, base=S.BACKOFF_BASE):
    """Outcome of every task from its attempts.

    The first success among the first ``tries`` attempts, else the error of
    the last of them; waits of ``base ** i`` seconds follow each failure that
    another try comes after.
    """
    used = attempts.filter(F.col("attempt") <= tries)
    first_ok = F.min(F.when(F.col("ok"), F.col("attempt")))
    failures = [
        F.count_if(~F.col("ok") & (F.col("attempt") == n)).alias(f"_failed_{n}") for n in range(1, tries)
    ]
    tasks = used.groupBy(*keys).agg(
        first_ok.alias("first_success"),
        F.max("attempt").alias("_seen"),
        F.max_by("error", "attempt").alias("_error"),
        *failures,
    )
    end = F.coalesce("first_success", F.lit(tries))
    waits = [
        F.when(F.lit(n) < end, F.col(f"_failed_{n}") * (base ** (n - 1))).otherwise(F.lit(0))
        for n in range(1, tries)
    ]
    return tasks.select(
        *keys,
        F.col("first_success").isNotNull().alias("succeeded"),
        F.coalesce("first_success", "_seen").alias("attempts_used"),
        F.when(F.col("first_success").isNull(), F.col("_error")).alias("error"),
        reduce(lambda a, b: a + b, waits, F.lit(0).cast("bigint")).alias("backoff_seconds"),
    )
