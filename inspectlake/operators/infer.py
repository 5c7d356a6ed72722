"""Model inference as a plug-in function run by Spark tasks.

A model is a function without arguments that builds, once per worker process and
``model_id``, an object with ``infer(list[(path, prompt)]) -> list[str]``.
"""

import time

import pandas as pd
from pyspark.sql import functions as F

from inspectlake import settings as S
from inspectlake.functions.envelope import parse_envelope
from inspectlake.operators import cache as C
from inspectlake.session import saved

_MODELS = {}


def _model(make, model_id):
    """The model ``model_id`` of this worker process, built on first use."""
    if model_id not in _MODELS:
        _MODELS[model_id] = make()
    return _MODELS[model_id]


def _schema(requests, *extra):
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return ", ".join([kept, *extra])


def _pairs(pdf):
    return list(zip(pdf["image_path"], pdf["prompt"]))


def _dealt(requests, parallelism):
    """Requests over ``parallelism`` tasks, dealt by the row alone."""
    return requests.repartition(parallelism, "req_id") if parallelism else requests


def batch_infer(requests, make, model_id, parallelism=None):
    """Add ``raw_response``; at most ``parallelism`` models run at once.

    Without a cap every input partition is a task of its own.

    An exception of the model fails the task; see ``infer_with_retry``.
    """

    def run(batches):
        for pdf in batches:
            yield pdf.assign(raw_response=_model(make, model_id).infer(_pairs(pdf)))

    return _dealt(requests, parallelism).mapInPandas(run, _schema(requests, "raw_response string"))


def _one_with_retry(model, pair, tries, base, sleep):
    for attempt in range(1, tries + 1):
        try:
            return model.infer([pair])[0], attempt, None
        except Exception as e:  # noqa: BLE001 - the model is user code
            if attempt == tries:
                return None, attempt, str(e)
            sleep(base ** (attempt - 1))


def _chunk_with_retry(model, pairs, tries, base, sleep):
    """A chunk in one call; when that raises, each of its requests by itself."""
    if len(pairs) > 1:
        try:
            return [(raw, 1, None) for raw in model.infer(pairs)]
        except Exception:  # noqa: BLE001 - found out per request below
            pass
    return [_one_with_retry(model, pair, tries, base, sleep) for pair in pairs]


def infer_with_retry(
    requests,
    make,
    model_id,
    parallelism=None,
    tries=S.MAX_TRIES,
    base=S.BACKOFF_BASE,
    sleep=time.sleep,
    batch_size=None,
):
    """Add ``raw_response, attempts, infer_error``; never fails the job.

    A request whose model call raises is tried again after ``base ** i``
    seconds; after the last try it becomes an error row.  The model gets
    ``batch_size`` requests per call (a whole Arrow batch by default) as long
    as none raises; then each of them by itself.
    """

    def run(batches):
        for pdf in batches:
            model = _model(make, model_id)
            pairs = _pairs(pdf)
            size = batch_size or max(1, len(pairs))
            chunks = [pairs[i : i + size] for i in range(0, len(pairs), size)]
            done = [one for c in chunks for one in _chunk_with_retry(model, c, tries, base, sleep)]
            raw, attempts, error = zip(*done) if done else ((), (), ())
            yield pdf.assign(
                raw_response=pd.Series(raw, index=pdf.index, dtype=object),
                attempts=pd.Series(attempts, index=pdf.index, dtype="int32"),
                infer_error=pd.Series(error, index=pdf.index, dtype=object),
            )

    extra = ["raw_response string", "attempts int", "infer_error string"]
    return _dealt(requests, parallelism).mapInPandas(run, _schema(requests, *extra))


def _asked(requests, make, model_id, options, name):
    answered = parse_envelope(infer_with_retry(requests, make, model_id, **options))
    return saved(answered.withColumn("error", F.coalesce("infer_error", "error")), name)


def _entries(answered):
    """Cache entries of the successful answers; ``leader`` says whose answer it is."""
    answer = F.struct(F.col("req_id").alias("leader"), F.col("raw_response").alias("text"))
    return answered.filter("success").select(
        F.col("req_id").alias("entry_id"), "image_path", "prompt", F.col("requested_at").alias("cached_at"), "success", answer.alias("result")
    )


def cached_infer(requests, cache, make, model_id, ttl=S.CACHE_TTL_SECONDS, **options):
    """Results of all requests, and the cache rows to append.

    Live entries answer what they can.  Of the other requests, only those that
    would miss when asked in time order reach the model; the rest share the
    answer of the one before them, so a request that is asked a million times
    is inferred once.  Only successes are shared: the followers of a failed
    request go to the model themselves in one further pass, and later ones
    share the first success among them.  ``cached`` is true for all that took
    another request's answer.  Matches and answers are written down: both are
    used more than once, and answers are costly to redo.
    """
    matched = saved(C.match_cache(requests, cache, ttl).drop("cache_key"), "matched")
    misses = C.cache_miss(matched)
    leaders = misses.join(C.cache_ttl_fold(misses, ttl).select("req_id"), "req_id", "left_semi")
    first = _asked(leaders, make, model_id, options, "answers")
    followed = saved(C.match_cache(misses, _entries(first), ttl).drop("cache_key"), "followed")
    alone = C.cache_miss(followed).join(first.select("req_id"), "req_id", "left_anti")
    second = _asked(alone, make, model_id, options, "answers")
    kept = C.cache_ttl_fold(second.filter("success"), ttl).select("req_id")
    settled = second.join(kept, "req_id", "left_semi")
    later = C.match_cache(second.select(*misses.columns), _entries(settled), ttl)

    def shared(rows):
        return rows.select(
            *misses.columns,
            F.col("result.text").alias("result"),
            F.lit(True).alias("success"),
            F.lit(None).cast("string").alias("error"),
            (F.col("req_id") != F.col("result.leader")).alias("cached"),
        )

    def own(rows):
        return rows.filter("not success").select(
            *misses.columns, F.col("raw_response").alias("result"), "success", "error", F.lit(False).alias("cached")
        )

    unshared = second.join(later.filter("hit").select("req_id"), "req_id", "left_anti")
    fresh = shared(followed.filter("hit")).unionByName(own(first)).unionByName(shared(later.filter("hit"))).unionByName(own(unshared))
    hits = C.cache_lookup(matched).withColumns({"success": F.lit(True), "cached": F.lit(True)})
    writes = first.unionByName(settled).withColumn("result", F.col("raw_response"))
    return C.with_cache_key(hits.unionByName(fresh, allowMissingColumns=True)), C.cache_writes(writes)
