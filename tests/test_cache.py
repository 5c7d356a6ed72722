import datetime
import functools
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from inspectlake.operators import cache as C
from inspectlake.operators import infer as N
from inspectlake.operators.ordered import as_of

START = datetime.datetime(2024, 1, 1)
HOUR = datetime.timedelta(hours=1)
REQUEST = "req_id long, image_path string, prompt string, requested_at timestamp_ntz"
ENTRY = "entry_id long, image_path string, prompt string, cached_at timestamp_ntz, success boolean, result string"


def some_requests(n, seed, paths=3, hours=200):
    rng = random.Random(seed)
    return [(i, f"i{rng.randrange(paths)}", "p", START + HOUR * rng.randrange(hours)) for i in range(n)]


def some_entries(n, seed):
    return [(i, p, q, t, i % 4 != 0, f"r{i}") for i, p, q, t in some_requests(n, seed)]


@pytest.mark.parametrize("slices", [1024, 3])
def test_lookup_equals_a_loop(spark, slices, monkeypatch):
    monkeypatch.setattr("inspectlake.operators.ordered.SLICES", slices)
    asked, stored = some_requests(300, 1), some_entries(60, 2)
    requests, cache = spark.createDataFrame(asked, REQUEST), spark.createDataFrame(stored, ENTRY)
    got = {r["req_id"]: r["result"] for r in C.match_cache(requests, cache).collect()}
    assert len(got) == 300
    for i, path, _, at in asked:
        live = [(t, e, r) for e, p, _, t, ok, r in stored if ok and p == path and t <= at]
        last = max(live) if live else None
        assert got[i] == (last[2] if last and at < last[0] + 24 * HOUR else None)


def test_micros_do_not_depend_on_the_time_zone(spark):
    times = [datetime.datetime(2024, 3, 31, 2, 30, 0, 123456), datetime.datetime(1969, 12, 31, 23, 59, 59, 5)]
    rows = spark.createDataFrame([(t,) for t in times], "at timestamp_ntz").select("at", C.micros_of(F.col("at")).alias("us"))
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = {r["at"]: r["us"] for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    epoch = datetime.datetime(1970, 1, 1)
    assert got == {t: (t - epoch) // datetime.timedelta(microseconds=1) for t in times}


def chain(asked, ttl=24 * HOUR):
    last, misses = {}, set()
    for at, i, path in sorted((t, i, p) for i, p, _, t in asked):
        if path not in last or at >= last[path] + ttl:
            last[path] = at
            misses.add(i)
    return misses


def test_results_are_in_no_exchange_but_the_last(spark, tmp_path):
    spark.createDataFrame(some_requests(30, 1), REQUEST).write.parquet(str(tmp_path / "requests"))
    spark.createDataFrame(some_entries(60, 2), ENTRY).write.parquet(str(tmp_path / "cache"))
    requests, cache = (spark.read.parquet(str(tmp_path / n)) for n in ("requests", "cache"))
    plan = C.match_cache(requests, cache)._jdf.queryExecution().explainString(ExplainMode(spark, "formatted"))
    nodes = [n for n in re.split(r"\n\n+", plan) if re.match(r"\(\d+\) ", n)]
    exchanges = [n for n in nodes if " Exchange" in n.splitlines()[0]]
    # Only the one that tells repeated entries apart, and the join after it needs no other.
    assert len(exchanges) > 5 and not any("result#" in n for n in exchanges) and sum("first#" in n for n in exchanges) == 1
    assert not any("result#" in n for n in nodes if " Window" in n.splitlines()[0])


def ExplainMode(spark, name):
    return spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(name)


def test_as_of_over_stretches_and_slices(spark, monkeypatch):
    monkeypatch.setattr("inspectlake.operators.ordered.SLICES", 4)
    rng = random.Random(4)
    asks = sorted({(rng.randrange(3), rng.randrange(-500, 500)) for _ in range(200)})
    stored = sorted({(rng.randrange(3), rng.randrange(-500, 500)) for _ in range(25)})
    left, right = spark.createDataFrame(asks, "k long, t long"), spark.createDataFrame([(k, t, f"{t}") for k, t in stored], "k long, t long, v string")
    got = {(r.k, r.t): r.v for r in as_of(left, right, ["k"], "t", ["v"], 16).collect()}
    want = {(k, t): max((s for j, s in stored if j == k and s <= t), default=None) for k, t in asks}
    assert got == {a: None if s is None else str(s) for a, s in want.items()}


@pytest.mark.parametrize("ttl", [24, 1, 7, 10_000])
def test_expiry_chain_equals_a_loop(spark, ttl):
    asked = some_requests(400, 3) + [(1000 + i, "rare", "p", START + HOUR * i * 11) for i in range(9)] + [(2000, "once", "p", START)]
    requests = spark.createDataFrame(asked, REQUEST)
    got = {r["req_id"] for r in C.cache_ttl_fold(requests, ttl=ttl * 3600).collect()}
    assert got == chain(asked, ttl * HOUR)


def test_expiry_goes_on_from_earlier_writes(spark):
    asked = some_requests(300, 7)
    middle = START + 100 * HOUR
    early, late = [r for r in asked if r[3] < middle], [r for r in asked if r[3] >= middle]
    before = C.cache_ttl_fold(spark.createDataFrame(early, REQUEST))
    writes = before.groupBy("cache_key").agg(F.max("at_us").alias("last_us"))
    after = C.cache_ttl_fold(spark.createDataFrame(late, REQUEST), writes=writes)
    assert {r["req_id"] for r in before.unionByName(after).collect()} == chain(asked)


def test_a_long_chain_takes_logarithmically_many_jobs(spark):
    """One key with a third of all requests over 400 days, against as many keys asked once."""
    days = [(i, "hot", "p", START + HOUR * 7 * i) for i in range(400 * 24 // 7)]
    others = [(10_000 + i, f"i{i}", "p", START + HOUR * (i % 9000)) for i in range(2 * len(days))]
    jobs = {}
    for name, rows in (("short", others), ("long", days + others)):
        spark.sparkContext.setJobGroup(name, name)
        requests = spark.createDataFrame(rows, REQUEST)
        got = {r["req_id"] for r in C.cache_ttl_fold(requests).select("req_id").collect()}
        jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        assert got == chain(rows)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # 400 expiry times are nine rounds, not four hundred.
    assert jobs["long"] - jobs["short"] <= 9 * 10


def test_second_run_needs_no_inference(spark):
    asked = some_requests(120, 4, paths=10, hours=20)
    requests = spark.createDataFrame(asked, REQUEST)
    results, writes = N.cached_infer(requests, spark.createDataFrame([], ENTRY), Restated, "restated")
    assert results.count() == 120 and results.filter("success").count() == 120
    assert {r["req_id"] for r in results.filter("not cached").collect()} == chain(asked)
    again, new = N.cached_infer(requests, writes, Restated, "restated")
    assert new.count() == 0 and again.filter("cached").count() == 120
    assert sorted(r["result"] for r in again.collect()) == sorted(r["result"] for r in results.collect())


class Restated:
    """A fake model whose answer restates the request."""

    def infer(self, requests):
        return [f'{{"room": "{prompt} of {path}"}}' for path, prompt in requests]


class Broken:
    def infer(self, requests):
        raise RuntimeError("out of order")


class Fenced:
    def infer(self, requests):
        return ["```json\n{\"room\": \"x\"}\n```" if path != "bad" else "sorry" for path, _ in requests]


def test_a_raising_model_gives_error_rows(spark):
    requests = spark.createDataFrame(some_requests(5, 5), REQUEST)
    rows = N.infer_with_retry(requests, Broken, "broken", sleep=lambda s: None).collect()
    assert {(r["attempts"], r["infer_error"], r["raw_response"]) for r in rows} == {(3, "out of order", None)}
    results, writes = N.cached_infer(requests, spark.createDataFrame([], ENTRY), Broken, "broken", sleep=lambda s: None)
    assert results.count() == 5 and writes.count() == 0
    assert {r["error"] for r in results.collect()} == {"out of order"}


class Picky:
    def infer(self, requests):
        if any(path == "i1" for path, _ in requests):
            raise RuntimeError("not i1")
        return [path for path, _ in requests]


def test_a_bad_request_does_not_spoil_its_batch(spark):
    requests = spark.createDataFrame(some_requests(30, 8), REQUEST)
    rows = N.infer_with_retry(requests, Picky, "picky", sleep=lambda s: None, batch_size=8).collect()
    assert len(rows) == 30
    for r in rows:
        bad = r["image_path"] == "i1"
        assert (r["raw_response"], r["infer_error"]) == ((None, "not i1") if bad else (r["image_path"], None))
        assert r["attempts"] == (3 if bad else 1)


def test_waits_double():
    waited = []
    assert N._one_with_retry(Broken(), ("a", "p"), 3, 2, waited.append) == (None, 3, "out of order")
    assert waited == [1, 2]


def test_failures_are_not_cached(spark):
    requests = spark.createDataFrame([(1, "ok", "p", START), (2, "bad", "p", START)], REQUEST)
    results, writes = N.cached_infer(requests, spark.createDataFrame([], ENTRY), Fenced, "fenced")
    assert {r["req_id"]: r["success"] for r in results.collect()} == {1: True, 2: False}
    assert [r["image_path"] for r in writes.collect()] == ["ok"]


def failing_first(marker):
    """A fake model whose very first answer is no JSON, whichever worker gives it."""

    class FailingFirst:
        def infer(self, requests):
            texts = []
            for path, _ in requests:
                first = not os.path.exists(marker)
                open(marker, "a").close()
                texts.append("no idea" if first else '{"room": "%s"}' % path)
            return texts

    return FailingFirst


def test_a_failure_is_not_shared(spark, tmp_path):
    asked = [(1, "i", "p", START), (2, "i", "p", START + HOUR), (3, "i", "p", START + 2 * HOUR), (4, "i", "p", START + 40 * HOUR)]
    requests = spark.createDataFrame(asked, REQUEST)
    model = failing_first(str(tmp_path / "asked"))
    results, writes = N.cached_infer(requests, spark.createDataFrame([], ENTRY), model, "failing-first", parallelism=1)
    got = {r["req_id"]: (r["success"], r["result"], r["cached"]) for r in results.collect()}
    fine = '{"room": "i"}'
    assert got == {1: (False, "no idea", False), 2: (True, fine, False), 3: (True, fine, True), 4: (True, fine, False)}
    assert sorted(r["entry_id"] for r in writes.collect()) == [2, 4]


def test_models_are_told_apart_by_their_id(spark):
    class Says:
        def __init__(self, word):
            self.word = word

        def infer(self, requests):
            return [self.word for _ in requests]

    requests = spark.createDataFrame(some_requests(3, 9), REQUEST).coalesce(1)
    for word in ("one", "two"):
        rows = N.batch_infer(requests, functools.partial(Says, word), word).collect()
        assert {r["raw_response"] for r in rows} == {word}


def test_the_cap_bounds_the_tasks(spark):
    requests = spark.createDataFrame(some_requests(50, 6), REQUEST)
    rows = N.batch_infer(requests, Restated, "restated", parallelism=2).select(F.spark_partition_id().alias("p")).distinct()
    assert rows.count() <= 2


def test_retry_outcome(spark):
    tries = [
        (1, 1, 1, False, "a"), (1, 1, 2, True, None), (1, 1, 3, False, "late"),
        (1, 2, 1, False, "a"), (1, 2, 2, False, "b"), (1, 2, 3, False, "c"), (1, 2, 4, True, None),
        (1, 3, 1, True, None),
    ]
    rows = spark.createDataFrame(tries, "project_id long, task_id long, attempt int, ok boolean, error string")
    got = {r["task_id"]: (r["succeeded"], r["attempts_used"], r["error"], r["backoff_seconds"]) for r in C.retry_outcome(rows).collect()}
    assert got == {1: (True, 2, None, 1), 2: (False, 3, "c", 3), 3: (True, 1, None, 0)}
