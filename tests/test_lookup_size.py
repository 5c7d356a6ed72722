"""What the cache lookups carry through exchanges."""

from pyspark.sql import functions as F
from test_queries import plan_of

from inspectlake.operators import cache
from inspectlake.operators.ordered import as_of
from inspectlake.plans.caching import QUERIES
from inspectlake.plans.streams import QUERIES as STREAMS


def test_lookups_deal_by_the_digest_not_by_its_text(spark, sf):
    plan = plan_of(QUERIES["cache_lookup"](spark, sf))
    assert "hashpartitioning(_key" in plan and "hashpartitioning(cache_key" not in plan


def test_as_of_deals_each_side_as_seldom_as_it_can(spark):
    asks = spark.createDataFrame([("a", 5), ("a", 900), ("b", 1)], "k string, t bigint")
    entries = spark.createDataFrame([("a", 1, 1), ("a", 7, 7)], "k string, t bigint, v bigint")
    found = as_of(asks, entries, ["k"], "t", ["v"], 16, in_order=True)
    assert plan_of(found).split("Initial Plan")[-1].count("hashpartitioning(") <= 5
    assert {(r.k, r.t): r.v for r in found.collect()} == {("a", 5): 1, ("a", 900): 7, ("b", 1): None}


def test_the_fold_deals_by_the_digest_not_by_its_text(spark, sf):
    plan = plan_of(QUERIES["cache_ttl_fold"](spark, sf))
    assert "struct<_key:binary" in plan and "cache_key:string" not in plan


def test_the_stream_carries_numbers_not_keys_through_its_rounds(spark, sf, monkeypatch):
    written, rounds = cache.saved, []

    def noted(rows, name):
        rounds.extend([rows.columns] if name == "round" else [])
        return written(rows, name)

    monkeypatch.setattr(cache, "saved", noted)
    assert STREAMS["stream_cache"](spark, sf).count() > 0
    assert len(rounds) > 3 and not any("_key" in columns for columns in rounds)


def test_rounds_of_the_fold_carry_numbers_not_keys(spark, sf, monkeypatch):
    written, rounds = cache.saved, []

    def noted(rows, name):
        rounds.extend([rows.columns] if name == "round" else [])
        return written(rows, name)

    monkeypatch.setattr(cache, "saved", noted)
    plan = plan_of(QUERIES["cache_ttl_fold"](spark, sf))
    assert len(rounds) > 3 and not any("_key" in columns for columns in rounds)
    assert "hashpartitioning(_key" not in plan.split("Initial Plan")[-1]


def test_requests_without_key_or_time_are_no_misses(spark):
    rows = [(1, "a", "p", "2024-01-01"), (2, None, "p", "2024-01-01"), (3, "a", None, "2024-01-03"), (4, "a", "p", None), (5, "a", "p", "2024-01-02")]
    requests = spark.createDataFrame(rows, "req_id bigint, image_path string, prompt string, at string")
    timed = requests.withColumn("requested_at", F.col("at").cast("timestamp_ntz"))
    assert sorted(r.req_id for r in cache.cache_ttl_fold(timed.drop("at")).collect()) == [1, 5]
