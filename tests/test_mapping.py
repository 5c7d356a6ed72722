import random

from inspectlake.operators import mapping as M
from inspectlake.operators import review as R
from inspectlake.operators.merge import last_wins_merge


def fields(spark, rows):
    return spark.createDataFrame(rows, "project_id long, ord long, form_id string, name string, value string")


def extracted(spark, rows):
    return spark.createDataFrame(rows, "project_id long, key string, value string")


def test_mapping(spark):
    form = fields(spark, [(1, 1, "f", "Owner", "-"), (1, 2, "f", "ROOF", "-"), (1, 3, "f", "zzz", "-"), (1, 4, "f", "zzz", "-"),
                          (1, 5, "f", "Site-Address", "-"), (2, 1, "f", "name", "-"), (1, 6, "f", "", "-")])
    values = extracted(spark, [(1, "owner_name", "Ann"), (1, "address", None), (2, "address", "x")])
    aliases = M.alias_table(spark)
    mapped = {(r["project_id"], r["name"]): (r["value"], r["evidence"]) for r in M.map_fields(form, values, aliases).collect()}
    assert mapped == {(1, "Owner"): ("Ann", "Mapped from Owner"), (1, "Site-Address"): (None, "Mapped from Site-Address")}
    matched = M.match_fields(form, values, aliases)
    left = [(r["project_id"], r["name"]) for r in M.unmapped_fields(matched).orderBy("project_id", "ord").collect()]
    assert left == [(1, "ROOF"), (1, "zzz"), (1, "zzz"), (1, ""), (2, "name")]
    summary = {r["project_id"]: r["evidence"] for r in M.mapping_summary(matched).collect()}
    assert summary == {1: "Mapped 2 fields", 2: "Mapped 0 fields"}
    plan = {r["name"]: (r["selector"], r["fill_value"]) for r in M.fill_plan(matched).collect()}
    assert plan == {"Owner": ("[name='Owner']", "Ann"), "Site-Address": ("[name='Site-Address']", "None")}


def test_first_declared_canonical_wins(spark):
    aliases = M.alias_table(spark, {"b": ["Shared", "b2"], "a": ["shared", "b"]})
    form = fields(spark, [(1, 1, "f", "shared", "-"), (1, 2, "f", "B", "-"), (1, 3, "f", "a", "-")])
    got = {r["name"]: r["canonical_name"] for r in M.alias_join(form, aliases).collect()}
    assert got == {"shared": "b", "B": "b", "a": "a"}


def test_hot_project_gives_the_same_rows(spark):
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.5 else rng.randint(2, 9), n, "f", rng.choice(["owner", "issues", "roof", "q"]), "-") for n in range(600)]
    values = extracted(spark, [(p, k, f"{p}{k}") for p in range(1, 8) for k in ("owner_name", "damage")])
    aliases = M.alias_table(spark)

    got = {r["ord"]: (r["value"], r["found"]) for r in M.match_fields(fields(spark, rows), values, aliases).collect()}
    keys = {"owner": "owner_name", "issues": "damage"}
    assert got == {n: (f"{p}{keys[name]}", True) if p < 8 and name in keys else (None, False) for p, n, _, name, _ in rows}


def test_aliases_keep_order_and_case(spark):
    aliases = M.alias_table(spark, {"b": ["Zeta", "alpha"]})
    form = fields(spark, [(1, 1, "f", "zeta", "-"), (1, 2, "f", "other", "-")])
    mapped = M.map_fields(form, extracted(spark, [(1, "b", "v")]), aliases).collect()
    assert [(r["name"], r["aliases"]) for r in mapped] == [("zeta", ["Zeta", "alpha"])]


def test_null_overrides_and_edits_win(spark):
    pairs = spark.createDataFrame([(1, 1, 5, "a", "x"), (1, 2, 1, "a", None), (1, 1, 9, "b", "y")],
                                  "project_id long, phase long, ord long, key string, value string")
    merged = last_wins_merge(pairs)
    assert {r["key"]: r["value"] for r in merged.collect()} == {"a": None, "b": "y"}
    events = spark.createDataFrame(
        [(1, 1, "edit", "b", "one"), (2, 1, "edit", "b", "two"), (3, 1, "edit", "new", None), (4, 1, "approved", None, None),
         (5, 1, "rejected", None, None), (6, 2, "view", None, None)],
        "seq long, project_id long, action string, field_name string, new_value string")
    got = {r["key"]: (r["value"], r["edited"]) for r in R.review_overlay(merged, events).collect()}
    assert got == {"a": (None, False), "b": ("two", True), "new": (None, True)}
    status = R.approval_status(events)
    assert {r["project_id"]: r["approval_status"] for r in status.collect()} == {1: "rejected"}
    projects = spark.createDataFrame([(1,), (2,)], "project_id long")
    summary = spark.createDataFrame([(1, 3, 1, "Mapped 3 fields")], "project_id long, n_mapped long, n_unmapped long, evidence string")
    gate = {r["project_id"]: (r["approval_status"], r["n_mapped"], r["evidence"]) for r in R.approval_gate(projects, status, summary).collect()}
    assert gate == {1: ("rejected", 0, "Awaiting user approval"), 2: ("pending", 0, "Awaiting user approval")}
