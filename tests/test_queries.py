"""Every registered query against its SQL on DuckDB, and checks of plans."""

import contextlib
import io
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from inspectlake.fixtures import TABLES, fixture
from inspectlake.plans import ORACLES, QUERIES
from tools.check import rows_of


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got and got == rows_of(names, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) == set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_forced_broadcasts():
    folder = pathlib.Path(entry.__file__).parent / "inspectlake" / "operators"
    assert not [p.name for p in folder.glob("*.py") if "broadcast(" in p.read_text()]


def test_mapping_reads_each_input_once(spark, sf):
    for name, scans in (("map_fields", 2), ("unmapped_fields", 2)):
        assert plan_of(QUERIES[name](spark, sf)).count("Scan parquet") // 2 == scans


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not n.startswith(("stream_", "form_catalog"))])
def test_no_query_pairs_everything(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rank_filter_cuts_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan_of(QUERIES["first_unmapped"](spark, sf))


def test_responses_are_parsed_once(spark, sf):
    for name in ("image_record", "parse_envelope", "evidence_text"):
        assert plan_of(QUERIES[name](spark, sf)).count("ArrowEvalPython (") == 1


def test_filters_and_columns_reach_the_scan(spark, sf):
    rows = fixture(spark, sf, "fx_review_event").filter("project_id > 5").select("seq")
    plan = plan_of(rows)
    assert "GreaterThan(user_id,5)" in plan and "struct<event_id:bigint,user_id:bigint>" in plan
