"""Rows that are dealt once by a number that grows with the table are not dealt again."""

import re

import pytest
from pyspark.sql import functions as F
from test_queries import plan_of

from inspectlake.fixtures import fixture, table
from inspectlake.functions.envelope import parse_envelope
from inspectlake.operators import forms as H
from inspectlake.operators import merge as G
from inspectlake.operators import records as R
from inspectlake.operators import tree as X
from inspectlake.operators.ordered import dealt, tasks_for
from inspectlake.plans import QUERIES
from inspectlake.session import saved


def test_tasks_grow_with_the_rows(spark):
    assert [tasks_for(spark.range(n), 100) for n in (0, 400, 401, 1000)] == [4, 4, 5, 10]


@pytest.fixture(scope="module")
def nodes(spark, sf):
    return dealt(saved(H.html_to_nodes(fixture(spark, sf, "fx_form_html")), "nodes"), "page_id", per_task=100)


def stays(rows, tasks):
    plan = plan_of(rows)
    return "ENSURE_REQUIREMENTS" not in plan and "hashpartitioning(page_id" in plan and f", {tasks}), REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("step", ["form_fields", "resolve_label", "choice_options", "tag_fields"])
def test_form_steps_stay_where_the_pages_are(nodes, step):
    assert stays(getattr(H, step)(nodes), nodes.rdd.getNumPartitions()) and nodes.rdd.getNumPartitions() > 4


def test_outline_steps_stay_where_the_pages_are(spark, sf):
    entries = fixture(spark, sf, "fx_outline", lambda rows: dealt(rows, "l_orderkey", per_task=1000))
    placed = X.parent_asof(X.fill_levels(X.outline_items(entries)))
    plan, tasks = plan_of(placed), tasks_for(table(spark, sf, "lineitem"), 1000)
    assert tasks > 4 and "ENSURE_REQUIREMENTS" not in plan and f", {tasks}), REPARTITION_BY_NUM" in plan
    # A fold over the sections of a page needs no dealing of its own.
    assert "ENSURE_REQUIREMENTS" not in plan_of(X.section_path(placed)) and plan_of(X.section_path(placed)).count("REPARTITION_BY") == plan.count("REPARTITION_BY")


def test_images_are_reduced_before_their_keys_are_rows(spark, sf):
    responses = G.dealt_by_project(fixture(spark, sf, "fx_response"), "resp_id")
    records = R.image_records(parse_envelope(responses))
    plan = plan_of(G.last_wins_merge(G.rename_keys(G.image_pairs(G.last_images(records, "resp_id"), "resp_id"))))
    # One dealing of the responses and one of what is left per project and part.
    assert "REPARTITION_BY_NUM" in plan and plan.split("Initial Plan")[-1].count("ENSURE_REQUIREMENTS") <= 1
    query = plan_of(QUERIES["fillable_fields"](spark, sf))
    assert "hashpartitioning(project_id" in query and "REPARTITION_BY_NUM" in query and "_part" in query


@pytest.mark.parametrize("skip_failed", [False, True])
@pytest.mark.parametrize("deal", [lambda rows: rows, lambda rows: G.dealt_by_project(rows, "resp_id")])
def test_last_images_give_the_same_values(spark, sf, skip_failed, deal):
    records = R.image_records(parse_envelope(deal(fixture(spark, sf, "fx_response"))))

    def values(rows):
        pairs = G.image_pairs(rows, "resp_id", skip_failed)
        return sorted(map(tuple, G.last_wins_merge(G.rename_keys(pairs)).collect()), key=str)

    last = G.last_images(records, "resp_id", skip_failed)
    assert last.count() == last.select("project_id").distinct().count()
    assert values(last) == values(records) != []


@pytest.mark.parametrize("name", ["resolve_label", "choice_options", "section_tree"])
def test_written_nodes_are_in_files_of_bounded_rows(spark, sf, monkeypatch, name):
    written, by_page = [], H.by_page
    monkeypatch.setattr(H, "NODES_PER_FILE", 50, raising=False)
    monkeypatch.setattr(H, "by_page", lambda nodes: written.append(nodes) or by_page(nodes))
    QUERIES[name](spark, sf)
    # A task that deals the nodes sorts the rows of its files.
    in_files = [r["count"] for r in written[0].groupBy(F.input_file_name()).count().collect()]
    assert sum(in_files) > 1000 and max(in_files) <= 50


@pytest.mark.parametrize("name", ["union_tree", "root_order"])
def test_whole_trees_deal_the_outline_once(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf)).split("Initial Plan")[-1]
    # The outline by page, in tasks that grow with the table; other exchanges are of pages and fields.
    assert plan.count("REPARTITION_BY_NUM") == 1 and "hashpartitioning(page_id" in plan


def test_the_section_tree_stays_where_the_pages_are(spark, sf, monkeypatch):
    monkeypatch.setattr(H, "by_page", lambda nodes: dealt(nodes, "page_id", per_task=100))
    plan = plan_of(QUERIES["section_tree"](spark, sf)).split("Initial Plan")[-1]
    tasks = {int(n) for n in re.findall(r"hashpartitioning\(page_id#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)}
    # The nodes in tasks that grow with them; the pages alone are a scan dealt over the cores.
    assert max(tasks) > 4 and "ENSURE_REQUIREMENTS" not in plan
