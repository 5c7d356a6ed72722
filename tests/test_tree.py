import contextlib
import io
import random
import time

from inspectlake.operators import tree as X
from inspectlake.plans import QUERIES


def by_stack(items):
    """Nodes with parents and paths by walking one outline with a stack."""
    nodes, stack = [], []
    for ord_, title, level in items:
        stack = stack[:level]
        while len(stack) < level:
            stack.append(((ord_, len(stack)), ""))
            nodes.append(node(stack, True))
        stack.append(((ord_, level), title))
        nodes.append(node(stack, False))
    return nodes


def node(stack, fill):
    parent = stack[-2][0] if len(stack) > 1 else (None, None)
    return (*stack[-1][0], fill, *parent, " > ".join(t for _, t in stack))


def test_random_outlines(spark):
    rng = random.Random(7)
    outlines = {p: [(n, f"t{n}", rng.randint(0, 5)) for n in range(1, rng.randint(2, 30))] for p in range(60)}
    rows = [(p, n, t, lvl, "section") for p, items in outlines.items() for n, t, lvl in items]
    items = spark.createDataFrame(rows, "page_id long, ord long, title string, indent_level int, section_type string")
    filled = X.fill_levels(items)
    placed = X.parent_asof(filled)
    paths = X.section_path(filled)
    got = placed.join(paths.select("page_id", "ord", "level", "path"), ["page_id", "ord", "level"])
    got = sorted(
        (r["page_id"], r["ord"], r["level"], r["is_fill"], r["parent_ord"], r["parent_level"], r["path"]) for r in got.collect()
    )
    want = sorted((p, *n) for p, items in outlines.items() for n in by_stack(items))
    assert got == want


def test_a_very_deep_page(spark):
    rows = [(1, 1, "top", 0, "section"), (1, 2, "deep", 5000, "section"), (1, 3, "back", 1, "section")]
    items = spark.createDataFrame(rows, "page_id long, ord long, title string, indent_level int, section_type string")
    started = time.time()
    nodes = X.section_path(X.parent_asof(X.fill_levels(items))).collect()
    # A few seconds on a free machine; a column or job per level took minutes.
    assert time.time() - started < 90
    assert len(nodes) == 5002 and max(r["depth"] for r in nodes) == 5001
    assert [r["path"] for r in nodes if r["title"] == "back"] == ["top > back"]


def test_a_very_long_page(spark):
    n = 100_000
    rows = spark.range(1, n + 1).selectExpr("id % 2 as page_id", "id as ord", "concat('t', id) as title", "cast((id div 2) % 7 as int) as level")
    started = time.time()
    got = X.section_path(rows).selectExpr("count(*) as n", "count(distinct path) as paths", "max(length(path)) as longest", "sum(depth) as depths").first()
    assert time.time() - started < 30
    assert got.n == n and got.paths == n and got.depths == sum((k // 2) % 7 + 1 for k in range(1, n + 1))


def test_the_tree_takes_one_exchange(spark, sf):
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        QUERIES["parent_asof"](spark, sf).explain("formatted")
    # The input numbers its rows by another window, on the same key.
    assert plan.getvalue().count("Exchange (") <= 2 and plan.getvalue().count("Scan parquet  (") == 1


def test_item_section_only_with_item_fields(spark):
    items = spark.createDataFrame([(1, 1, "A", 0, "section"), (2, 1, "B", 0, "section")],
                                  "page_id long, ord long, title string, indent_level int, section_type string")
    fields = spark.createDataFrame([(1, 1, "report", "x"), (1, 2, "item_9", "y"), (1, 3, "item_9", "z"), (2, 4, "report", "w")],
                                   "page_id long, ord long, form_id string, name string")
    pages = items.select("page_id").distinct()
    nodes = X.parent_asof(X.fill_levels(items))
    tree = X.union_tree(nodes, pages, fields, "report", "item_").orderBy("page_id", "sort_key", "sort_ord").collect()
    assert [(r["page_id"], r["title"], r["parent_id"]) for r in tree] == [
        (1, "Report Information", "root"), (1, "A", "root"), (1, "Condition Action Items", "root"), (1, "Action Item 9", "items"),
        (2, "Report Information", "root"), (2, "B", "root"),
    ]
