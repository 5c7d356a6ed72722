"""Queries over outlines and section trees."""

from pyspark.sql import functions as F

from inspectlake.fixtures import fixture, with_fixtures
from inspectlake.functions import text as T
from inspectlake.operators import tree as X
from inspectlake.operators.ordered import dealt

REPORT_FORM = "edit_report_1"
ITEM_PREFIX = "edit_item_"


def _entries(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_outline")


def _items(spark, sf_dir):
    """The outline items, dealt by page before they are numbered, so that no later step deals them again."""
    return X.outline_items(fixture(spark, sf_dir, "fx_outline", lambda rows: dealt(rows, "l_orderkey")))


def _nodes(items):
    return X.parent_asof(X.fill_levels(items))


def _tree(spark, sf_dir):
    items, fields = _items(spark, sf_dir), _fields(spark, sf_dir)
    pages = _entries(spark, sf_dir).select("page_id").union(fields.select("page_id")).distinct()
    return X.union_tree(_nodes(items), pages, fields, REPORT_FORM, ITEM_PREFIX)


def _fields(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_form_field").withColumnRenamed("project_id", "page_id")


def _long(rows, *names):
    return rows.withColumns({n: F.col(n).cast("bigint") for n in names})


def indent_level(spark, sf_dir):
    level = T.indent_level(F.col("cls")).cast("bigint")
    return _long(_entries(spark, sf_dir).select("page_id", "ord", level.alias("indent_level")), "ord")


def section_type(spark, sf_dir):
    kind = T.section_type(F.col("cls"))
    return _long(_entries(spark, sf_dir).select("page_id", "ord", kind.alias("section_type")), "ord")


def clean_title(spark, sf_dir):
    title = T.clean_title(F.col("raw_title"))
    return _long(_entries(spark, sf_dir).select("page_id", "ord", title.alias("title")), "ord")


def fill_levels(spark, sf_dir):
    nodes = X.fill_levels(_items(spark, sf_dir))
    return _long(nodes.select("page_id", "ord", "level", "is_fill", "title", "section_type"), "ord", "level")


def parent_asof(spark, sf_dir):
    nodes = _nodes(_items(spark, sf_dir))
    return _long(
        nodes.select("page_id", "ord", "level", "is_fill", "parent_ord", "parent_level"),
        "ord", "level", "parent_ord", "parent_level",
    )


def section_path(spark, sf_dir):
    paths = X.section_path(X.fill_levels(_items(spark, sf_dir)))
    return _long(paths.select("page_id", "ord", "level", "path", "depth"), "ord", "level", "depth")


def split_form_fields(spark, sf_dir):
    report, items = X.split_form_fields(_fields(spark, sf_dir), REPORT_FORM)
    return report.select("ord", F.lit("report").alias("part")).unionByName(
        items.select("ord", F.lit("item").alias("part"))
    )


def item_title(spark, sf_dir):
    _, items = X.split_form_fields(_fields(spark, sf_dir), REPORT_FORM)
    return items.select("ord", T.item_title(F.col("form_id"), ITEM_PREFIX).alias("title"))


def form_groups(spark, sf_dir):
    _, items = X.split_form_fields(_fields(spark, sf_dir), REPORT_FORM)
    return X.form_groups(items)


def union_tree(spark, sf_dir):
    return _long(_tree(spark, sf_dir), "sort_key", "sort_ord")


def root_order(spark, sf_dir):
    top = _long(X.root_order(_tree(spark, sf_dir)), "sort_key", "sort_ord")
    return top.orderBy("page_id", "sort_key", "sort_ord")


def catalog_counts(spark, sf_dir):
    fields = _fields(spark, sf_dir)
    tags = fields.filter("name = ''").select("page_id")
    outline = _entries(spark, sf_dir).select("page_id")
    return X.catalog_counts(fields, outline, tags, REPORT_FORM)


QUERIES = {
    "indent_level": indent_level,
    "section_type": section_type,
    "clean_title": clean_title,
    "fill_levels": fill_levels,
    "parent_asof": parent_asof,
    "section_path": section_path,
    "split_form_fields": split_form_fields,
    "item_title": item_title,
    "form_groups": form_groups,
    "union_tree": union_tree,
    "root_order": root_order,
    "catalog_counts": catalog_counts,
}

ITEMS = """, items as (select page_id, ord, trim(regexp_replace(raw_title, '\\s+', ' ', 'g')) as title,
 coalesce(try_cast(nullif(regexp_extract(cls, 'indent-level-([0-9]+)', 1), '') as bigint), 0) as lvl,
 case when contains(cls, 'info_table_section') then 'info_table' when contains(cls, 'report_section') then 'report_section' else 'section' end as section_type from fx_outline),
steps as (select *, coalesce(lag(lvl) over (partition by page_id order by ord), -1) as prev from items),
nodes as (select page_id, ord, unnest(range(least(prev + 1, lvl), lvl + 1)) as level, lvl, title, section_type from steps),
tree as (select page_id, ord, level, level < lvl as is_fill, case when level < lvl then '' else title end as title,
 case when level = lvl then section_type end as section_type, ord * 1000 + level as pos from nodes),
-- the parent by brute force: the latest earlier node one level up
parents as (select c.page_id, c.pos, max(p.pos) as parent_pos from tree c join tree p
 on p.page_id = c.page_id and p.level = c.level - 1 and p.pos < c.pos group by c.page_id, c.pos),
placed as (select t.*, cast(floor(parent_pos / 1000) as bigint) as parent_ord, parent_pos % 1000 as parent_level, parent_pos
 from tree t left join parents p on p.page_id = t.page_id and p.pos = t.pos)
"""


def _outline(text, *more):
    return with_fixtures(ITEMS + text, "fx_outline", *more)


FIELDS = """, fields as (select project_id as page_id, ord, form_id, name from fx_form_field),
item_fields as (select * from fields where form_id <> 'edit_report_1')
"""
UNION = ITEMS + FIELDS + """, all_nodes as (
 select page_id, 'report' as node_id, 'root' as parent_id, 'Report Information' as title, 'metadata' as section_type, cast(0 as bigint) as sort_key, cast(null as bigint) as sort_ord
 from (select page_id from items union select page_id from fields)
 union all select page_id, 'outline:' || ord || ':' || level, coalesce('outline:' || parent_ord || ':' || parent_level, 'root'), title, section_type, 1, ord from placed
 union all select distinct page_id, 'items', 'root', 'Condition Action Items', 'data_items', 2, cast(null as bigint) from item_fields
 union all select page_id, 'item:' || form_id, 'items', 'Action Item ' || replace(form_id, 'edit_item_', ''), 'action_item', 2, min(ord) from item_fields group by page_id, form_id)
"""

ORACLES = {
    "indent_level": _outline("select page_id, ord, lvl as indent_level from items"),
    "section_type": _outline("select page_id, ord, section_type from items"),
    "clean_title": _outline("select page_id, ord, title from items"),
    "fill_levels": _outline("select page_id, ord, level, is_fill, title, section_type from tree"),
    "parent_asof": _outline("select page_id, ord, level, is_fill, parent_ord, parent_level from placed"),
    "section_path": with_fixtures(
        ITEMS
        + """, walk as (
 select page_id, pos, ord, level, title as path, cast(1 as bigint) as depth from placed where level = 0
 union all select c.page_id, c.pos, c.ord, c.level, w.path || ' > ' || c.title, w.depth + 1
 from placed c join walk w on w.page_id = c.page_id and w.pos = c.parent_pos)
select page_id, ord, level, path, depth from walk""",
        "fx_outline",
    ).replace("with ", "with recursive ", 1),
    "split_form_fields": with_fixtures(
        "select ord, case when form_id = 'edit_report_1' then 'report' else 'item' end as part from fx_form_field",
        "fx_form_field",
    ),
    "item_title": with_fixtures(
        FIELDS + "select ord, 'Action Item ' || replace(form_id, 'edit_item_', '') as title from item_fields", "fx_form_field"
    ),
    "form_groups": with_fixtures(
        FIELDS + "select page_id, form_id, min(ord) as first_ord, count(*) as n_fields from item_fields group by page_id, form_id",
        "fx_form_field",
    ),
    "union_tree": with_fixtures(UNION + "select * from all_nodes", "fx_outline", "fx_form_field"),
    "root_order": with_fixtures(
        UNION + "select page_id, node_id, title, sort_key, sort_ord from all_nodes where parent_id = 'root'",
        "fx_outline", "fx_form_field",
    ),
    "catalog_counts": with_fixtures(
        FIELDS
        + """, f as (select page_id, count(*) as n_fields, count(*) filter (where name = '') as n_tags,
 count(*) filter (where form_id = 'edit_report_1') as n_report_fields, count(*) filter (where form_id <> 'edit_report_1') as n_item_fields from fields group by page_id),
 o as (select page_id, count(*) as n_outline from fx_outline group by page_id)
select coalesce(f.page_id, o.page_id) as page_id, coalesce(n_outline, 0) as n_outline, coalesce(n_fields, 0) as n_fields, coalesce(n_tags, 0) as n_tags,
 coalesce(n_report_fields, 0) as n_report_fields, coalesce(n_item_fields, 0) as n_item_fields from f full join o on o.page_id = f.page_id""",
        "fx_outline", "fx_form_field",
    ),
}
