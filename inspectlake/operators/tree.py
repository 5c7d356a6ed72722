"""Section trees from outline levels.

A node is known by ``(page_id, ord, level)``: the item it came from and its
own level, which differ for the untitled nodes that fill a skipped level.
"""

from functools import reduce

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from inspectlake.functions import text as T

REPORT, OUTLINE, ITEMS = 0, 1, 2


def outline_items(entries):
    """Level, kind and clean title of every outline entry."""
    return entries.select(
        "page_id",
        "ord",
        T.clean_title(F.col("raw_title")).alias("title"),
        T.indent_level(F.col("cls")).alias("indent_level"),
        T.section_type(F.col("cls")).alias("section_type"),
    )


def _page(*more):
    return Window.partitionBy("page_id", *more).orderBy("ord")


def fill_levels(items):
    """Every item and, before one that skips levels, an untitled node per level.

    ``parent_ord`` is set where the parent is known from the item before: a
    node one level below it, or below a fill node of the same item.
    """
    rows = items.withColumns(
        {"_prev_level": F.lag("indent_level").over(_page()), "_prev_ord": F.lag("ord").over(_page())}
    )
    rows = rows.withColumn("_next", F.coalesce("_prev_level", F.lit(-1)) + 1)
    lowest = F.least("_next", "indent_level")
    nodes = rows.withColumn("level", F.explode(F.sequence(lowest, F.col("indent_level"))))
    is_fill = F.col("level") < F.col("indent_level")
    known = F.when(F.col("level") > F.col("_next"), F.col("ord")).when(
        F.col("level") == F.col("_next"), F.col("_prev_ord")
    )
    return nodes.select(
        "page_id",
        "ord",
        "level",
        is_fill.alias("is_fill"),
        F.when(is_fill, "").otherwise(F.col("title")).alias("title"),
        F.when(~is_fill, F.col("section_type")).alias("section_type"),
        known.alias("parent_ord"),
        ((F.col("level") > 0) & (F.col("level") < F.col("_next"))).alias("_asks"),
    )


def parent_asof(nodes):
    """Add the parent of every node of ``fill_levels``.

    The parent of a node at level L is the latest earlier node at level L-1.
    Only nodes that go back up or stay on their level have to ask; such a node
    is there twice, as an answer under its own level and as a question under
    the level above, in one window per page and level.  A page comes from one
    input row, and rows dealt by page serve this window too, so the tree needs
    one exchange.
    """
    answer = F.struct(F.col("level").alias("at"), F.lit(False).alias("asks"))
    question = F.struct((F.col("level") - 1).alias("at"), F.lit(True).alias("asks"))
    roles = F.explode(F.when(F.col("_asks"), F.array(answer, question)).otherwise(F.array(answer)))
    rows = nodes.withColumn("_role", roles).withColumns(
        {"_at": F.col("_role.at"), "_question": F.col("_role.asks")}
    )
    so_far = _page("_at").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(~F.col("_question"), F.col("ord")), ignorenulls=True).over(so_far)
    return (
        rows.withColumn("_parent", latest)
        .filter(F.col("_question") == F.col("_asks"))
        .withColumn("parent_ord", F.when(F.col("_asks"), F.col("_parent")).otherwise(F.col("parent_ord")))
        .withColumn("parent_level", F.when(F.col("level") > 0, F.col("level") - 1))
        .drop("_role", "_parent", "_asks", "_question", "_at")
    )


def section_path(nodes, separator=" > "):
    """Titles from the root down to every node, and its depth.

    The rows of a page come to one task in order, and a fold over them emits each node with
    its path: a node at level L keeps the first L titles of the path before it.  It holds
    one path and one batch of rows at a time, so the length of a page costs no memory and
    no more than its own time.  Titles must not be null.
    """
    kept = [c for c in nodes.columns if not c.startswith("_")]
    # Numbering the rows of a page puts them in one task and in order; rows that are dealt by page stay where they are.
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("ord", "level"))
    rows = nodes.select(place.alias("_place"), "level", "title", *[c for c in kept if c not in ("level", "title")])

    def placed(batches):
        stack = []
        for batch in batches:
            paths = []
            for place, level, title in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if place == 1:
                    stack = []
                del stack[level:]
                stack.append(title)
                paths.append(separator.join(stack))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.string())], names=[*batch.schema.names, "path"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(placed, f"{kinds}, path string").select(*kept, "path", (F.col("level") + 1).alias("depth"))


def split_form_fields(fields, report_form):
    """The fields of the report's own form, and all others."""
    return fields.filter(F.col("form_id") == report_form), fields.filter(F.col("form_id") != report_form)


def form_groups(fields, page="page_id"):
    """One row per page and form: its first position and field count.

    ``first_ord`` puts the groups in first-seen order.
    """
    return fields.groupBy(page, "form_id").agg(
        F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n_fields")
    )


def union_tree(nodes, pages, fields, report_form, item_prefix, page="page_id"):
    """The whole tree of ``pages(page_id)`` as an adjacency list.

    The report's information node, the outline, and, only for pages that have
    item fields, the item section with one node per item form.
    """
    _, items = split_form_fields(fields, report_form)
    groups = form_groups(items, page)
    nothing = F.lit(None).cast("bigint")

    def frame(rows, page_col, node, parent, title, kind, key, order):
        return rows.select(
            F.col(page_col).alias("page_id"),
            node.alias("node_id"),
            parent.alias("parent_id"),
            title.alias("title"),
            kind.alias("section_type"),
            F.lit(key).alias("sort_key"),
            order.alias("sort_ord"),
        )

    def name_of(ord_col, level_col):
        return F.concat_ws(":", F.lit("outline"), ord_col.cast("string"), level_col.cast("string"))

    root = F.lit("root")
    above = F.coalesce(
        F.when(F.col("level") > 0, name_of(F.col("parent_ord"), F.col("parent_level"))), root
    )
    return reduce(
        lambda a, b: a.unionByName(b),
        [
            frame(pages, "page_id", F.lit("report"), root, F.lit("Report Information"),
                  F.lit("metadata"), REPORT, nothing),
            frame(nodes, "page_id", name_of(F.col("ord"), F.col("level")), above, F.col("title"),
                  F.col("section_type"), OUTLINE, F.col("ord").cast("bigint")),
            frame(items.select(page).distinct(), page, F.lit("items"), root,
                  F.lit("Condition Action Items"), F.lit("data_items"), ITEMS, nothing),
            frame(groups, page, F.concat(F.lit("item:"), F.col("form_id")), F.lit("items"),
                  T.item_title(F.col("form_id"), item_prefix), F.lit("action_item"), ITEMS,
                  F.col("first_ord").cast("bigint")),
        ],
    )


def root_order(tree):
    """The children of the root with their place: report, outline, items."""
    return tree.filter("parent_id = 'root'").select("page_id", "node_id", "title", "sort_key", "sort_ord")


def catalog_counts(fields, outline, tags, report_form, page="page_id"):
    """Outline, field, tag, report-field and item-field counts per page."""
    def counted(rows, page_col, name):
        return rows.select(F.col(page_col).alias("page_id"), F.lit(name).alias("_of"), F.lit(None).alias("form_id"))

    rows = (
        fields.select(F.col(page).alias("page_id"), F.lit("field").alias("_of"), "form_id")
        .unionByName(counted(outline, "page_id", "outline"))
        .unionByName(counted(tags, "page_id", "tag"))
    )
    field = F.col("_of") == "field"
    return rows.groupBy("page_id").agg(
        F.count_if(F.col("_of") == "outline").alias("n_outline"),
        F.count_if(field).alias("n_fields"),
        F.count_if(F.col("_of") == "tag").alias("n_tags"),
        F.count_if(field & (F.col("form_id") == report_form)).alias("n_report_fields"),
        F.count_if(field & (F.col("form_id") != report_form)).alias("n_item_fields"),
    )
