"""Form fields, labels, options and tags out of HTML pages.

``html_to_nodes`` turns each page into one row per element; everything else is
joins, windows and aggregations per page.  All rows of one ``page_id`` come
from one input row, so a group by page is never larger than one page.
"""

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from inspectlake.functions import text as T
from inspectlake.operators.ordered import dealt

NODES = (
    "page_id bigint, node_id int, end_id int, parent_id int, sib_no int, tag string, "
    "attrs map<string,string>, text string"
)

# Elements without content, elements a start tag closes, and the
# elements whose text later steps ask for.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
CLOSED_BY = {
    "li": {"li"},
    "option": {"option"},
    "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
}
CLOSES_P = set("address article aside div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPES = set("html body table select ul ol dl form div td th".split())
CONTROLS = {"input", "select", "textarea"}
WITH_TEXT = {"label", "option", "textarea", "a", "span", "th", "li"}


class _Page(HTMLParser):
    """Elements of one page in document order, with their text ranges."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open, self.texts = [], [], []
        self.children = {-1: 0}
        self.previous = {}

    def _close(self, depth):
        for node in self.open[depth:]:
            node["end_id"], node["to"] = len(self.nodes) - 1, len(self.texts)
        del self.open[depth:]

    def _close_implied(self, tag):
        closes = CLOSED_BY.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.open[depth]["tag"]
            if name in closes:
                self._close(depth)
            elif name in SCOPES and name not in closes:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "form" and any(n["tag"] == "form" for n in self.open):
            return
        self._close_implied(tag)
        parent = self.open[-1]["node_id"] if self.open else -1
        node_id = len(self.nodes)
        sib_no = self.children.get(parent, 0)
        self.children[parent] = sib_no + 1
        found = {}
        for k, v in attrs:
            found.setdefault(k, "" if v is None else v)
        node = {
            "node_id": node_id, "end_id": node_id, "parent_id": parent, "sib_no": sib_no,
            "tag": tag, "attrs": found, "from": len(self.texts), "to": len(self.texts),
            "wanted": tag in WITH_TEXT or "item-label" in found.get("class", ""),
        }
        if tag in CONTROLS and parent in self.previous:
            self.previous[parent]["wanted"] = True
        self.previous[parent] = node
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth]["tag"] == tag:
                self._close(depth)
                return

    def handle_data(self, data):
        self.texts.append(data)

    def rows(self, html):
        self.feed(html)
        self.close()
        self._close(0)
        for n in self.nodes:
            text = "".join(self.texts[n["from"] : n["to"]]) if n["wanted"] else None
            yield (n["node_id"], n["end_id"], n["parent_id"], n["sib_no"], n["tag"],
                   list(n["attrs"].items()), text)


ARROW_NODES = pa.schema(
    [
        ("page_id", pa.int64()),
        ("node_id", pa.int32()),
        ("end_id", pa.int32()),
        ("parent_id", pa.int32()),
        ("sib_no", pa.int32()),
        ("tag", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())),
        ("text", pa.string()),
    ]
)
NODES_PER_BATCH = 20_000

#: Nodes of a written file.  Nodes compress so well that a file by size would hold millions, which the
#: task that deals them sorts.
NODES_PER_FILE = 50_000


def _batch(rows):
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), ARROW_NODES.types)]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW_NODES)


def _nodes_of(batches):
    rows = []
    for batch in batches:
        for page_id, html in zip(batch["page_id"].to_pylist(), batch["html"].to_pylist()):
            if html is not None:
                rows.extend((page_id, *row) for row in _Page().rows(html))
            if len(rows) >= NODES_PER_BATCH:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)


def html_to_nodes(pages):
    """One row per element of every page, in document order.

    ``end_id`` is the last element inside, so containment is a range.  ``text``
    is there for elements a label or an option can come from.  Steps that use the nodes more
    than once should read them from a written table, so that no page is parsed
    twice.
    """
    return pages.select("page_id", "html").mapInArrow(_nodes_of, NODES)


def by_page(nodes):
    """Written nodes dealt by page, once for every step; a task gets about as many whatever the table."""
    return dealt(nodes, "page_id")


def _attr(name):
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def _page_window():
    return Window.partitionBy("page_id").orderBy("node_id")


def _next(value):
    """The next ``value`` of the page that is not null, after each row.

    Read from the end of the page: a frame that grows is kept up, one that shrinks would be
    made anew for every row.
    """
    back = Window.partitionBy("page_id").orderBy(F.desc("node_id"))
    return F.last(value, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))


def _kind():
    return F.lower(_attr("type"))


def _is_choice():
    return (F.col("tag") == "input") & _kind().isin("radio", "checkbox")


def _value():
    """The value an element reports: its text, its attribute, or ``on``."""
    given = F.try_element_at("attrs", F.lit("value"))
    return (
        F.when(F.col("tag") == "textarea", F.regexp_replace(F.coalesce("text", F.lit("")), r"\A\r?\n", ""))
        .when(_is_choice(), F.coalesce(given, F.lit("on")))
        .otherwise(F.coalesce(given, F.lit("")))
    )


def form_nodes(nodes):
    """The nodes any label, option or choice rule can look at.

    Most elements of a page are none of them; they are left out before the
    nodes are shuffled.
    """
    known = F.col("tag").isin("form", "label", *sorted(CONTROLS))
    return nodes.filter(known | F.col("text").isNotNull())


def with_forms(nodes):
    """Add ``is_control``, ``form_id``, ``name`` and ``value`` to the nodes.

    Forms do not nest, so the form of a node is the last one that started
    before it, unless that one has ended.

    This and the next steps are windows inside one page.  They add columns and
    leave the rows where they are, so one shuffle on ``page_id`` serves all.
    """
    started = F.when(F.col("tag") == "form", F.struct("end_id", _attr("id").alias("id")))
    form = F.last(started, ignorenulls=True).over(
        _page_window().rowsBetween(Window.unboundedPreceding, 0)
    )
    is_control = F.col("tag").isin("select", "textarea") | (
        (F.col("tag") == "input") & ~_kind().isin("hidden", "submit", "button")
    )
    inside = F.coalesce(F.col("_form.end_id") >= F.col("node_id"), F.lit(False))
    return (
        nodes.withColumn("_form", form)
        .withColumn("is_control", is_control & inside)
        .withColumn("form_id", F.when(inside, F.col("_form.id")))
        .withColumn("name", _attr("name"))
        .withColumn("value", _value())
        .drop("_form")
    )


def input_controls(nodes):
    """The visible controls inside a form, with form, name and value."""
    return with_forms(form_nodes(nodes)).filter("is_control").drop("is_control")


def _trimmed():
    return T.page_trim(F.coalesce("text", F.lit("")))


def with_label_for(rows):
    """Add ``l_for``: text of the first label that names the element's id."""
    is_label = F.col("tag") == "label"
    key = F.nullif(F.when(is_label, _attr("for")).otherwise(_attr("id")), F.lit(""))
    first = F.min_by(_trimmed(), F.when(is_label, F.col("node_id"))).over(
        Window.partitionBy("page_id", "_key")
    )
    keyed = rows.withColumn("_key", key)
    return keyed.withColumn("l_for", F.when(F.col("_key").isNotNull(), first)).drop("_key")


def _siblings():
    return Window.partitionBy("page_id", "parent_id").orderBy("sib_no")


def with_prev_sibling(rows, tags=("label", "span", "div", "th")):
    """Add ``l_prev``: text of the element just before, of a labelling kind.

    The element before a control always has its text, so it is among
    ``form_nodes``; the sibling number tells it from one further away.
    """
    text = F.when(F.col("tag").isin(*tags), _trimmed())
    before = F.lag(F.struct(F.col("sib_no").alias("at"), text.alias("text"))).over(_siblings())
    rows = rows.withColumn("_b", before)
    adjacent = F.col("_b.at") == F.col("sib_no") - 1
    return rows.withColumn("l_prev", F.when(adjacent, F.col("_b.text"))).drop("_b")


def with_parent_label(rows):
    """Add ``l_parent``: text of the label the element is directly in."""
    is_label = F.col("tag") == "label"
    key = F.when(is_label, F.col("node_id")).otherwise(F.col("parent_id"))
    text = F.max(F.when(is_label, _trimmed())).over(Window.partitionBy("page_id", "_key"))
    return rows.withColumn("_key", key).withColumn("l_parent", text).drop("_key")


def _has_class(*names):
    tokens = F.split(_attr("class"), r"[ \t\n\f\r]+")
    return F.arrays_overlap(tokens, F.array(*[F.lit(n) for n in names]))


def field_boxes(nodes, classes=("field", "form-group")):
    """``(page_id, node_id, end_id, text)``: containers and the first label inside each.

    The first label inside a container is the next label of the page after the
    container's start; it counts when it starts before the container ends.
    """
    is_label = F.col("tag") == "label"
    is_box = _has_class(*classes)
    next_label = _next(F.when(is_label, F.struct("node_id", _trimmed().alias("text"))))
    inside = F.col("_label.node_id") <= F.col("end_id")
    return (
        nodes.filter(is_label | is_box)
        .withColumn("_label", next_label)
        .filter(is_box)
        .select("page_id", "node_id", "end_id", F.when(inside, F.col("_label.text")).alias("text"))
    )


def with_innermost(rows, boxes, value, to):
    """Add ``to``: ``value`` of the innermost of ``boxes`` around each row; a box is in itself.

    Boxes nest, so their starts and ends, counted up along a page, give the depth at every
    row, and the box around a row is the last one that started at that depth.  Two windows
    over the rows and boxes of a page, whatever the number or depth of boxes; rows outside
    of all boxes get null.
    """
    start, ask, end = 0, 1, 2

    def event(at, kind, delta):
        return [at.alias("_at"), F.lit(kind).alias("_event"), F.lit(delta).alias("_delta")]

    edges = F.explode(F.array(F.struct(*event(F.col("node_id"), start, 1)), F.struct(*event(F.col("end_id"), end, -1))))
    edged = boxes.select("page_id", F.struct(value.alias("value")).alias("_box"), edges.alias("_e")).select("page_id", "_e.*", "_box")
    asked = rows.select("*", *event(F.col("node_id"), ask, 0))
    events = asked.unionByName(edged, allowMissingColumns=True)

    def so_far(*keys):
        return Window.partitionBy("page_id", *keys).orderBy("_at", "_event").rowsBetween(Window.unboundedPreceding, 0)

    deep = events.withColumn("_depth", F.sum("_delta").over(so_far())).filter(F.col("_event") != end)
    found = deep.withColumn("_box", F.last("_box", ignorenulls=True).over(so_far("_depth")))
    return found.filter(F.col("_event") == ask).select(*rows.columns, F.col("_box.value").alias(to))


def with_closest_label(rows, boxes):
    """Add ``l_closest``: the label of the nearest container around a control."""
    return with_innermost(rows, boxes, F.col("text"), "l_closest")


def _labels(rows, column):
    found = rows.filter(F.col("is_control") & F.col(column).isNotNull())
    return found.select("page_id", "node_id", "name", F.col(column).alias("label"))


def label_for(nodes):
    return _labels(with_label_for(with_forms(form_nodes(nodes))), "l_for")


def label_prev_sibling(nodes):
    return _labels(with_prev_sibling(with_forms(form_nodes(nodes))), "l_prev")


def label_parent(nodes):
    return _labels(with_parent_label(with_forms(form_nodes(nodes))), "l_parent")


def label_closest(nodes):
    controls = input_controls(nodes).select("page_id", "node_id", "name")
    found = with_closest_label(controls, field_boxes(nodes)).filter("l_closest is not null")
    return found.select("page_id", "node_id", "name", F.col("l_closest").alias("label"))


def _text_of(*columns):
    return [F.nullif(c, F.lit("")) for c in columns]


def resolve_label(nodes):
    """The label of every control: the first rule that gives a text wins."""
    rows = with_label_for(with_forms(form_nodes(nodes)))
    rows = with_parent_label(with_prev_sibling(rows)).filter("is_control")
    near = F.coalesce(*_text_of(F.col("l_for"), F.col("l_prev"), F.col("l_parent")))
    far = F.coalesce(*_text_of(_attr("aria-label"), _attr("name"), _attr("placeholder")), F.lit(""))
    rows = rows.select(
        "page_id", "node_id", "tag", "form_id", "name", "value", near.alias("_near"), far.alias("_far")
    )
    rows = with_closest_label(rows, field_boxes(nodes))
    label = F.coalesce("_near", *_text_of(F.col("l_closest")), "_far")
    return rows.withColumn("label", label).drop("_near", "_far", "l_closest")


def _ordered(struct, order):
    return F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), struct.alias("_v")))),
        lambda x: x["_v"],
    )


def select_options(nodes):
    """Shown option texts of every select in order, and its reported value.

    Empty texts are dropped.  The value is that of the chosen option, else of
    the first one that can be chosen.
    """
    started = F.when(F.col("tag") == "select", F.struct("node_id", "end_id"))
    last_select = F.last(started, ignorenulls=True).over(
        _page_window().rowsBetween(Window.unboundedPreceding, 0)
    )
    shown = T.clean_title(F.coalesce("text", F.lit("")))
    is_select = F.col("tag") == "select"
    rows = (
        nodes.filter(F.col("tag").isin("select", "option"))
        .withColumn("_of", last_select)
        .filter(F.col("_of.end_id") >= F.col("node_id"))
        .select(
            "page_id",
            F.col("_of.node_id").alias("select_id"),
            "node_id",
            is_select.alias("_is_select"),
            F.when(is_select, _attr("name")).alias("name"),
            F.when(is_select, F.map_contains_key("attrs", "multiple")).alias("_many"),
            F.when(~is_select & (shown != ""), shown).alias("text"),
            F.coalesce(F.try_element_at("attrs", F.lit("value")), shown).alias("value"),
            F.map_contains_key("attrs", "selected").alias("selected"),
            F.map_contains_key("attrs", "disabled").alias("disabled"),
        )
    )
    chosen = F.when(~F.col("_is_select") & F.col("selected"), F.col("node_id"))
    open_ = F.when(~F.col("_is_select") & ~F.col("disabled"), F.col("node_id"))
    listed = rows.groupBy("page_id", "select_id").agg(
        F.max("name").alias("name"),
        F.bool_or("_many").alias("_many"),
        F.filter(_ordered(F.col("text"), "node_id"), lambda t: t.isNotNull()).alias("options"),
        F.max_by("value", chosen).alias("_last_chosen"),
        F.min_by("value", chosen).alias("_first_chosen"),
        F.min_by("value", open_).alias("_first"),
    )
    value = F.when(F.col("_many"), F.col("_first_chosen")).otherwise(F.coalesce("_last_chosen", "_first"))
    return listed.select(
        "page_id",
        F.col("select_id").alias("node_id"),
        "name",
        "options",
        F.coalesce(value, F.lit("")).alias("selected_value"),
    )


def with_option_label(rows):
    """Add ``option_label``: an input's own label, the next label, its value.

    ``rows`` have ``l_for``.
    """
    text = F.when(F.col("tag") == "label", _trimmed())
    after = F.lead(F.struct(F.col("sib_no").alias("at"), text.alias("text"))).over(_siblings())
    rows = rows.withColumn("_a", after)
    following = F.when(F.col("_a.at") == F.col("sib_no") + 1, F.col("_a.text"))
    return rows.withColumn(
        "option_label", F.coalesce(*_text_of(F.col("l_for"), following), F.col("value"))
    ).drop("_a")


def next_sibling_label(nodes):
    """Option label of every named input."""
    rows = with_option_label(with_label_for(with_forms(form_nodes(nodes))))
    return rows.filter("tag = 'input' and name <> ''").select(
        "page_id",
        "node_id",
        "name",
        _kind().alias("kind"),
        "value",
        F.map_contains_key("attrs", "checked").alias("checked"),
        "option_label",
    )


def choice_options(nodes):
    """Radio and check-box fields with ``radio_options`` or ``checked``.

    Inputs of one name on a page form a group.  The first of a group of
    several carries the list when it is a choice itself; a single one and one
    without a name carry ``checked``; the others carry neither.  Only the first
    of a group ever holds its list, so a group takes the room of its members.
    """
    rows = with_option_label(with_label_for(with_forms(form_nodes(nodes)))).filter("tag = 'input'")
    checked = F.map_contains_key("attrs", "checked")
    option = F.struct(F.col("option_label").alias("label"), F.col("value"), checked.alias("selected"))
    member = F.struct("node_id", (F.col("is_control") & _is_choice()).alias("is_choice"), option.alias("option"))
    # An input without a name is a group of its own.
    alone = F.when(F.col("name") == "", F.col("node_id"))
    groups = rows.groupBy("page_id", "name", alone.alias("_alone")).agg(F.array_sort(F.collect_list(member)).alias("_all"))
    several = F.size("_all") > 1
    options = F.transform("_all", lambda m: m["option"])

    def shown(m, place):
        return F.struct(
            m["node_id"].alias("node_id"),
            m["is_choice"].alias("is_choice"),
            F.when(several & (place == 0), options).alias("radio_options"),
            F.when(~several, m["option"]["selected"]).alias("checked"),
        )

    members = groups.select("page_id", "name", F.explode(F.transform("_all", shown)).alias("_m"))
    return members.filter("_m.is_choice").select("page_id", "_m.node_id", "name", "_m.radio_options", "_m.checked")


def _with(rows, *more):
    """``rows`` with the columns of ``more``; all have at most one row per node.

    A union and one aggregation keep rows dealt by page where they are; a join by page and
    node would deal them again.
    """
    key = ["page_id", "node_id"]
    every = rows.withColumn("_asked", F.lit(True))
    for other in more:
        every = every.unionByName(other, allowMissingColumns=True)
    whole = every.groupBy(*key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in every.columns if c not in key])
    return whole.filter("_asked").drop("_asked")


def form_fields(nodes):
    """Every field of every form with label, value, options and choices."""
    options = select_options(nodes).select("page_id", "node_id", "options", "selected_value")
    choices = choice_options(nodes).drop("name")
    return (
        _with(resolve_label(nodes), options, choices)
        .select(
            "page_id",
            F.col("node_id").cast("bigint").alias("ord"),
            "label",
            F.col("tag").alias("type"),
            "name",
            F.coalesce("selected_value", "value").alias("value"),
            "form_id",
            "options",
            "radio_options",
            "checked",
        )
    )


def tag_fields(nodes):
    """Inputs and selects that class, id or name mark as a tag.

    A tagging container adds the inputs in it whose name says ``tag``.  The
    page element contains all of those and comes first, so they precede inputs
    marked in another way; the first of each name and value is kept.
    """
    is_input = F.col("tag").isin("input", "select")
    by_name = F.contains(_attr("name"), F.lit("tag"))
    marked = by_name
    for a in ("class", "id", "name"):
        marked = marked | F.contains(F.lower(_attr(a)), F.lit("tag"))
    options = select_options(nodes).select("page_id", "node_id", "options", "selected_value")
    rows = with_prev_sibling(with_label_for(form_nodes(nodes)), ("label", "span", "div"))
    texts = _text_of(F.col("l_for"), F.col("l_prev"), *[_attr(a) for a in ("name", "placeholder", "data-label")])
    tags = rows.filter(is_input & marked).select(
        "page_id",
        "node_id",
        F.coalesce(*texts, F.lit("")).alias("label"),
        F.col("tag").alias("type"),
        _attr("name").alias("name"),
        _value().alias("_own_value"),
        (~by_name).alias("_late"),
    )
    rows = _with(tags, options).withColumn("value", F.coalesce("selected_value", "_own_value"))
    kept = F.min_by(F.struct("node_id", "label", "type", "options"), F.struct("_late", "node_id"))
    return rows.groupBy("page_id", "name", "value").agg(kept.alias("_t")).select(
        "page_id", "name", "value", "_t.*"
    )


def outline_entries(nodes, list_id="outline-navigation-list"):
    """Outline entries of a page: class text and raw title, in order.

    The title is the text of the first link, span or label element inside an
    entry, or of the entry itself.
    """
    is_item = (F.col("tag") == "li") & _has_class("outlineItem")
    holds = F.col("tag").isin("a", "span") | _has_class("outline-item-label", "item-label")
    # What is in a list begins after it.
    lists = nodes.filter((_attr("id") == list_id) & (F.col("end_id") > F.col("node_id"))).select("page_id", (F.col("node_id") + 1).alias("node_id"), "end_id")
    next_text = _next(F.when(holds, F.struct("node_id", "text")))
    items = nodes.filter(is_item | holds).withColumn("_t", next_text).filter(is_item)
    inside = with_innermost(items, lists, F.lit(True), "_listed").filter("_listed")
    has_text = F.col("_t.node_id") <= F.col("end_id")
    return inside.select(
        "page_id",
        F.row_number().over(_page_window()).alias("ord"),
        F.when(has_text, F.coalesce("_t.text", F.lit(""))).otherwise(F.coalesce("text", F.lit(""))).alias("raw_title"),
        _attr("class").alias("cls"),
    )
