"""Queries over scraped HTML forms.

Every page is made from one row of ``part`` by one of four templates, so the
right answer is a selection from that table.
"""

from pyspark.sql import functions as F

from inspectlake.fixtures import fixture
from inspectlake.operators import forms as H
from inspectlake.plans.common import all_cores
from inspectlake.session import saved


def _nodes(spark, sf_dir):
    return H.html_to_nodes(all_cores(fixture(spark, sf_dir, "fx_form_html"), "page_id"))


def stored_nodes(spark, sf_dir):
    return H.by_page(saved(_nodes(spark, sf_dir), "nodes", H.NODES_PER_FILE))


def html_to_nodes(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return nodes.select(
        "page_id",
        F.col("node_id").cast("bigint").alias("node_id"),
        "tag",
        F.try_element_at("attrs", F.lit("name")).alias("name"),
        F.when(F.col("tag") == "label", F.col("text")).alias("label_text"),
    )


def input_controls(spark, sf_dir):
    return H.input_controls(stored_nodes(spark, sf_dir)).select("page_id", "form_id", "tag", "name", "value")


def label_for(spark, sf_dir):
    return H.label_for(stored_nodes(spark, sf_dir)).drop("node_id")


def label_prev_sibling(spark, sf_dir):
    return H.label_prev_sibling(stored_nodes(spark, sf_dir)).drop("node_id")


def label_parent(spark, sf_dir):
    return H.label_parent(stored_nodes(spark, sf_dir)).drop("node_id")


def label_closest(spark, sf_dir):
    return H.label_closest(stored_nodes(spark, sf_dir)).drop("node_id")


def resolve_label(spark, sf_dir):
    nodes = stored_nodes(spark, sf_dir)
    return H.resolve_label(nodes).select("page_id", "name", "label")


def select_options(spark, sf_dir):
    return H.select_options(stored_nodes(spark, sf_dir)).select(
        "page_id", "name", F.array_join("options", "|").alias("options"), "selected_value"
    )


def next_sibling_label(spark, sf_dir):
    rows = H.next_sibling_label(stored_nodes(spark, sf_dir))
    return rows.select("page_id", "name", "value", "option_label", "checked")


def _choices(col):
    return F.array_join(
        F.transform(
            col, lambda o: F.concat_ws("=", o["label"], o["value"], o["selected"].cast("string"))
        ),
        "|",
    )


def choice_options(spark, sf_dir):
    return H.choice_options(stored_nodes(spark, sf_dir)).select(
        "page_id", "name", _choices(F.col("radio_options")).alias("radio_options"), "checked"
    )


def tag_fields(spark, sf_dir):
    return H.tag_fields(stored_nodes(spark, sf_dir)).select(
        "page_id", "name", "value", "label", "type", F.array_join("options", "|").alias("options")
    )


def form_fields(spark, sf_dir):
    return H.form_fields(stored_nodes(spark, sf_dir)).select(
        "page_id", "form_id", "name", "label", "type", "value",
        F.array_join("options", "|").alias("options"),
        _choices(F.col("radio_options")).alias("radio_options"),
    )


QUERIES = {
    "html_to_nodes": html_to_nodes,
    "input_controls": input_controls,
    "label_for": label_for,
    "label_prev_sibling": label_prev_sibling,
    "label_parent": label_parent,
    "label_closest": label_closest,
    "resolve_label": resolve_label,
    "select_options": select_options,
    "next_sibling_label": next_sibling_label,
    "choice_options": choice_options,
    "tag_fields": tag_fields,
    "form_fields": form_fields,
}


def _per_part(*rows):
    """One SELECT over ``part`` per (template, name -> expression)."""
    texts = []
    for template, row in rows:
        columns = ", ".join(f"{expr} as {name}" for name, expr in row.items())
        texts.append(f"select p_partkey as page_id, {columns} from part where p_partkey % 4 = {template}")
    return " union all ".join(texts)


def _field(name, label, kind="'input'", value="''", options="null", radio="null", form="'edit_report_1'", own=None):
    """A control as a form field; ``own`` is the value of the element alone where the field reports another."""
    return {
        "form_id": form, "name": name, "label": label, "type": kind, "value": value,
        "options": f"cast({options} as varchar)", "radio_options": f"cast({radio} as varchar)", "own": own or value,
    }


RADIO = "'One=1=true|Two=2=false'"
BOXES = "'Alpha=a=false|Beta=b=true'"
I7, I9, I3 = ({"form": f"'item_{n}'"} for n in (7, 9, 3))
FIELDS = [
    (0, _field("'owner'", "trim(p_name)", value="p_brand")),
    (0, _field("'property_address'", "'Addr'")),
    (0, _field("'roof'", "'Wrapped'")),
    (0, _field("'issues'", "'Deep'", "'textarea'", "'t'")),
    (0, _field("'z'", "'Deept'")),
    (0, _field("'only_name'", "'only_name'")),
    (0, _field("'tag_kind'", "'tag_kind'", "'select'", "'A'", "'A|' || trim(p_type)", own="''")),
    (0, _field("'r'", "'One'", value="'1'", radio=RADIO)),
    (0, _field("'r'", "'One'", value="'2'")),
    (1, _field("'agree'", "trim(p_name)", value="'yes'", **I7)),
    (1, _field("''", "'Group'", value="'on'", **I7)),
    (1, _field("'many'", "'Group ' || trim(p_name)", value="'a'", radio=BOXES, **I7)),
    (1, _field("'many'", "'Alpha'", value="'b'", **I7)),
    (1, _field("'plain'", "'Beta'", value="p_brand", **I7)),
    (2, _field("'kind'", "'kind'", "'select'", "'y'", "'X|' || trim(p_type)", own="''")),
    (2, _field("'n'", "'n'", value="p_brand")),
    (2, _field("'t1'", "'Head'", value="'v1'", **I9)),
    (2, _field("'t2'", "'t2'", value="'v2'", **I9)),
    (2, _field("'solo'", "'Near'", value="'1'", **I9)),
    (3, _field("'cond'", "'Cond'", "'textarea'", "p_type", **I3)),
]
# Elements of each page in document order: tag, name, label text.
ELEMENTS = [
    [
        ("html", None, None), ("body", None, None), ("form", None, None), ("label", None, "' ' || p_name || ' '"),
        ("input", "owner", None), ("input", "h", None), ("span", None, None), ("input", "property_address", None),
        ("label", None, "'Wrapped '"), ("input", "roof", None), ("div", None, None), ("label", None, "'Deep'"),
        ("p", None, None), ("textarea", "issues", None), ("input", "z", None), ("input", "only_name", None),
        ("select", "tag_kind", None), ("option", None, None), ("option", None, None), ("option", None, None),
        ("input", "r", None), ("label", None, "'One'"), ("input", "r", None), ("label", None, "'Two'"),
    ],
    [
        ("html", None, None), ("body", None, None), ("form", None, None), ("div", None, None), ("label", None, "'Group'"), ("div", None, None),
        ("label", None, "' ' || p_name || ' '"), ("p", None, None), ("input", "agree", None), ("p", None, None), ("input", None, None),
        ("input", "many", None), ("label", None, "'Alpha'"), ("input", "many", None), ("label", None, "'Beta'"), ("input", "plain", None),
    ],
    [
        ("html", None, None), ("body", None, None), ("form", None, None), ("select", "kind", None), ("option", None, None), ("option", None, None),
        ("input", "n", None), ("form", None, None), ("div", None, None), ("input", "t1", None), ("input", "t2", None), ("span", None, None), ("input", "solo", None),
    ],
    [
        ("html", None, None), ("body", None, None), ("ul", None, None), ("li", None, None), ("a", None, None), ("li", None, None), ("span", None, None),
        ("li", None, None), ("form", None, None), ("label", None, "'Cond'"), ("textarea", "cond", None),
    ],
]


def _labelled(*rows):
    return _per_part(*[(t, {"name": f"'{n}'", "label": label}) for t, n, label in rows])


def _only(columns, rows=None):
    return _per_part(*[(t, {c: f[c] for c in columns}) for t, f in rows or FIELDS])


def _options(*rows):
    """Name, value, option label and whether it is checked, of named inputs."""
    return _per_part(*[(t, {"name": f"'{n}'", "value": v, "option_label": label, "checked": c}) for t, n, v, label, c in rows])


def _chosen(*rows):
    return _per_part(*[(t, {"name": f"'{n}'", "radio_options": f"cast({r} as varchar)", "checked": f"cast({c} as boolean)"}) for t, n, r, c in rows])


def _tagged(t, name, value, label, kind, options):
    return t, {"name": name, "value": value, "label": label, "type": kind, "options": f"cast({options} as varchar)"}


ORACLES = {
    "html_to_nodes": _per_part(
        *[
            (
                t,
                {
                    "node_id": f"cast({i} as bigint)",
                    "tag": f"'{tag}'",
                    "name": f"'{name}'" if name else "cast(null as varchar)",
                    "label_text": text or "cast(null as varchar)",
                },
            )
            for t, elements in enumerate(ELEMENTS)
            for i, (tag, name, text) in enumerate(elements)
        ]
    ),
    "input_controls": _per_part(*[(t, {"form_id": f["form_id"], "tag": f["type"], "name": f["name"], "value": f["own"]}) for t, f in FIELDS]),
    "label_for": _labelled((0, "owner", "trim(p_name)"), (0, "r", "'One'"), (3, "cond", "'Cond'")),
    "label_prev_sibling": _labelled(
        (0, "owner", "trim(p_name)"), (0, "property_address", "'Addr'"), (0, "z", "'Deept'"), (0, "r", "'One'"),
        (1, "many", "'Group ' || trim(p_name)"), (1, "many", "'Alpha'"), (1, "plain", "'Beta'"), (2, "t1", "'Head'"), (2, "solo", "'Near'"), (3, "cond", "'Cond'"),
    ),
    "label_parent": _labelled((0, "roof", "'Wrapped'")),
    "label_closest": _labelled((0, "issues", "'Deep'"), (1, "agree", "trim(p_name)"), (1, "", "'Group'")),
    "resolve_label": _only(("name", "label")),
    "select_options": _per_part(
        (0, {"name": "'tag_kind'", "options": "'A|' || trim(p_type)", "selected_value": "'A'"}),
        (2, {"name": "'kind'", "options": "'X|' || trim(p_type)", "selected_value": "'y'"}),
    ),
    "next_sibling_label": _options(
        (0, "owner", "p_brand", "trim(p_name)", "false"), (0, "h", "'x'", "'x'", "false"), (0, "property_address", "''", "'Wrapped'", "false"),
        (0, "roof", "''", "''", "false"), (0, "z", "''", "''", "false"), (0, "only_name", "''", "''", "false"),
        (0, "r", "'1'", "'One'", "true"), (0, "r", "'2'", "'Two'", "false"),
        (1, "agree", "'yes'", "'yes'", "true"), (1, "many", "'a'", "'Alpha'", "false"), (1, "many", "'b'", "'Beta'", "true"), (1, "plain", "p_brand", "p_brand", "false"),
        (2, "n", "p_brand", "p_brand", "false"), (2, "t1", "'v1'", "'v1'", "false"), (2, "t2", "'v2'", "'v2'", "false"), (2, "solo", "'1'", "'1'", "true"),
    ),
    "choice_options": _chosen(
        (0, "r", RADIO, "null"), (0, "r", "null", "null"), (1, "agree", "null", "true"), (1, "", "null", "false"), (1, "many", BOXES, "null"), (1, "many", "null", "null"),
        (2, "solo", "null", "true"),
    ),
    "tag_fields": _per_part(
        _tagged(0, "'tag_kind'", "'A'", "'tag_kind'", "'select'", "'A|' || trim(p_type)"),
        _tagged(2, "'t1'", "'v1'", "'Head'", "'input'", "null"),
        _tagged(2, "'t2'", "'v2'", "'t2'", "'input'", "null"),
    ),
    "form_fields": _only(("form_id", "name", "label", "type", "value", "options", "radio_options")),
}
