import time

from pyspark.sql import functions as F

from inspectlake.operators import forms as H

PAGE = """<!DOCTYPE html><html><body class="page">
<ul id="outline-navigation-list">
 <li class="outlineItem indent-level-0"><a>  First
  title </a><span>no</span>
 <li class="outlineItem indent-level-1 report_section">Bare <b>text</b></li>
 <li class="other"><a>Not this</a></li>
</ul>
<li class="outlineItem">outside</li>
<input name="loose">
<form id="one">
 <label for="a"></label><label for="a">second</label>
 <div>Above</div><input id="a" name="empty_label">
 <p><label>Para <input type="TEXT" name="wrapped">
 <div class="form-group"><p>x</p><label> Boxed </label><div><div class="field"><input name="inner"></div></div></div>
 <br><input name="ph" placeholder="Hold" aria-label="Aria &amp; co">
 <br><input placeholder="only">
 <br><input>
 <input type="submit" value="Go"><input type="Hidden" name="h">
 <textarea name="ta">
keep</textarea>
 <select name="s"><optgroup><option value="1">One <option value="2" selected> Two  x </optgroup><option></select>
 <select name="m" multiple><option>A</select>
 <input type="checkbox" name="c1" checked><label>Check</label>
 <input type="checkbox">
 <input type="radio" name="r" value="x"><input type="hidden" name="r"><input type="radio" name="r" checked><label>Yes</label>
</form>
<form id="two"><input type="text" name="Tag_Upper" value="v"><input class="my-tag" name="n1" value="v"><input name="tags[]" value="v">
<input name="tags[]" value="v" placeholder="dup"><input name="tags[]" value="w"></form>
</body></html>"""


def nodes(spark):
    return H.html_to_nodes(spark.createDataFrame([(1, PAGE), (2, "<p>no form"), (3, None), (4, "")], "page_id long, html string"))


def test_form_fields(spark):
    rows = H.form_fields(nodes(spark)).orderBy("ord").collect()
    got = [(r["form_id"], r["name"], r["label"], r["type"], r["value"]) for r in rows]
    assert got == [
        ("one", "empty_label", "Above", "input", ""),
        ("one", "wrapped", "Para", "input", ""),
        ("one", "inner", "inner", "input", ""),
        ("one", "ph", "Aria & co", "input", ""),
        ("one", "", "only", "input", ""),
        ("one", "", "", "input", ""),
        ("one", "ta", "ta", "textarea", "keep"),
        ("one", "s", "s", "select", "2"),
        ("one", "m", "m", "select", ""),
        ("one", "c1", "c1", "input", "on"),
        ("one", "", "Check", "input", "on"),
        ("one", "r", "r", "input", "x"),
        ("one", "r", "r", "input", "on"),
        ("two", "Tag_Upper", "Tag_Upper", "input", "v"),
        ("two", "n1", "n1", "input", "v"),
        ("two", "tags[]", "tags[]", "input", "v"),
        ("two", "tags[]", "tags[]", "input", "v"),
        ("two", "tags[]", "tags[]", "input", "w"),
    ]
    by_name = {(r["name"], r["value"]): r for r in rows}
    assert by_name["s", "2"]["options"] == ["One", "Two x"]
    assert by_name["c1", "on"]["checked"] is True and by_name["c1", "on"]["radio_options"] is None
    first, second = by_name["r", "x"], by_name["r", "on"]
    assert [tuple(o) for o in first["radio_options"]] == [("x", "x", False), ("", "", False), ("Yes", "on", True)]
    assert second["radio_options"] is None and first["checked"] is None and second["checked"] is None


def test_tags_first_wins(spark):
    rows = H.tag_fields(nodes(spark)).collect()
    assert {(r["name"], r["value"]) for r in rows} == {("Tag_Upper", "v"), ("n1", "v"), ("tags[]", "v"), ("tags[]", "w")}


def test_outline(spark):
    rows = H.outline_entries(nodes(spark)).orderBy("ord").collect()
    assert [(r["ord"], " ".join(r["raw_title"].split()), r["cls"]) for r in rows] == [
        (1, "First title", "outlineItem indent-level-0"),
        (2, "Bare text", "outlineItem indent-level-1 report_section"),
    ]


def test_closest_looks_at_the_nearest_container(spark):
    html = '<form><div class="field"><label>Outer</label><p><b><input name="a"></b></p></div><div class="form-group x"><i></i><input name="b"></div></form>'
    rows = H.resolve_label(H.html_to_nodes(spark.createDataFrame([(1, html)], "page_id long, html string")))
    assert {r["name"]: r["label"] for r in rows.collect()} == {"a": "Outer", "b": "b"}


def page_of(spark, html):
    return H.html_to_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))


def test_very_many_nested_containers_and_controls(spark):
    """5,000 containers in each other, with a control in each, and as many that stand alone."""
    n = 5000
    nested = "".join(f'<div class="field"><label>L{k}</label><b><input name="a{k}"></b>' for k in range(n)) + "</div>" * n
    apart = "".join(f'<div class="form-group"><label>M{k}</label><b><input name="b{k}"></b></div>' for k in range(n))
    started = time.time()
    got = {r["name"]: r["label"] for r in H.label_closest(page_of(spark, f"<form>{nested}{apart}<input name=out></form>")).collect()}
    assert time.time() - started < 30
    assert got == {f"a{k}": f"L{k}" for k in range(n)} | {f"b{k}": f"M{k}" for k in range(n)}


def test_innermost_box_equals_a_stack(spark):
    import random

    rng = random.Random(3)
    html, depth = "<form>", 0
    for k in range(300):
        if rng.random() < 0.35:
            html += f'<div class="{rng.choice(["field", "other", "form-group", "x"])}">' + (f"<label>l{k}</label>" if rng.random() < 0.6 else "")
            depth += 1
        elif depth and rng.random() < 0.4:
            html, depth = html + "</div>", depth - 1
        else:
            html += f'<input name="n{k}" class="{rng.choice(["", "field"])}">'
    nodes = page_of(spark, html).collect()
    boxes = [r for r in nodes if {"field", "form-group"} & set((r.attrs.get("class") or "").split())]
    labels = [r for r in nodes if r.tag == "label"]
    want = {}
    for r in nodes:
        around = [b for b in boxes if b.node_id <= r.node_id <= b.end_id]
        if r.tag == "input" and around:
            box = max(around, key=lambda b: b.node_id)
            text = next((x.text for x in labels if box.node_id < x.node_id <= box.end_id), None)
            if text is not None:
                want[r.attrs["name"]] = text
    assert {r["name"]: r["label"] for r in H.label_closest(page_of(spark, html)).collect()} == want


def test_very_many_inputs_without_a_name(spark):
    n = 20_000
    html = "<form>" + '<input type="checkbox" checked>' * n + "".join(f'<input type="radio" name="r" value="{k}">' for k in range(n)) + "</form>"
    started = time.time()
    rows = H.choice_options(page_of(spark, html)).select("name", F.size("radio_options").alias("n"), "checked")
    got = [tuple(r) for r in rows.groupBy("name", "n", "checked").count().collect()]
    assert time.time() - started < 60
    assert sorted(got, key=str) == sorted([("", None, True, n), ("r", n, None, 1), ("r", None, None, n - 1)], key=str)
