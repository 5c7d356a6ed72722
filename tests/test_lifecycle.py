import datetime
import json

from pyspark.sql import functions as F

from inspectlake.operators import mapping as M
from inspectlake.plans import lifecycle as L

AT = datetime.datetime(2024, 1, 1)
REQUEST = "req_id long, project_id long, image_path string, prompt string, requested_at timestamp_ntz"
PAGE = REQUEST.replace("project_id long,", "project_id long, doc_id long,")
ENTRY = "entry_id long, image_path string, prompt string, cached_at timestamp_ntz, success boolean, result string"


class Reader:
    """Answers by file name or by the keys in the text."""

    def infer(self, requests):
        return [self.one(path, prompt) for path, prompt in requests]

    def one(self, path, prompt):
        if path.startswith("page"):
            return json.dumps({"owner_name": "Page " + path[4], "property_address": None if path == "page2" else "Street"})
        if path == "array":
            return "[1]"
        if path == "blurred":
            return "sorry"
        if path:
            return "```json\n" + json.dumps({"visible_damage": ["mold"], "overall_condition": path}) + "\n```"
        return json.dumps({"owner_name": "Text " + prompt, "Name": "ignored"})


def test_from_files_to_forms(spark, tmp_path):
    cache = spark.createDataFrame([], ENTRY)
    pages, errors, _ = L.read_pages(
        spark.createDataFrame(
            [(1, 1, 10, "page1", "p", AT), (2, 1, 10, "page2", "p", AT), (3, 2, 20, "page3", "p", AT),
             (4, 2, 30, "page4", "p", AT), (5, 2, 30, "array", "p", AT)], PAGE), cache, Reader, "reader")
    assert {r["doc_id"]: r["error"] for r in errors.collect()} == {30: "'list' object has no attribute 'get'"}
    assert sorted(r["image"] for r in pages.collect()) == ["page1", "page2", "page3"]
    images, writes = L.analyse_images(
        spark.createDataFrame([(1, 1, "fair", "p", AT), (2, 2, "blurred", "p", AT), (3, 2, "[x]", "p", AT)], REQUEST), cache, Reader, "reader")
    assert writes.count() == 2
    texts = L.read_texts(
        spark.createDataFrame([(1, 1, "T", "t")], "doc_id long, project_id long, text string, prompt_name string"),
        spark.createDataFrame([("t", "<{text}>")], "name string, template string"), Reader, "reader")
    out = str(tmp_path / "outputs")
    scanned = texts.withColumn("doc_id", F.col("req_id")).withColumn("path", F.lit("scan.pdf"))
    failed = errors.withColumn("project_id", F.lit(2).cast("bigint"))
    L.write_outputs(out, pages.withColumnRenamed("req_id", "page_no"), failed, scanned, images, order="req_id")
    documents, photos = L.read_outputs(spark, out)
    stored = {r["project_id"]: json.loads(r["payload"]) for r in documents.collect()}
    assert stored[1]["handwritten"]["pages"] == 2 and [p["owner_name"] for p in stored[1]["handwritten"]["fields"]] == ["Page 1", "Page 2"]
    assert stored[1]["scanned"]["fields"][0]["owner_name"] == "Text <T>" and stored[2] == {"handwritten": {"error": "'list' object has no attribute 'get'"}}
    assert [(r["project_id"], r["ordinal"], json.loads(r["payload"])["image_name"]) for r in photos.orderBy("ordinal").collect()] == [(1, 1, "fair"), (2, 2, "blurred"), (2, 3, "[x]")]
    values = L.extracted_values(pages, texts, images)
    got = {(r["project_id"], r["key"]): r["value"] for r in values.collect()}
    assert got[1, "owner_name"] == "Text <T>" and got[1, "address"] is None and got[1, "damage"] == '["mold"]'
    assert got[2, "owner_name"] == "Page 3" and got[2, "building_condition"] == "[x]" and got[2, "address"] == "Street"

    fields = spark.createDataFrame(
        [(1, 1, "f", "Client Name", "-"), (1, 2, "f", "address", "-"), (2, 3, "f", "owner", "-"), (2, 4, "f", "roof", "-")],
        "project_id long, ord long, form_id string, name string, value string")
    events = spark.createDataFrame(
        [(1, 1, "edit", "address", "New St"), (2, 1, "approved", None, None), (3, 2, "rejected", None, None)],
        "seq long, project_id long, action string, field_name string, new_value string")
    summary, plan = L.review_and_fill(fields, values, events, M.alias_table(spark))
    assert {r["project_id"]: r["evidence"] for r in summary.collect()} == {1: "Mapped 2 fields", 2: "Awaiting user approval"}
    assert {r["name"]: r["fill_value"] for r in plan.collect()} == {"Client Name": "Text <T>", "address": "New St"}


class Down:
    def infer(self, requests):
        if any("down" in prompt for _, prompt in requests):
            raise RuntimeError("no connection")
        return ["[1]" if "list" in prompt else "sorry" for _, prompt in requests]


def test_failed_texts_keep_their_error(spark):
    docs = [(1, 1, "down", "t"), (2, 1, "list", "t"), (3, 1, "plain", "t")]
    texts = L.read_texts(
        spark.createDataFrame(docs, "doc_id long, project_id long, text string, prompt_name string"),
        spark.createDataFrame([("t", "{text}")], "name string, template string"), Down, "down", sleep=lambda s: None)
    got = {r["req_id"]: (r["kind"], r["data"]) for r in texts.collect()}
    assert got[1] == (None, {"error": "no connection"})
    assert got[2] == ("array", None)
    assert got[3] == (None, {"raw_response": "sorry", "error": "Failed to parse JSON"})


def test_form_catalog(spark):
    html = """<ul id="outline-navigation-list"><li class="outlineItem"><a>Top</a></li>
    <li class="outlineItem indent-level-2"><a>Deep</a></li></ul><form id="r"><input name="tag_a" value="1"></form>"""
    fields, sections, tags = L.form_catalog(spark.createDataFrame([(5, html)], "page_id long, html string"))
    assert fields.first()["name"] == "tag_a" and tags.count() == 1
    got = [(r["level"], r["path"], r["parent_ord"]) for r in sections.orderBy("ord", "level").collect()]
    assert got == [(0, "Top", None), (1, "Top > ", 1), (2, "Top >  > Deep", 2)]
    pages = spark.createDataFrame([(5,), (6,)], "page_id long")
    tree = L.section_tree(pages, fields.withColumn("form_id", F.lit("item_3")), sections, "r", "item_").collect()
    titles = {(r["page_id"], r["title"], r["parent_id"]) for r in tree}
    assert titles >= {(5, "Top", "root"), (5, "Report Information", "root"), (6, "Report Information", "root"),
                      (5, "Condition Action Items", "root"), (5, "Action Item 3", "items")}
