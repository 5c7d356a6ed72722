from inspectlake.operators import documents as D

TEXT = """Order No: 77-b
Ship To: 4 Mill Lane
Colours: red, green
Carrier: Snail
Carrier: Turtle
Signed By:"""


def test_key_value_contract(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "no keys here\n: no name"), (3, "a: b: c\r\n  k  :  v  ")], "doc_id long, text string")
    rows = D.repeated_keys(D.extract_kv_lines(docs)).collect()
    first = {r["key"]: r["value"] for r in rows if r["doc_id"] == 1}
    assert first == {
        "Order No": "77-b",
        "Ship To": "4 Mill Lane",
        "Colours": "red, green",
        "Carrier": '["Snail","Turtle"]',
        "Signed By": None,
    }
    assert not [r for r in rows if r["doc_id"] == 2]
    assert {r["key"]: r["value"] for r in rows if r["doc_id"] == 3} == {"a": "b: c", "k": "v"}


def test_repeated_empty_values_stay_in_the_list(spark):
    docs = spark.createDataFrame([(1, "K:\nK: x\nK:")], "doc_id long, text string")
    row = D.repeated_keys(D.extract_kv_lines(docs)).first()
    assert row["value"] == '[null,"x",null]'


def test_pages_are_numbered_from_one(spark):
    docs = spark.createDataFrame([(1, "a\fb.*\f"), (2, "")], "doc_id long, text string")
    rows = [tuple(r) for r in D.explode_pages(docs).orderBy("doc_id", "page_no").select("doc_id", "page_no", "pages", "page_name", "page_text").collect()]
    assert rows == [
        (1, 1, 3, "page_1.png", "a"),
        (1, 2, 3, "page_2.png", "b.*"),
        (1, 3, 3, "page_3.png", ""),
        (2, 1, 1, "page_1.png", ""),
    ]


def test_a_document_holds_all_pages_in_order(spark):
    pages = spark.createDataFrame([(1, n, f"e{n}") for n in (3, 1, 7, 2, 5, 4, 6)] + [(2, 1, "x")], "doc_id long, page_no long, evidence string")
    rows = D.collect_doc_fields(pages).orderBy("doc_id").collect()
    assert [[f["page_no"] for f in r["fields"]] for r in rows] == [[1, 2, 3, 4, 5, 6, 7], [1]]
    assert [r["pages"] for r in rows] == [7, 1]
    assert rows[0]["evidence"] == "Processed 7 pages"


def test_project_documents_label_by_type(spark):
    rows = spark.createDataFrame(
        [(1, "scanned", 1, "r1", None), (1, "scanned", 2, None, "boom"), (1, "images", 3, "i", None), (2, "handwritten", 1, "h", None)],
        "project_id long, doc_type string, ordinal long, result string, error string",
    )
    got = {r["project_id"]: r["documents"] for r in D.project_documents(rows).collect()}
    assert got == {1: {"scanned": '{"error":"boom"}'}, 2: {"handwritten": "h"}}


def test_inputs(spark):
    rows = spark.createDataFrame([("a.jpg", "images"), ("", "scanned"), (None, "scanned"), ("b.PNG", "x"), ("c.png", "scanned")], "path string, doc_type string")
    assert D.present_inputs(rows).count() == 3
    assert {r["path"] for r in D.image_paths(rows).collect()} == {"a.jpg", "c.png"}
    routes = {(r["doc_type"], r["route"]) for r in D.route_documents(rows).collect()}
    assert routes == {("images", "page"), ("scanned", "text"), ("x", "page")}
