import json

from pyspark.sql import functions as F

from inspectlake.fixtures import fixture
from inspectlake.functions.envelope import parse_envelope, parse_llm_response
from inspectlake.operators import images as I
from inspectlake.operators import records as R
from inspectlake.operators.merge import image_pairs, last_wins_merge, rename_keys
from inspectlake.plans.responses import QUERIES

CASES = [
    '{"room": "pantry", "view": "wide", "confidence": 0.7}',
    "no answer for this picture",
    '{"a":1,"a":2}',
    '{"a":NaN}',
    '{"a":1} and {"b":2}',
    "{'a':1}",
    '{"a":1,}',
    '{"a":"x\ty"}',
    "[1]",
    "12",
    "null",
    '"text"',
    "true",
    "1.5",
    "",
    '{"s": "\\ud800", "l": [1, "b"], "n": null, "t": true}',
]


def envelopes(spark, texts):
    rows = [(i, f"img{i}", t) for i, t in enumerate(texts)]
    return parse_envelope(spark.createDataFrame(rows, "id long, image_name string, raw_response string"))


def test_strict_parsing_matches_python(spark):
    for row in envelopes(spark, CASES).collect():
        text = CASES[row["id"]]
        start, end = text.find("{"), text.rfind("}")
        try:
            value = json.loads(text[start : end + 1] if 0 <= start < end else text.strip())
        except ValueError as e:
            assert not row["success"] and row["error"] == f"JSON parsing failed: {e}"
            continue
        assert row["success"] and row["error"] is None
        assert (row["kind"] == "object") == isinstance(value, dict)
        if isinstance(value, dict):
            assert set(row["data"]) == set(value)
    last = envelopes(spark, CASES).filter("id = 15").first()["data"]
    assert last == {"s": "?", "l": '[1,"b"]', "n": None, "t": "true"}
    assert envelopes(spark, CASES).filter("id = 2").first()["data"] == {"a": "2"}


def test_missing_response_is_a_failure(spark):
    row = envelopes(spark, [None]).first()
    assert row["success"] is False and row["error"]


def test_plain_parsing_keeps_the_text(spark):
    rows = spark.createDataFrame([(0, "```json\n{}\n```"), (1, '{"Name": null}')], "id long, raw_response string")
    bad, good = parse_llm_response(rows).orderBy("id").collect()
    assert bad["data"] == {"raw_response": "```json\n{}\n```", "error": "Failed to parse JSON"}
    assert good["data"] == {"Name": None}


def test_image_records_tell_absent_from_null(spark):
    texts = [
        '{"room": null, "materials": ["oak", "tile"], "objects": [{"name": "sink", "condition": "fair"}], "confidence": null}',
        '{"materials": null, "systems": "hvac", "confidence": "0.5"}',
        "nope",
        "[1]",
        "7",
    ]
    rows = {r["id"]: r for r in R.image_records(envelopes(spark, texts)).collect()}
    first = rows[0]
    assert first["room"] is None and first["view"] == "unknown" and first["confidence_score"] is None
    assert first["materials"] == '["oak","tile"]' and first["systems"] == "[]"
    assert first["objects"] == '[{"name":"sink","condition":"fair"}]'
    assert rows[1]["materials"] is None and rows[1]["systems"] == "hvac" and rows[1]["confidence_score"] == 0.5
    views = {r["id"]: r for r in R.list_view(R.image_records(envelopes(spark, texts))).collect()}
    assert views[0]["materials"] == ["oak", "tile"] and views[0]["systems"] == []
    assert views[1]["materials"] is None and views[1]["systems"] == ["hvac"] and views[2]["systems"] == []
    assert rows[2]["evidence"].startswith("Error: JSON parsing failed") and rows[2]["room"] == "unknown"
    assert rows[2]["error"] is None and rows[2]["confidence_score"] == 0.0
    assert rows[3]["error"] == "'list' object has no attribute 'get'" and rows[3]["room"] is None
    assert rows[4]["error"] == "'int' object has no attribute 'get'" and rows[4]["evidence"] == ""


def test_values_pass_through_unchanged(spark):
    texts = ['{"objects": ["door", {"name": "x", "damage_type": "rust", "condition": null}], "systems": "[1]", "materials": [1, null]}']
    records = R.image_records(envelopes(spark, texts)).withColumn("project_id", F.lit(1))
    got = {r["src_key"]: r["value"] for r in image_pairs(records, "id").collect()}
    assert got["objects"] == '["door",{"name":"x","damage_type":"rust","condition":null}]'
    assert got["systems"] == "[1]" and got["materials"] == "[1,null]"
    view = R.list_view(records).first()
    assert view["systems"] == ["[1]"] and view["materials"] == ["1", None]


def test_last_image_wins_and_null_counts(spark):
    texts = ['{"room": "hall", "visible_damage": ["mold"]}', '{"room": null, "category": "x"}', "nope", "[1]"]
    records = R.image_records(envelopes(spark, texts)).withColumn("project_id", F.lit(1))

    def merged(**options):
        rows = last_wins_merge(rename_keys(image_pairs(records, "id", **options))).collect()
        return {r["key"]: r["value"] for r in rows}

    everything = merged()
    # The failed image comes last and its defaults override; the array has no keys.
    assert everything["room"] == "unknown" and everything["damage"] == "[]"
    good = merged(skip_failed=True)
    assert good["room"] is None and good["category"] == "x" and good["damage"] == "[]"
    assert "visible_damage" not in good and "building_condition" in good


def test_vocabulary_and_sizes(spark):
    rows = spark.createDataFrame(
        [("good", ["mold", "fire"], "attic", "a b c d e f g", 1.2), ("x", [], "moon", " a  b ", 0.0)],
        "overall_condition string, visible_damage array<string>, building_area string, mini_caption string, confidence double",
    )
    a, b = I.vocab_check(rows).collect()
    assert (a["bad_condition"], a["bad_damage"], a["bad_area"], a["long_caption"], a["bad_confidence"]) == (
        False, True, False, True, True)
    assert (b["bad_condition"], b["bad_damage"], b["bad_area"], b["long_caption"], b["bad_confidence"]) == (
        True, False, True, False, False)
    sizes = [(1280, 1280), (1281, 7), (3000, 1999), (100, 4000)]
    for row in I.resize_plan(spark.createDataFrame(sizes, "width int, height int")).collect():
        longer = max(row["width"], row["height"])
        scale = 1280 / longer
        want = (row["width"], row["height"]) if longer <= 1280 else (int(row["width"] * scale), int(row["height"] * scale))
        assert (row["new_width"], row["new_height"]) == want


def test_vocab_check_keeps_every_column_of_the_analyses(spark, sf):
    given = fixture(spark, sf, "fx_image_analysis")
    checked = QUERIES["vocab_check"](spark, sf)
    assert set(given.columns) < set(checked.columns)
    same = ["image_id", "project_id", "visible_damage_csv"]
    assert checked.select(same).exceptAll(given.select(same)).isEmpty() and checked.count() == given.count()
