import hashlib

import pytest
from pyspark.sql import functions as F

from inspectlake.functions import text as T


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ('```json\n{"view": "wide"}\n```', '{"view": "wide"}'),
        ('I can see {"view": "wide"} and no more', '{"view": "wide"}'),
        ("nothing to report", "nothing to report"),
        ("```json\n[1, 2]\n```\n", "[1, 2]"),
        ('{"a": {"b": 1}} tail }', '{"a": {"b": 1}} tail }'),
        ("line {\n \"a\": 1\n} end", "{\n \"a\": 1\n}"),
        ("} no pair {", "} no pair {"),
        ("\u00a0 plain \u2003\x1c", "plain"),
        ("", ""),
        ("{}", "{}"),
    ],
)
def test_normalize_response(spark, raw, want):
    assert one(spark, T.normalize_response, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [("  Sec 1\n of  2 ", "Sec 1 of 2"), ("\u00a0A\u00a0\u00a0B\ufeff", "A B"), ("", ""), ("x", "x")],
)
def test_clean_title(spark, raw, want):
    assert one(spark, T.clean_title, raw) == want


@pytest.mark.parametrize(
    "cls, level, kind",
    [
        ("outlineItem indent-level-3", 3, "section"),
        ("outlineItem info_table_section report_section", 0, "info_table"),
        ("report_section indent-level-12", 12, "report_section"),
        ("indent-level-x", 0, "section"),
        ("", 0, "section"),
    ],
)
def test_outline_classes(spark, cls, level, kind):
    assert one(spark, T.indent_level, cls) == level
    assert one(spark, T.section_type, cls) == kind


def test_field_name_key_and_title(spark):
    assert one(spark, T.normalize_field_name, "Property-Address Line") == "property_address_line"
    assert one(spark, lambda c: T.item_title(c, "edit_item_"), "edit_item_7") == "Action Item 7"
    key = one(spark, lambda c: T.cache_key(c, F.lit("p")), "a.jpg")
    assert key == "qwen_vl:" + hashlib.md5(b"a.jpg:p").hexdigest()
