"""Responses to records: page fields, image analyses and their error forms."""

from pyspark.sql import functions as F

from inspectlake import settings as S
from inspectlake.functions import text as T
from inspectlake.functions.envelope import given, text_list

PAGE_FIELDS = ["owner_name", "property_address", "inspection_date", "inspector_name"]
LISTS = [*S.IMAGE_LIST_FIELDS, "objects"]

IS_RECORD = "success and kind = 'object'"
IS_FAILED = "not success"
IS_NO_OBJECT = "success and kind <> 'object'"


def _others(envelopes, image):
    used = {"success", "kind", "data", "kinds", "error", "raw_response", image}
    return [c for c in envelopes.columns if c not in used]


def split_success(envelopes):
    """The successful and the failed envelopes."""
    return envelopes.filter("success"), envelopes.filter("not success")


def with_part(envelopes):
    """The envelopes with ``part``, ok or failed, in one pass."""
    return envelopes.withColumn("part", F.when(F.col("success"), "ok").otherwise("failed"))


def confidence(data):
    """``confidence`` as a number: 0.0 when absent, null when given as null."""
    return F.when(
        F.map_contains_key(data, "confidence"), given(data, "confidence").try_cast("double")
    ).otherwise(F.lit(0.0))


def page_records(envelopes, image="image", doc_type="handwritten"):
    """The record of every page, in one pass; ``failed`` marks error records.

    A response that parses but is no object gives no record; see
    ``document_errors``.
    """
    data, failed = F.col("data"), F.expr(IS_FAILED)
    return envelopes.filter(f"{IS_FAILED} or kind = 'object'").select(
        *_others(envelopes, image),
        F.col(image).alias("image"),
        F.lit(doc_type).alias("type"),
        *[F.when(~failed, given(data, f)).alias(f) for f in PAGE_FIELDS],
        F.when(failed, F.lit(0.0)).otherwise(confidence(data)).alias("confidence_score"),
        F.when(failed, T.failed(F.col("error")))
        .otherwise(T.analyzed(F.col(image)))
        .alias("evidence"),
        failed.alias("failed"),
    )


def page_field_record(envelopes, image="image", doc_type="handwritten"):
    """The record of every page whose response is an object."""
    return page_records(envelopes.filter(IS_RECORD), image, doc_type).drop("failed")


def page_error_record(envelopes, image="image", doc_type="handwritten"):
    """The record of every failed page; it has none of the field columns."""
    failed = page_records(envelopes.filter(IS_FAILED), image, doc_type)
    return failed.drop("failed", *PAGE_FIELDS)


def _no_get(kind, raw):
    """The error text of reading a field of a value that is no object."""
    # The type names in that text.
    names = {"array": "list", "string": "str", "boolean": "bool", "null": "NoneType"}
    number = F.when(F.rlike(raw, F.lit(r"[.eEN]|Infinity")), "float").otherwise("int")
    name = F.when(kind == "number", number)
    for k, n in names.items():
        name = name.when(kind == k, n)
    return F.concat(F.lit("'"), name, F.lit("' object has no attribute 'get'"))


def document_errors(envelopes, order, doc="doc_id"):
    """Documents with a response that parses but is no object, and the error.

    Reading the fields of the first such page raises, which fails the whole
    document.
    """
    text = _no_get(F.col("kind"), F.col("raw_response"))
    return envelopes.filter(IS_NO_OBJECT).groupBy(doc).agg(F.min_by(text, order).alias("error"))


def without_documents(records, errors, doc="doc_id"):
    """The records of all documents that did not fail as a whole."""
    return records.join(errors.select(doc), doc, "left_anti")


def image_records(envelopes, image="image_name", checked=False):
    """One image record per response, in one pass.

    An object gives its 14 fields, with defaults only for absent keys; a failed
    response gives the same fields all defaulted; any other JSON value gives
    the short error record, whose other columns are null and whose ``error``
    is set.  List fields keep what came: the JSON text of a list or object, a
    string as it is; ``kinds`` tells them apart and ``list_view`` gives typed
    columns.  ``checked`` adds what ``vocab_check`` asks for: ``building_area`` and
    the stated ``confidence``, null where a response does not give them.
    """
    data = F.col("data")
    good, failed = F.expr(IS_RECORD), F.expr(IS_FAILED)

    def either(found, default):
        return F.when(good, found).when(failed, default)

    return envelopes.select(
        *_others(envelopes, image),
        F.col(image).alias("image_name"),
        *[either(given(data, f, d), F.lit(d)).alias(f) for f, d in S.IMAGE_TEXT_DEFAULTS.items()],
        *[either(given(data, f, "[]"), F.lit("[]")).alias(f) for f in LISTS],
        F.when(good, F.col("kinds")).alias("kinds"),
        F.when(good, confidence(data)).otherwise(F.lit(0.0)).alias("confidence_score"),
        F.when(good, T.analyzed(F.col(image)))
        .when(failed, T.failed(F.col("error")))
        .otherwise(F.lit(""))
        .alias("evidence"),
        *([F.when(good, F.try_element_at("data", F.lit("building_area"))).alias("building_area"), F.when(good, F.try_element_at("data", F.lit("confidence"))).try_cast("double").alias("confidence")] if checked else []),
        F.when(~good & ~failed, _no_get(F.col("kind"), F.col("raw_response"))).alias("error"),
    )


def list_view(records, fields=S.IMAGE_LIST_FIELDS):
    """The list fields as arrays of text; a value that was no list is one item."""
    return records.withColumns({f: text_list(F.col(f), F.coalesce(F.try_element_at("kinds", F.lit(f)), F.lit("array"))) for f in fields})


def image_record(envelopes, image="image_name"):
    return image_records(envelopes.filter(IS_RECORD), image).drop("error")


def image_default_record(envelopes, image="image_name"):
    return image_records(envelopes.filter(IS_FAILED), image).drop("error")


def exception_record(envelopes, image="image_name"):
    short = image_records(envelopes.filter(IS_NO_OBJECT), image)
    return short.select(
        *_others(envelopes, image), "image_name", "error", "confidence_score", "evidence"
    )
