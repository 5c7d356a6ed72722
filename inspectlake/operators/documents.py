"""Uploaded inputs, text pages, key/value lines and document records."""

from pyspark.sql import functions as F

from inspectlake.functions import text as T

SPACE = " \t\n\x0b\f\r"


def present_inputs(inputs):
    return inputs.filter(F.coalesce("path", F.lit("")) != "")


def route_documents(inputs):
    """Add ``route``: text extraction for scanned files, page images for others."""
    return inputs.withColumn("route", F.when(F.col("doc_type") == "scanned", "text").otherwise("page"))


def image_paths(inputs):
    """The inputs whose file name ends in ``.jpg`` or ``.png``."""
    return inputs.filter(F.endswith("path", F.lit(".jpg")) | F.endswith("path", F.lit(".png")))


def stable_order(rows, *order):
    """Rows in input order: a range partitioning, used only at a sink."""
    return rows.orderBy(*order)


def explode_pages(documents, separator="\f"):
    """Numbered text pages with their image name and the page count.

    The count comes from the row itself, so nothing is shuffled.
    """
    pages = F.split("text", rf"\Q{separator}\E")
    kept = [c for c in documents.columns if c != "text"]
    return (
        documents.select(*kept, pages.alias("_pages"))
        .select(*kept, F.size("_pages").alias("pages"), F.posexplode("_pages").alias("_pos", "page_text"))
        .withColumn("page_no", F.col("_pos") + 1)
        .withColumn("page_name", F.concat(F.lit("page_"), F.col("page_no").cast("string"), F.lit(".png")))
        .drop("_pos")
    )


def extract_kv_lines(documents):
    """``(doc_id, pos, key, value)`` of every ``Key: value`` line.

    The first colon ends the key; outer white space goes and nothing else, so
    a comma list stays one text.  A line without a key is ignored.
    """
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "_line"))
    colon = F.instr("_line", F.lit(":"))
    return (
        lines.filter(colon > 0)
        .select(
            "doc_id",
            "pos",
            F.btrim(F.substring_index("_line", ":", 1), F.lit(SPACE)).alias("key"),
            F.nullif(F.btrim(F.substr("_line", colon + 1), F.lit(SPACE)), F.lit("")).alias("value"),
        )
        .filter("key <> ''")
    )


def repeated_keys(pairs):
    """One value per document and key: a key seen more than once has a JSON list.

    A list holds the lines of one key of one document, so it is never longer
    than that document's own text.
    """
    values = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"])
    listed = pairs.groupBy("doc_id", "key").agg(values.alias("_v"))
    return listed.select(
        "doc_id",
        "key",
        F.when(F.size("_v") > 1, F.to_json("_v")).otherwise(F.get("_v", F.lit(0))).alias("value"),
        F.size("_v").alias("n_values"),
    )


def bind_prompt(documents, prompts):
    """Request text of every document: its prompt with ``{text}`` replaced.

    ``prompts(name, template)`` carries no hint; it is broadcast while the
    optimizer knows it to be small.
    """
    bound = documents.join(prompts, documents["prompt_name"] == prompts["name"]).drop("name")
    return bound.withColumn("request", F.replace("template", F.lit("{text}"), "text")).drop("template")


def collect_doc_fields(pages, doc_type="handwritten"):
    """One record per document: its page records in order, their number and the evidence.

    A row is bounded by the pages of one document; one shuffle.
    """
    record = F.struct(*[c for c in pages.columns if c != "doc_id"])
    in_order = F.array_sort(F.collect_list(F.struct(F.col("page_no").alias("_no"), record.alias("_r"))))
    docs = pages.groupBy("doc_id").agg(
        F.transform(in_order, lambda x: x["_r"]).alias("fields"), F.count(F.lit(1)).alias("pages")
    )
    return docs.select(
        "doc_id",
        F.lit(doc_type).alias("document_type"),
        "pages",
        "fields",
        F.lit(0.0).alias("confidence_score"),
        T.processed_pages(F.col("pages")).alias("evidence"),
    )


def scanned_doc_result(documents, path="path", extra=()):
    """The result of a scanned document: one page holding all its keys; ``extra`` columns are kept."""
    return documents.select(
        "project_id",
        *extra,
        F.lit("scanned").alias("document_type"),
        F.lit(1).alias("pages"),
        F.array("data").alias("fields"),
        F.lit(0.0).alias("confidence_score"),
        T.extracted_from(F.col(path)).alias("evidence"),
    )


DOC_TYPES = ["handwritten", "scanned"]
#: Types of inputs that are no documents.
OTHER_TYPES = ["images"]


def document_type_errors(results):
    """One error row for every document whose type is not known (or null)."""
    known = F.coalesce(F.col("doc_type").isin(DOC_TYPES + OTHER_TYPES), F.lit(False))
    message = F.concat(F.lit("Unknown document type: "), F.coalesce("doc_type", F.lit("null")))
    return results.filter(~known).select("project_id", "doc_type", "ordinal", message.alias("error"))


def project_documents(results):
    """``doc_type -> result`` per project; a failed one keeps only its error.

    ``results(project_id, doc_type, ordinal, result, error)``: the last one of
    each type counts, so a project's map has at most one entry per type.
    Documents of other types are in ``document_type_errors``.
    """
    text = F.when(
        F.col("error").isNotNull(), F.to_json(F.struct("error"))
    ).otherwise(F.col("result"))
    last = (
        results.filter(F.col("doc_type").isin(DOC_TYPES))
        .groupBy("project_id", "doc_type")
        .agg(F.max_by(text, "ordinal").alias("result"))
    )
    entries = F.array_sort(F.collect_list(F.struct("doc_type", "result")))
    return last.groupBy("project_id").agg(F.map_from_entries(entries).alias("documents"))
