"""The three things a user does, from tables to tables, for all projects at once.

Extract values from documents and photos, read the form catalog out of scraped
pages, and review, map and fill.
"""

from pyspark.sql import functions as F

from inspectlake.fixtures import fixture, with_fixtures
from inspectlake.functions.envelope import parse_envelope, parse_llm_response
from inspectlake.operators import documents as D
from inspectlake.operators import forms as H
from inspectlake.operators import infer as N
from inspectlake.operators import mapping as M
from inspectlake.operators import merge as G
from inspectlake.operators import records as R
from inspectlake.operators import review as V
from inspectlake.operators import tree as X
from inspectlake.plans.common import ALIASES, NORM_NAME, RENAMED, given, merged_extraction, normalized
from inspectlake.plans.reviews import STATUS
from inspectlake.session import saved
from inspectlake.sources import tables


def _answers(requests, cache, make, model_id, options):
    """Envelopes of all requests, and the new cache rows."""
    results, writes = N.cached_infer(requests, cache, make, model_id, **options)
    texts = results.withColumnsRenamed({"result": "raw_response", "error": "infer_error"})
    parsed = parse_envelope(texts.drop("success", "cached", "cache_key", "prompt", "requested_at"))
    parsed = parsed.withColumn("error", F.coalesce("infer_error", "error")).drop("infer_error")
    return saved(parsed, "envelopes"), writes


def analyse_images(images, cache, make, model_id, **options):
    """Image records of ``images(req_id, project_id, image_path, prompt, requested_at)``."""
    answered, writes = _answers(images, cache, make, model_id, options)
    return R.image_records(answered, "image_path"), writes


def read_pages(pages, cache, make, model_id, **options):
    """Page records, failed documents and new cache rows of handwritten pages.

    ``pages(req_id, project_id, doc_id, image_path, prompt, requested_at)``; a
    document with an answer that is no object has no records, only an error.
    """
    answered, writes = _answers(pages, cache, make, model_id, options)
    errors = R.document_errors(answered, "req_id")
    records = R.without_documents(R.page_records(answered, "image_path"), errors)
    return records, errors, writes


def read_texts(documents, prompts, make, model_id, **options):
    """``data`` maps of scanned documents, asked for with their text.

    Every document has a row.  One whose model call failed for good has a map
    of its ``error``; one whose answer is JSON but no object has a null map and
    ``kind`` says what it was.
    """
    asked = D.bind_prompt(documents, prompts).select(
        "project_id", F.col("doc_id").alias("req_id"), F.lit("").alias("image_path"), F.col("request").alias("prompt")
    )
    answered = saved(N.infer_with_retry(asked, make, model_id, **options).drop("prompt"), "texts")
    failed = F.create_map(F.lit("error"), F.col("infer_error"))
    return parse_llm_response(answered).withColumn("data", F.when(F.col("infer_error").isNotNull(), failed).otherwise(F.col("data")))


def extracted_values(pages, texts, images, skip_failed=False):
    """The last value of every project and key over all three sources."""
    pairs = G.union_sources(
        G.page_pairs(pages.filter("not failed"), "req_id"),
        G.map_pairs(texts, "req_id"),
        G.image_pairs(G.last_images(images, "req_id", skip_failed), "req_id", skip_failed),
    )
    return G.last_wins_merge(G.rename_keys(pairs))


def write_outputs(path, pages, failed, scanned, images, order, write_seq=1):
    """Store the document output and the image output of every project.

    ``pages`` are page records with project_id and doc_id, ``failed`` the documents that
    failed as a whole (project_id, doc_id, error), ``scanned`` scanned documents with their
    ``data`` and ``path``, ``images`` image records in the order of the column ``order``.
    The last document of each type counts (by doc_id).  A project's documents are one
    artifact; its images, which may be very many, stay one row each.
    """
    keys = ["project_id", "doc_id"]
    of_pages = D.collect_doc_fields(pages.drop("project_id")).join(pages.select(*keys).distinct(), "doc_id")
    of_scans = D.scanned_doc_result(scanned, extra=["doc_id"])

    def result(rows, doc_type):
        whole = F.to_json(F.struct(*[c for c in rows.columns if c not in keys]), {"ignoreNullFields": "false"})
        return rows.select("project_id", F.lit(doc_type).alias("doc_type"), F.col("doc_id").alias("ordinal"), whole.alias("result"), F.lit(None).cast("string").alias("error"))

    wrong = failed.select("project_id", F.lit("handwritten").alias("doc_type"), F.col("doc_id").alias("ordinal"), F.lit(None).cast("string").alias("result"), "error")
    results = result(of_pages, "handwritten").unionByName(result(of_scans, "scanned")).unionByName(wrong)
    # The results are JSON texts already, so the map is put together as text.
    entry = F.transform(F.map_entries("documents"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    payload = F.concat(F.lit("{"), F.array_join(entry, ","), F.lit("}"))
    documents = D.project_documents(results).select("project_id", F.lit("document_output").alias("artifact"), F.lit(write_seq).cast("bigint").alias("write_seq"), payload.alias("payload"))
    tables.write_artifacts(documents, f"{path}/documents")
    record = F.to_json(F.struct(*[c for c in images.columns if c not in ("project_id", "kinds", order)]), {"ignoreNullFields": "false"})
    listed = images.select("project_id", F.lit("image_output").alias("artifact"), F.lit(write_seq).cast("bigint").alias("write_seq"), F.col(order).alias("ordinal"), record.alias("payload"))
    tables.write_lists(listed, f"{path}/images")


def read_outputs(spark, path):
    """The last document output of every project, and the entries of its last image output."""
    return tables.read_artifacts(spark, f"{path}/documents"), tables.read_lists(spark, f"{path}/images")


def form_catalog(pages):
    """Fields, placed outline nodes with paths, and tags of scraped pages."""
    nodes = H.by_page(saved(H.html_to_nodes(pages), "nodes", H.NODES_PER_FILE))
    items = X.outline_items(H.outline_entries(nodes))
    sections = X.section_path(X.parent_asof(X.fill_levels(items)))
    return H.form_fields(nodes), sections, H.tag_fields(nodes)


def section_tree(pages, fields, sections, report_form, item_prefix):
    """The whole tree of every scraped page: report node, outline, item section and item groups.

    ``fields`` and ``sections`` come from ``form_catalog``.
    """
    return X.union_tree(sections, pages.select("page_id"), fields, report_form, item_prefix)


def review_and_fill(fields, extracted, events, aliases):
    """Edits over extracted values, mapped and planned for approved projects.

    Returns the mapping summary of every project with a form, and what to type
    into the forms of the approved ones.
    """
    statuses = V.approval_status(events)
    values = V.review_overlay(extracted, events)
    approved = V.approved_rows(fields, statuses)
    matched = M.match_fields(approved, values, aliases)
    projects = fields.select("project_id").distinct()
    return V.approval_gate(projects, statuses, M.mapping_summary(matched)), M.fill_plan(matched)


def fillable_fields(spark, sf_dir):
    """Which form fields can each project fill, and with what value?"""
    responses = G.dealt_by_project(fixture(spark, sf_dir, "fx_response"), "resp_id")
    records = G.last_images(R.image_records(parse_envelope(responses)), "resp_id")
    extracted = G.last_wins_merge(G.rename_keys(G.image_pairs(records, "resp_id")))
    fields = fixture(spark, sf_dir, "fx_form_field")
    mapped = M.map_fields(fields, extracted, M.alias_table(spark))
    return mapped.select(
        "project_id", "ord", "name", "canonical_name", "value", "confidence_score", "evidence"
    )


def _reviewed(spark, sf_dir):
    return review_and_fill(
        fixture(spark, sf_dir, "fx_form_field"),
        merged_extraction(spark, sf_dir),
        fixture(spark, sf_dir, "fx_review_event"),
        M.alias_table(spark),
    )


def reviewed_summary(spark, sf_dir):
    return _reviewed(spark, sf_dir)[0]


def reviewed_fill(spark, sf_dir):
    return _reviewed(spark, sf_dir)[1]


QUERIES = {
    "fillable_fields": fillable_fields,
    "reviewed_summary": reviewed_summary,
    "reviewed_fill": reviewed_fill,
}

# The damage and condition of the last image that gives any record.
IMAGE_VALUES = f""", image_values as (select project_id, resp_id,
 case when not ok then 'unknown' else {given('overall_condition', "'unknown'")} end as building_condition,
 case when ok and json_exists(j, '$.visible_damage') then j->>'$.visible_damage' else '[]' end as damage
 from parsed where not ok or kind = 'object'
 qualify row_number() over (partition by project_id order by resp_id desc) = 1)
"""
REVIEWED = (
    RENAMED
    + ALIASES
    + STATUS
    + f""", edits as (select project_id, field_name as "key", new_value from fx_review_event where action = 'edit'
 qualify row_number() over (partition by project_id, field_name order by seq desc) = 1),
overlay as (select coalesce(m.project_id, e.project_id) as project_id, coalesce(m."key", e."key") as "key",
 case when e.project_id is not null then new_value else value end as value
 from merged m full join edits e on e.project_id = m.project_id and e."key" = m."key"),
matched as (select f.project_id, f.ord, f.name, o.value, o.project_id is not null as found from fx_form_field f
 join statuses s on s.project_id = f.project_id and approval_status = 'approved'
 left join aliases a on a.norm = {NORM_NAME.replace('name)', 'f.name)')}
 left join overlay o on o.project_id = f.project_id and o."key" = a.canonical)
"""
)
INPUTS = ("fx_extracted", "fx_form_field", "fx_review_event")

ORACLES = {
    "fillable_fields": with_fixtures(
        normalized("fx_response")
        + IMAGE_VALUES
        + ALIASES
        + f"""select f.project_id, f.ord, f.name, a.canonical as canonical_name,
 case a.canonical when 'damage' then damage else building_condition end as value, cast(0.9 as double) as confidence_score, 'Mapped from ' || f.name as evidence
 from fx_form_field f join aliases a on a.norm = {NORM_NAME.replace('name)', 'f.name)')} join image_values v on v.project_id = f.project_id
 where a.canonical in ('damage', 'building_condition')""",
        "fx_response", "fx_form_field",
    ),
    "reviewed_summary": with_fixtures(
        REVIEWED
        + """select p.project_id, coalesce(approval_status, 'pending') as approval_status, count(*) filter (where found) as n_mapped,
 count(*) filter (where not found) as n_unmapped, cast(case when approval_status = 'approved' then 0.9 else 0.0 end as double) as confidence_score,
 case when approval_status = 'approved' then 'Mapped ' || count(*) filter (where found) || ' fields' else 'Awaiting user approval' end as evidence
 from (select distinct project_id from fx_form_field) p left join statuses s on s.project_id = p.project_id
 left join matched m on m.project_id = p.project_id group by p.project_id, approval_status""",
        *INPUTS,
    ),
    "reviewed_fill": with_fixtures(
        REVIEWED
        + """select project_id, name, '[name=''' || name || ''']' as selector, coalesce(arg_min_null(value, ord), 'None') as fill_value
 from matched where found group by project_id, name""",
        *INPUTS,
    ),
}
