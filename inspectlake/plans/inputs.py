"""Queries over uploaded inputs and documents."""

from pyspark.sql import functions as F

from inspectlake.fixtures import fixture, table, with_fixtures
from inspectlake.operators import documents as D
from inspectlake.operators import records as R
from inspectlake.operators.projects import create_projects
from inspectlake.plans.common import envelopes, normalized

PROMPTS = [
    ("key_values", "List every key and its value.\nText:\n{text}\nAnswer:"),
    ("twice", "{text}|{text}"),
    ("plain", "Describe the image."),
]


def present_inputs(spark, sf_dir):
    return D.present_inputs(fixture(spark, sf_dir, "fx_input"))


def route_documents(spark, sf_dir):
    return D.route_documents(fixture(spark, sf_dir, "fx_input"))


def stable_order(spark, sf_dir):
    return D.stable_order(fixture(spark, sf_dir, "fx_input"), "ordinal")


def project_rows(spark, sf_dir):
    new = create_projects(
        fixture(spark, sf_dir, "fx_project"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    )
    return new.withColumn("images", F.size("images").cast("bigint"))


def explode_pages(spark, sf_dir):
    pages = D.explode_pages(table(spark, sf_dir, "documents").select("doc_id", "text"), "\n")
    return pages.select(
        "doc_id",
        F.col("page_no").cast("bigint").alias("page_no"),
        F.col("pages").cast("bigint").alias("pages"),
        "page_name",
        "page_text",
    )


def extract_kv_lines(spark, sf_dir):
    return D.extract_kv_lines(fixture(spark, sf_dir, "fx_kv_text")).withColumn("pos", F.col("pos").cast("bigint"))


def repeated_keys(spark, sf_dir):
    lines = D.extract_kv_lines(fixture(spark, sf_dir, "fx_kv_text"))
    return D.repeated_keys(lines).withColumn("n_values", F.col("n_values").cast("bigint"))


def bind_prompt(spark, sf_dir):
    names = F.array(*[F.lit(name) for name, _ in PROMPTS])
    which = F.get(names, (F.col("doc_id") % 3).cast("int"))
    docs = fixture(spark, sf_dir, "fx_kv_text").withColumn("prompt_name", which)
    prompts = spark.createDataFrame(PROMPTS, "name string, template string")
    return D.bind_prompt(docs, prompts).select("doc_id", "prompt_name", "request")


def _page_envelopes(spark, sf_dir):
    return envelopes(spark, sf_dir, "fx_page_response")


def page_field_record(spark, sf_dir):
    return R.page_field_record(_page_envelopes(spark, sf_dir))


def page_error_record(spark, sf_dir):
    return R.page_error_record(_page_envelopes(spark, sf_dir))


def collect_doc_fields(spark, sf_dir):
    records = R.page_records(_page_envelopes(spark, sf_dir))
    docs = D.collect_doc_fields(records.drop("resp_id", "image"))

    def shown(x):
        values = [F.coalesce(x[f], F.lit("-")) for f in R.PAGE_FIELDS]
        return F.concat(x["page_no"].cast("string"), F.lit("="), F.concat_ws("/", *values, x["evidence"]))

    return docs.select(
        "doc_id",
        "document_type",
        "pages",
        F.array_join(F.transform("fields", shown), ";").alias("fields"),
        "confidence_score",
        "evidence",
    )


def project_documents(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_input").select(
        "project_id",
        "doc_type",
        "ordinal",
        F.concat(F.lit("result of "), "path").alias("result"),
        F.when(F.coalesce("path", F.lit("")) == "", F.lit("no path")).alias("error"),
    )
    # Some documents have a type that is not known, or none.
    kind = F.when(F.col("ordinal") % 13 == 0, F.lit("fax")).when(F.col("ordinal") % 17 == 0, F.lit(None)).otherwise(F.col("doc_type"))
    rows = rows.withColumn("doc_type", kind)
    none = F.lit(None).cast("bigint")
    documents = D.project_documents(rows).select(
        "project_id",
        F.try_element_at("documents", F.lit("handwritten")).alias("handwritten"),
        F.try_element_at("documents", F.lit("scanned")).alias("scanned"),
        F.size("documents").cast("bigint").alias("n_documents"),
        none.alias("ordinal"),
        F.lit(None).cast("string").alias("error"),
    )
    return documents.unionByName(D.document_type_errors(rows).select("project_id", "ordinal", "error"), allowMissingColumns=True)


QUERIES = {
    "present_inputs": present_inputs,
    "route_documents": route_documents,
    "stable_order": stable_order,
    "create_projects": project_rows,
    "explode_pages": explode_pages,
    "extract_kv_lines": extract_kv_lines,
    "repeated_keys": repeated_keys,
    "bind_prompt": bind_prompt,
    "page_field_record": page_field_record,
    "page_error_record": page_error_record,
    "collect_doc_fields": collect_doc_fields,
    "project_documents": project_documents,
}

KV_LINES = """, raw as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from fx_kv_text),
kv as (select doc_id, pos, regexp_extract(line, '^\\s*([^:]+?)\\s*:\\s*(.*?)\\s*$', 1) as "key",
 nullif(regexp_extract(line, '^\\s*([^:]+?)\\s*:\\s*(.*?)\\s*$', 2), '') as value from raw
 where regexp_matches(line, '^\\s*([^:]+?)\\s*:\\s*(.*?)\\s*$'))
"""

ORACLES = {
    "present_inputs": with_fixtures("select * from fx_input where coalesce(path, '') <> ''", "fx_input"),
    "route_documents": with_fixtures(
        "select *, case when doc_type = 'scanned' then 'text' else 'page' end as route from fx_input", "fx_input"
    ),
    "stable_order": with_fixtures("select * from fx_input order by ordinal", "fx_input"),
    "create_projects": with_fixtures(
        """select cast(project_id as varchar) as project_id, project_name, 'created' as status,
 timestamp '2024-01-01 00:00:00' as created_at, '' as handwritten_pdf, '' as scanned_pdf, cast(0 as bigint) as images from fx_project""",
        "fx_project",
    ),
    "explode_pages": """with parts as (select doc_id, string_split(text, chr(10)) as p from documents),
pages as (select doc_id, unnest(range(1, len(p) + 1)) as page_no, len(p) as pages, unnest(p) as page_text from parts)
select doc_id, page_no, pages, 'page_' || page_no || '.png' as page_name, page_text from pages""",
    "extract_kv_lines": with_fixtures(KV_LINES + "select * from kv", "fx_kv_text"),
    "repeated_keys": with_fixtures(
        KV_LINES
        + """select doc_id, "key", case when count(*) > 1 then cast(to_json(list(value order by pos)) as varchar) else max(value) end as value,
 count(*) as n_values from kv group by doc_id, "key" """,
        "fx_kv_text",
    ),
    "bind_prompt": with_fixtures(
        """select doc_id, case doc_id % 3 when 0 then 'key_values' when 1 then 'twice' else 'plain' end as prompt_name,
 case doc_id % 3 when 0 then 'List every key and its value.' || chr(10) || 'Text:' || chr(10) || text || chr(10) || 'Answer:'
  when 1 then text || '|' || text else 'Describe the image.' end as request from fx_kv_text""",
        "fx_kv_text",
    ),
    "page_field_record": with_fixtures(
        normalized("fx_page_response")
        + """select resp_id, doc_id, page_no, image, 'handwritten' as type, j->>'$.owner_name' as owner_name, j->>'$.property_address' as property_address,
 j->>'$.inspection_date' as inspection_date, j->>'$.inspector_name' as inspector_name,
 coalesce(cast(j->>'$.confidence' as double), 0.0) as confidence_score, 'Analyzed ' || image as evidence from parsed where ok and kind = 'object'""",
        "fx_page_response",
    ),
    "page_error_record": with_fixtures(
        normalized("fx_page_response")
        + """select resp_id, doc_id, page_no, image, 'handwritten' as type, cast(0.0 as double) as confidence_score, 'Error: JSON parsing failed: Expecting value: line 1 column 1 (char 0)' as evidence
 from parsed where not ok""",
        "fx_page_response",
    ),
    "collect_doc_fields": with_fixtures(
        normalized("fx_page_response")
        + """, shown as (select doc_id, page_no, page_no || '=' || concat_ws('/', coalesce(case when ok then j->>'$.owner_name' end, '-'),
 coalesce(case when ok then j->>'$.property_address' end, '-'), coalesce(case when ok then j->>'$.inspection_date' end, '-'),
 coalesce(case when ok then j->>'$.inspector_name' end, '-'),
 case when ok then 'Analyzed ' || image else 'Error: JSON parsing failed: Expecting value: line 1 column 1 (char 0)' end) as s from parsed)
select doc_id, 'handwritten' as document_type, count(*) as pages, string_agg(s, ';' order by page_no) as fields,
 cast(0.0 as double) as confidence_score, 'Processed ' || count(*) || ' pages' as evidence from shown group by doc_id""",
        "fx_page_response",
    ),
    "project_documents": with_fixtures(
        """, typed as (select project_id, ordinal, path, case when ordinal % 13 = 0 then 'fax' when ordinal % 17 = 0 then null else doc_type end as doc_type from fx_input),
last as (select project_id, doc_type, case when coalesce(path, '') = '' then '{"error":"no path"}' else 'result of ' || path end as result
 from typed where doc_type in ('handwritten', 'scanned') qualify row_number() over (partition by project_id, doc_type order by ordinal desc) = 1)
select project_id, max(result) filter (where doc_type = 'handwritten') as handwritten, max(result) filter (where doc_type = 'scanned') as scanned,
 count(*) as n_documents, cast(null as bigint) as ordinal, cast(null as varchar) as error from last group by project_id
union all select project_id, null, null, null, ordinal, 'Unknown document type: ' || coalesce(doc_type, 'null') from typed where doc_type = 'fax' or doc_type is null""",
        "fx_input",
    ),
}
