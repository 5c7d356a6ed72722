"""Queries that go through files: ingest, artifacts, catalogs, project rows."""

from pyspark.sql import functions as F

from inspectlake.fixtures import fixture, table, with_fixtures
from inspectlake.functions.envelope import parse_llm_response
from inspectlake.operators import records as R
from inspectlake.operators.projects import create_projects
from inspectlake.plans.common import PARSE_ERROR, all_cores, envelopes, given, normalized
from inspectlake.plans.lifecycle import form_catalog, read_outputs, section_tree, write_outputs
from inspectlake.plans.pages import ORACLES as PAGES
from inspectlake.session import saved, work_dir
from inspectlake.sources import files, tables
from inspectlake.sources.versions import file_system, hadoop_path


def write_uploads(spark, sf_dir):
    """The documents as uploaded text files, one folder per type."""
    root = work_dir(spark, "uploads")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for n, doc_type in enumerate(("handwritten", "scanned", "images")):
        part = docs.filter(F.col("doc_id") % 3 == n).select(F.to_json(F.struct("doc_id", "text")))
        # A file is read back as one value, so its size is bounded.
        part.write.option("maxRecordsPerFile", 1000).text(f"{root}/p1/uploads/{doc_type}/batch")
    return root


def documents_in(rows):
    """One row per document in ingested files."""
    lines = F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")
    parsed = rows.select("project_id", "doc_type", lines).filter("line <> ''")
    doc = F.from_json("line", "doc_id bigint, text string")
    return parsed.select("project_id", "doc_type", doc.alias("d")).select(
        "project_id", "doc_type", "d.doc_id", F.md5("d.text").alias("text_md5")
    )


def ingest_files(spark, sf_dir):
    return documents_in(files.ingest_files(spark, write_uploads(spark, sf_dir), "*.txt"))


def write_photos(spark, rows):
    """``rows(ordinal, path)`` as uploaded files whose names end as the paths do."""
    root = work_dir(spark, "photos")
    folder = f"{root}/p1/uploads/images"
    ending = F.regexp_extract("path", r"(\.[^/]*)$", 1).alias("ending")
    rows.select(F.to_json(F.struct("ordinal", "path")), ending).write.option("maxRecordsPerFile", 1000).partitionBy("ending").text(folder)
    fs = file_system(spark, root)
    # A few folders of bounded files: the writer has no say in the names of files.
    for group in fs.listStatus(hadoop_path(spark, folder)):
        name = group.getPath().getName()
        if name.startswith("ending="):
            for file in fs.listStatus(group.getPath()):
                path = file.getPath().toString()
                if path.endswith(".txt"):
                    fs.rename(file.getPath(), hadoop_path(spark, path.removesuffix(".txt") + name.removeprefix("ending=")))
    return root


def image_glob(spark, sf_dir):
    root = write_photos(spark, fixture(spark, sf_dir, "fx_image_path"))
    lines = F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")
    found = files.image_glob(spark, root).select(lines).filter("line <> ''")
    return found.select(F.from_json("line", "ordinal bigint, path string").alias("p")).select("p.*")


def load_projects(spark, sf_dir):
    path = work_dir(spark, "projects")
    new = create_projects(
        fixture(spark, sf_dir, "fx_project").filter("project_id % 3 <> 0"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"),
    )
    tables.save_projects(new, path)
    requested = fixture(spark, sf_dir, "fx_project").select("project_id")
    return tables.load_projects(spark, path, requested).select(
        "project_id", "project_name", "status", "created_at", "error"
    )


def write_artifacts(spark, sf_dir):
    path = work_dir(spark, "artifacts")
    writes = fixture(spark, sf_dir, "fx_artifact")
    for part in (0, 1):
        tables.write_artifacts(writes.filter(F.col("write_seq") % 2 == part), path, "json")
    return tables.read_artifacts(spark, path, "json")


def _pages(spark, sf_dir):
    return all_cores(fixture(spark, sf_dir, "fx_form_html"), "page_id")


def form_catalog_io(spark, sf_dir):
    """What ``form_catalog`` reads out of the pages, saved and loaded again."""
    path = work_dir(spark, "catalog")
    pages = _pages(spark, sf_dir)
    fields, sections, tags = form_catalog(pages)
    tables.save_catalog(path, fields, sections, tags, pages)
    fields, sections, tags = tables.load_catalog(spark, path)
    parts = (
        ("form_fields", fields, ("form_id", "name", "label", "type", "value")),
        ("sections", sections, ("ord", "level", "title", "section_type", "path", "depth")),
        ("tags", tags, ("name", "value", "label", "type")),
    )
    shown = [
        rows.select("page_id", F.lit(name).alias("part"), F.concat_ws("/", *[F.col(c).cast("string") for c in columns]).alias("content"))
        for name, rows, columns in parts
    ]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


def whole_tree(spark, sf_dir):
    """The whole tree of every page, out of its HTML."""
    pages = _pages(spark, sf_dir)
    fields, sections, _ = form_catalog(pages)
    return section_tree(pages, fields, sections, "edit_report_1", "item_")


def project_results(spark, sf_dir):
    """Document and image outputs of every project, from raw answers to the stores and back."""
    project = (F.col("doc_id") % 40).alias("project_id")
    path = work_dir(spark, "outputs")
    # Read by the records, their documents and the errors, so parsed and written once.
    written = saved(envelopes(spark, sf_dir, "fx_page_response"), "envelopes")
    failed = R.document_errors(written, "doc_id")
    pages = R.without_documents(R.page_records(written.drop("resp_id")), failed).select(project, "*")
    failed = failed.select(project, "doc_id", "error")
    scanned = parse_llm_response(fixture(spark, sf_dir, "fx_response")).filter("success and kind = 'object'")
    scanned = scanned.select("project_id", F.col("resp_id").alias("doc_id"), "data", F.concat(F.lit("scan "), "resp_id").alias("path"))
    images = R.image_records(envelopes(spark, sf_dir).select("*"))
    write_outputs(path, pages, failed, scanned, images, order="resp_id")
    documents, photos = read_outputs(spark, path)
    shown = [F.get_json_object("payload", f"$.{p}") for p in ("handwritten.evidence", "handwritten.pages", "handwritten.error", "scanned.evidence")]
    one = documents.select("project_id", "artifact", F.lit(0).cast("bigint").alias("ordinal"), F.concat_ws("/", *shown).alias("content"))
    of = [F.get_json_object("payload", f"$.{p}") for p in ("image_name", "room", "evidence")]
    return one.unionByName(photos.select("project_id", "artifact", "ordinal", F.concat_ws("/", *of).alias("content")))


QUERIES = {
    "ingest_files": ingest_files,
    "image_glob": image_glob,
    "load_projects": load_projects,
    "write_artifacts": write_artifacts,
    "form_catalog_io": form_catalog_io,
    "section_tree": whole_tree,
    "project_results": project_results,
}

#: Sections of the pages with an outline: order, level, title, type, path.
NAME, BRAND = "trim(p_name)", "p_brand"
SECTIONS = [
    (1, 0, NAME, "'report_section'", NAME),
    (2, 1, "'Part'", "'info_table'", f"{NAME} || ' > Part'"),
    (3, 2, "''", "cast(null as varchar)", f"{NAME} || ' > Part > '"),
    (3, 3, f"'Deep ' || {BRAND}", "'section'", f"{NAME} || ' > Part >  > Deep ' || {BRAND}"),
]


def _node(template, node, parent, title, kind, key, order="null"):
    """A row of the whole tree of one template, or of all."""
    where = "" if template is None else f" where p_partkey % 4 = {template}"
    return (
        f"select p_partkey as page_id, '{node}' as node_id, '{parent}' as parent_id, {title} as title, {kind} as section_type,"
        f" {key} as sort_key, cast({order} as bigint) as sort_ord from part{where}"
    )


#: Template, item form and the place of its first field.
ITEM_FORMS = [(1, "item_7", 8), (2, "item_9", 9), (3, "item_3", 10)]
TREE = [
    _node(None, "report", "root", "'Report Information'", "'metadata'", 0),
    *[
        _node(3, f"outline:{o}:{level}", "root" if level == 0 else "outline:{}:{}".format(*SECTIONS[k - 1][:2]), title, kind, 1, o)
        for k, (o, level, title, kind, _) in enumerate(SECTIONS)
    ],
    *[_node(t, "items", "root", "'Condition Action Items'", "'data_items'", 2) for t, _, _ in ITEM_FORMS],
    *[_node(t, f"item:{form}", "items", f"'Action Item {form[5:]}'", "'action_item'", 2, first) for t, form, first in ITEM_FORMS],
]

ORACLES = {
    "ingest_files": """select 'p1' as project_id, case doc_id % 3 when 0 then 'handwritten' when 1 then 'scanned' else 'images' end as doc_type,
 doc_id, md5(text) as text_md5 from documents""",
    "load_projects": with_fixtures(
        """select cast(project_id as varchar) as project_id, case when project_id % 3 <> 0 then project_name end as project_name,
 case when project_id % 3 <> 0 then 'created' end as status, case when project_id % 3 <> 0 then timestamp '2024-01-01 00:00:00' end as created_at,
 case when project_id % 3 = 0 then 'Project ' || project_id || ' not found' end as error from fx_project""",
        "fx_project",
    ),
    "write_artifacts": with_fixtures(
        "select * from fx_artifact qualify row_number() over (partition by project_id, artifact order by write_seq desc) = 1", "fx_artifact"
    ),
    "image_glob": with_fixtures("select * from fx_image_path where path like '%.jpg' or path like '%.png'", "fx_image_path"),
    "form_catalog_io": f"""with fields as ({PAGES['form_fields']}), tags as ({PAGES['tag_fields']})
select page_id, 'form_fields' as part, concat_ws('/', form_id, name, label, type, value) as content from fields
union all select page_id, 'tags', concat_ws('/', name, value, label, type) from tags"""
    + "".join(
        f" union all select p_partkey, 'sections', concat_ws('/', {o}, {level}, {title}, {kind}, {path}, {level + 1}) from part where p_partkey % 4 = 3"
        for o, level, title, kind, path in SECTIONS
    ),
    "section_tree": " union all ".join(TREE),
    "project_results": with_fixtures(
        normalized("fx_page_response").replace("parsed as", "page_parsed as").replace("unfenced", "page_unfenced").replace("norm as", "page_norm as").replace("from norm", "from page_norm")
        + normalized("fx_response")
        + """, docs as (select doc_id, doc_id % 40 as project_id, count(*) as n from page_parsed group by doc_id),
handwritten as (select project_id, 'Processed ' || n || ' pages' as evidence, n from docs qualify row_number() over (partition by project_id order by doc_id desc) = 1),
scanned as (select project_id, 'Extracted via LLM from scan ' || resp_id as evidence from (select * from fx_response where json_valid(raw_response) and json_type(raw_response) = 'OBJECT')
 qualify row_number() over (partition by project_id order by resp_id desc) = 1),
combined as (select coalesce(h.project_id, s.project_id) as project_id, concat_ws('/', h.evidence, cast(h.n as varchar), s.evidence) as content
 from handwritten h full join scanned s on h.project_id = s.project_id)
select project_id, 'document_output' as artifact, cast(0 as bigint) as ordinal, content from combined
union all select project_id, 'image_output', resp_id, concat_ws('/', image_name, case when not ok then 'unknown' when kind = 'object' then """
        + given("room", "'unknown'")
        + """ end, case when not ok then 'Error: JSON parsing failed: ' || """
        + PARSE_ERROR
        + """ when kind = 'object' then 'Analyzed ' || image_name else '' end) from parsed""",
        "fx_page_response",
        "fx_response",
    ),
}
