"""Input tables for the queries, derived from the supplied parquet tables.

The supplied tables hold no forms, ``Key: value`` lines or model responses, so
the inputs are computed from their rows.  Each text runs unchanged on Spark SQL
and on DuckDB; the checks use it as a common table expression.
"""

import re

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

SQL = {
    "fx_response": """
select event_id as resp_id, user_id as project_id, 'img_' || event_id || '.jpg' as image_name,
 case event_id % 14
  when 0 then '```json' || chr(10) || '{"room": "' || event_type || '", "category": "interior", "confidence": 0.9}' || chr(10) || '```'
  when 1 then 'This is what I see: {"room": "' || event_type || '", "view": "close-up"} as asked'
  when 2 then '{"room": null, "overall_condition": "fair", "confidence": 0.35}'
  when 3 then 'no answer for this picture'
  when 4 then '{"room": "a"} and {"room": "b"}'
  when 5 then '[1, 2]'
  when 6 then ''
  when 8 then '{"objects": [{"name": "door", "damage_type": "rust", "condition": null, "n": ' || event_id || '}, {"name": "sill"}], "systems": ["heat", "air"]}'
  when 9 then '{"objects": ["door", "window"], "systems": "heat", "room": "attic"}'
  when 10 then '{"objects": null, "systems": null, "visible_damage": "mold"}'
  when 11 then '{"objects": "none seen", "systems": "[1]", "materials": {"wood": 2}}'
  when 12 then '{"objects": [], "systems": [true, 1.5, null], "notes": 7}'
  else '{"materials": ["drywall", "tile"], "visible_damage": ["mold"], "caption": "c' || event_id || '", "confidence": 0.8}' end as raw_response
 from events""",
    "fx_kv_text": """
select o_orderkey as doc_id, 'Name: Customer ' || o_custkey || chr(10) || 'Order Status: ' || o_orderstatus || chr(10)
 || 'Project: ' || o_orderpriority || chr(10) || 'free text line' || chr(10) || 'Project: P' || (o_orderkey % 3) || chr(10) || 'Status:' as text from orders""",
    "fx_form_field": """
select cast(floor(p_partkey / 13) as bigint) as project_id, p_partkey as ord, case when p_partkey % 4 = 0 then 'edit_report_1' else 'edit_item_' || (p_partkey % 7) end as form_id,
 case p_partkey % 9 when 0 then 'Owner' when 1 then 'Property-Address' when 2 then 'client name' when 3 then 'ROOF' when 4 then 'Overall Condition'
  when 5 then 'issues' when 6 then 'inspector_name' when 7 then '' else p_name end as name, p_name as label, p_type as value from part""",
    "fx_extracted": """
select user_id as project_id, event_id as ord, cast(floor(event_id / 6) as bigint) % 3 + 1 as phase,
 case event_id % 6 when 0 then 'owner_name' when 1 then 'property_address' when 2 then 'overall_condition' when 3 then 'visible_damage' when 4 then 'inspection_date' else 'ignored_key' end as src_key,
 case when event_type = 'error' then null else event_type || '_' || event_id end as value from events""",
    "fx_outline": """
select l_orderkey as page_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as ord,
 '  Sec ' || l_linenumber || chr(10) || ' of  ' || l_partkey as raw_title,
 'outlineItem indent-level-' || (l_suppkey % 5) || case l_partkey % 3 when 0 then ' info_table_section' when 1 then ' report_section' else '' end as cls from lineitem""",
    "fx_attempt": """
select cast(floor(event_id / 4) as bigint) % 50 as project_id, cast(floor(event_id / 4) as bigint) as task_id, cast(event_id % 4 as int) + 1 as attempt,
 event_type <> 'error' and value > 60 as ok, case when event_type <> 'error' and value > 60 then null else 'err_' || event_id end as error from events""",
    "fx_cache": """
select event_id as entry_id, 'img_' || (event_id % 200) || '.jpg' as image_path, 'p' || (event_id % 3) as prompt, ts as cached_at, event_type <> 'error' as success, 'r' || event_id as result from events""",
    "fx_request": """
select event_id as req_id, 'img_' || (event_id % 400) || '.jpg' as image_path, 'p' || (event_id % 4) as prompt, ts as requested_at from events""",
    "fx_user_request": """
select event_id as req_id, 'img_' || user_id || '.jpg' as image_path, 'p' || (event_id % 3) as prompt, ts as requested_at from events""",
    "fx_review_event": """
select event_id as seq, user_id as project_id, ts, case event_type when 'signup' then 'approved' when 'error' then 'rejected' when 'click' then 'edit' else 'view' end as action,
 case event_id % 3 when 0 then 'owner_name' when 1 then 'address' else 'notes' end as field_name, 'v' || event_id as new_value from events""",
    "fx_log": """
select user_id as project_id, event_id as seq, event_type as step, case when event_type = 'error' then 'failed' else 'done' end as status, ts as at, cast(floor(value * 10) as bigint) as duration_ms,
 case when event_type = 'error' then 'e' || event_id else null end as error from events""",
    "fx_image_dim": """
select p_partkey as image_id, p_size * 120 as width, cast(p_partkey % 3000 as int) + 100 as height from part""",
    "fx_form_html": """
select p_partkey as page_id, case p_partkey % 4 when 0 then '<html><body><form id="edit_report_1"><label for="f1"> ' || p_name || ' </label><input id="f1" name="owner" value="' || p_brand || '"><input type="hidden" name="h" value="x"><span>Addr</span><input name="property_address"><label>Wrapped <input name="roof"></label><div class="field"><label>Deep</label><p><textarea name="issues">t</textarea></p></div><input aria-label="Aria" name="z"><input name="only_name"><select name="tag_kind"><option>A</option><option> </option><option>' || p_type || '</option></select><input type="radio" name="r" value="1" id="r1" checked><label for="r1">One</label><input type="radio" name="r" value="2"><label>Two</label></form></body></html>'
 when 1 then '<html><body><form id="item_7"><div class="form-group"><label>Group</label><div class="form-group"><label> ' || p_name || ' </label><p><input type="checkbox" name="agree" value="yes" checked></p></div><p><input type="checkbox"></p></div><input type="checkbox" name="many" value="a"><label>Alpha</label><input type="CheckBox" name="many" value="b" checked><label>Beta</label><input name="plain" value="' || p_brand || '"></form></body></html>'
 when 2 then '<html><body><form id="edit_report_1"><select name="kind"><option value="x">X</option><option value="y" selected>' || p_type || '</option></select><input name="n" placeholder="Hold" value="' || p_brand || '"></form><form id="item_9"><div>Head</div><input id="a9" class="my-tag" name="t1" value="v1"><input id="tag-box" name="t2" value="v2"><span>Near</span><input type="radio" name="solo" value="1" checked></form></body></html>'
 else '<html><body><ul id="outline-navigation-list"><li class="outlineItem indent-level-0 report_section"><a> ' || p_name || ' </a></li><li class="outlineItem indent-level-1 info_table_section"><span>Part</span></li><li class="outlineItem indent-level-3">Deep ' || p_brand || '</li></ul><form id="item_3"><label for="c">Cond</label><textarea id="c" name="cond">' || p_type || '</textarea></form></body></html>' end as html from part""",
    "fx_input": """
select doc_id as ordinal, doc_id % 40 as project_id, case doc_id % 3 when 0 then 'handwritten' when 1 then 'scanned' else 'images' end as doc_type,
 case when doc_id % 7 = 0 then '' when doc_id % 11 = 0 then null else 'uploads/' || source || '/' || doc_id || '.pdf' end as path from documents""",
    "fx_page_response": """
select event_id as resp_id, cast(floor(event_id / 5) as bigint) as doc_id, cast(event_id % 5 as bigint) + 1 as page_no, 'page_' || (event_id % 5 + 1) || '.png' as image,
 case event_id % 4
  when 0 then '{"owner_name": "Owner ' || user_id || '", "property_address": "Addr ' || event_id || '", "inspection_date": "2024-01-02", "inspector_name": "I", "confidence": 0.9}'
  when 1 then '{"owner_name": null, "inspector_name": "I' || event_id || '"}'
  when 2 then 'no fields found'
  else '{}' end as raw_response from events""",
    "fx_image_analysis": """
select event_id as image_id, user_id as project_id,
 case event_id % 6 when 0 then 'excellent' when 1 then 'good' when 2 then 'fair' when 3 then 'poor' when 4 then 'critical' else 'Broken' end as overall_condition,
 case event_id % 5 when 0 then 'mold,cracks' when 1 then 'none' when 2 then '' when 3 then 'rust,fire' else 'water_damage' end as visible_damage_csv,
 case event_id % 3 when 0 then 'kitchen' when 1 then 'roof' else 'spaceship' end as building_area,
 case event_id % 4 when 0 then 'Kitchen: undamaged' when 1 then 'one two three four five six' when 2 then 'one two three four five six seven' else '' end as mini_caption,
 cast(case event_id % 10 when 9 then '1.5' when 8 then '0.8' else '0.' || (event_id % 10) end as double) as confidence from events""",
    "fx_artifact": """
select user_id as project_id, case event_type when 'view' then 'image_output' when 'click' then 'mapping' else 'document_output' end as artifact, event_id as write_seq, 'payload_' || event_id as payload from events""",
    "fx_project": """
select c_custkey as project_id, c_name as project_name from customer""",
    "fx_image_path": """
select doc_id as ordinal, 'uploads/images/' || doc_id || case doc_id % 5 when 0 then '.jpg' when 1 then '.png' when 2 then '.JPG' when 3 then '.pdf' else '.jpg.txt' end as path from documents""",
}


def tables_of(text):
    """Supplied tables a SQL text names after ``from`` or ``join``."""
    names = set(re.findall(r"\b(?:from|join)\s+([a-z_]+)", text))
    return sorted(names & set(TABLES))


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_private_names(text, rows_of, prefix="inspectlake"):
    """The text over temporary views of this library's own names, made by ``rows_of(table)``.

    A user's views that are named like the tables stay as they are.
    """
    names = tables_of(text)
    for source in names:
        rows_of(source).createOrReplaceTempView(f"_{prefix}_{source}")
    pattern = rf"\b(from|join)(\s+)({'|'.join(names)})\b"
    return re.sub(pattern, lambda m: f"{m[1]}{m[2]}_{prefix}_{m[3]}", text)


def fixture(spark, sf_dir, name, made=lambda rows: rows):
    """A derived input as a DataFrame over the tables in ``sf_dir``, each of them as ``made`` gives it."""
    return spark.sql(with_private_names(SQL[name], lambda source: made(table(spark, sf_dir, source))))


def with_fixtures(text, *names):
    """An oracle text with the named inputs as leading CTEs."""
    ctes = ",\n".join(f"{name} as ({SQL[name]})" for name in names)
    return f"with {ctes}\n{text}" if not text.lstrip().startswith(",") else f"with {ctes}{text}"
