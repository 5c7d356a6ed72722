"""Queries over model responses and image analyses."""

from pyspark.sql import functions as F

from inspectlake import settings as S
from inspectlake.fixtures import fixture, with_fixtures
from inspectlake.functions import text as T
from inspectlake.functions.envelope import parse_envelope as parse_answers
from inspectlake.functions.envelope import parse_llm_response as parse_plain
from inspectlake.operators import images as I
from inspectlake.operators import records as R
from inspectlake.operators.review import review_view as view
from inspectlake.plans.common import PARSE_ERROR, all_cores, envelopes, given, joined, normalized

def normalize_response(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_response").select(
        "resp_id", T.normalize_response(F.col("raw_response")).alias("normalized")
    )


def parse_envelope(spark, sf_dir):
    return envelopes(spark, sf_dir).select(
        "resp_id",
        "success",
        "kind",
        F.when(F.col("data").isNotNull(), F.size("data").cast("bigint")).alias("n_keys"),
        F.try_element_at("data", F.lit("room")).alias("room"),
        F.map_contains_key("data", "room").alias("has_room"),
        joined(F.array_sort(F.map_keys("data"))).alias("keys"),
        joined(F.transform(F.array_sort(F.map_keys("data")), lambda k: F.coalesce(F.try_element_at("data", k), F.lit("null"))), "|").alias("values"),
        "error",
    )


def parse_llm_response(spark, sf_dir):
    rows = parse_plain(all_cores(fixture(spark, sf_dir, "fx_response"), "resp_id"))
    return rows.select(
        "resp_id",
        "success",
        "kind",
        F.try_element_at("data", F.lit("error")).alias("error"),
        F.try_element_at("data", F.lit("raw_response")).alias("kept_response"),
        F.try_element_at("data", F.lit("confidence")).alias("confidence"),
    )


def split_success(spark, sf_dir):
    return R.with_part(envelopes(spark, sf_dir)).select("resp_id", "part")


def image_record(spark, sf_dir):
    return R.image_record(envelopes(spark, sf_dir)).drop("kinds")


def image_default_record(spark, sf_dir):
    return R.image_default_record(envelopes(spark, sf_dir)).drop("kinds")


def exception_record(spark, sf_dir):
    return R.exception_record(envelopes(spark, sf_dir))


def evidence_text(spark, sf_dir):
    records = R.image_records(envelopes(spark, sf_dir))
    return records.select(
        "resp_id",
        "evidence",
        T.extracted_from(F.col("image_name")).alias("llm_evidence"),
        T.processed_pages(F.col("resp_id")).alias("pages_evidence"),
        T.mapped_from(F.col("image_name")).alias("mapped_evidence"),
        T.mapped_count(F.col("resp_id")).alias("count_evidence"),
    )


def resize_plan(spark, sf_dir):
    return I.resize_plan(fixture(spark, sf_dir, "fx_image_dim"))


def _analyses(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_image_analysis").withColumn(
        "visible_damage", F.filter(F.split("visible_damage_csv", ","), lambda d: d != "")
    )


def confidence_queue(spark, sf_dir):
    return I.confidence_queue(fixture(spark, sf_dir, "fx_image_analysis"), column="confidence")


def vocab_check(spark, sf_dir):
    """Responses with the stated values, parsed, recorded and checked."""
    stated = F.struct("overall_condition", "visible_damage", "building_area", "mini_caption", "confidence")
    rows = _analyses(spark, sf_dir).select("image_id", "project_id", "visible_damage_csv", F.concat(F.lit("img_"), "image_id").alias("image_name"), F.to_json(stated).alias("raw_response"))
    records = R.list_view(R.image_records(parse_answers(rows), checked=True), ["visible_damage"])
    flags = ("bad_condition", "bad_area", "bad_damage", "bad_confidence", "long_caption")
    return I.vocab_check(records).select("image_id", "project_id", "overall_condition", "visible_damage_csv", "building_area", "mini_caption", "confidence", *flags)


def review_view(spark, sf_dir):
    # One condition is given as null, one area is not given at all.
    rows = _analyses(spark, sf_dir).withColumns(
        {"overall_condition": F.nullif("overall_condition", F.lit("Broken")), "area": F.col("building_area")}
    )
    every = F.create_map(*[F.lit(k) for k in ("overall_condition", "", "area", "", "mini_caption", "")])
    keys = F.map_filter(every, lambda k, v: (k != "area") | (F.col("building_area") != "spaceship"))
    shown = view(rows.withColumn("keys", keys), ["overall_condition", "area", "mini_caption", "notes"], ["visible_damage"], "keys")
    return shown.select("image_id", "overall_condition", "area", "mini_caption", "notes", "visible_damage")


QUERIES = {
    "normalize_response": normalize_response,
    "parse_envelope": parse_envelope,
    "parse_llm_response": parse_llm_response,
    "split_success": split_success,
    "image_record": image_record,
    "image_default_record": image_default_record,
    "exception_record": exception_record,
    "evidence_text": evidence_text,
    "resize_plan": resize_plan,
    "confidence_queue": confidence_queue,
    "vocab_check": vocab_check,
    "review_view": review_view,
}

N = normalized("fx_response")


def _response(text):
    return with_fixtures(N + text, "fx_response")


def _words(words):
    return ", ".join(f"'{w}'" for w in words)


ORACLES = {
    "normalize_response": _response("select resp_id, j as normalized from parsed"),
    "parse_envelope": _response(
        """select resp_id, ok as success, kind, case when kind = 'object' then cast(len(json_keys(j)) as bigint) end as n_keys,
 case when kind = 'object' then j->>'$.room' end as room, case when kind = 'object' then json_exists(j, '$.room') end as has_room,
 case when kind = 'object' then array_to_string(list_sort(json_keys(j)), ',') end as keys,
 case when kind = 'object' then array_to_string(list_transform(list_sort(json_keys(j)), lambda k: coalesce(json_extract_string(j, '$.' || k), 'null')), '|') end as values,
 case when not ok then 'JSON parsing failed: ' || """ + PARSE_ERROR + """ end as error from parsed"""
    ),
    "parse_llm_response": _response(
        """select resp_id, json_valid(raw_response) as success, case when json_valid(raw_response) then lower(json_type(raw_response)) end as kind,
 case when not json_valid(raw_response) then 'Failed to parse JSON' end as error, case when not json_valid(raw_response) then raw_response end as kept_response,
 case when json_valid(raw_response) and json_type(raw_response) = 'OBJECT' then raw_response->>'$.confidence' end as confidence from parsed"""
    ),
    "split_success": _response("select resp_id, case when ok then 'ok' else 'failed' end as part from parsed"),
    "image_record": _response(
        f"""select resp_id, project_id, image_name, {given('room', "'unknown'")} as room, {given('category', "'unknown'")} as category,
 {given('view', "'unknown'")} as view, {given('overall_condition', "'unknown'")} as overall_condition, {given('caption', "''")} as caption,
 {given('mini_caption', "''")} as mini_caption, {given('notes', "''")} as notes, {given('materials', "'[]'")} as materials, {given('systems', "'[]'")} as systems,
 {given('visible_damage', "'[]'")} as visible_damage, {given('objects', "'[]'")} as objects, coalesce(cast(j->>'$.confidence' as double), 0.0) as confidence_score,
 'Analyzed ' || image_name as evidence from parsed where ok and kind = 'object'"""
    ),
    "image_default_record": _response(
        """select resp_id, project_id, image_name, 'unknown' as room, 'unknown' as category, 'unknown' as view, 'unknown' as overall_condition,
 '' as caption, '' as mini_caption, '' as notes, '[]' as materials, '[]' as systems, '[]' as visible_damage, '[]' as objects,
 cast(0.0 as double) as confidence_score, 'Error: JSON parsing failed: ' || """ + PARSE_ERROR + """ as evidence from parsed where not ok"""
    ),
    "exception_record": _response(
        """select resp_id, project_id, image_name, '''list'' object has no attribute ''get''' as error, cast(0.0 as double) as confidence_score, '' as evidence
 from parsed where ok and kind <> 'object'"""
    ),
    "evidence_text": _response(
        """select resp_id, case when not ok then 'Error: JSON parsing failed: ' || """ + PARSE_ERROR + """ when kind = 'object' then 'Analyzed ' || image_name else '' end as evidence,
 'Extracted via LLM from ' || image_name as llm_evidence, 'Processed ' || resp_id || ' pages' as pages_evidence,
 'Mapped from ' || image_name as mapped_evidence, 'Mapped ' || resp_id || ' fields' as count_evidence from parsed"""
    ),
    "resize_plan": with_fixtures(
        """select *, case when greatest(width, height) > 1280 then cast(trunc(width * (1280.0::double / greatest(width, height)::double)) as int) else width end as new_width,
 case when greatest(width, height) > 1280 then cast(trunc(height * (1280.0::double / greatest(width, height)::double)) as int) else height end as new_height from fx_image_dim""",
        "fx_image_dim",
    ),
    "confidence_queue": with_fixtures("select * from fx_image_analysis where confidence < 0.8", "fx_image_analysis"),
    "vocab_check": with_fixtures(
        f"""select *, overall_condition not in ({_words(S.CONDITIONS)}) as bad_condition, building_area not in ({_words(S.AREAS)}) as bad_area,
 len(list_filter(string_split(visible_damage_csv, ','), lambda d: d <> '' and d not in ({_words(S.DAMAGE)}))) > 0 as bad_damage,
 confidence < 0 or confidence > 1 as bad_confidence,
 len(list_filter(string_split_regex(trim(mini_caption), '\\s+'), lambda w: w <> '')) > 6 as long_caption from fx_image_analysis""",
        "fx_image_analysis",
    ),
    "review_view": with_fixtures(
        """select image_id, nullif(overall_condition, 'Broken') as overall_condition, case when building_area = 'spaceship' then 'N/A' else building_area end as area, mini_caption,
 'N/A' as notes,
 coalesce(nullif(replace(visible_damage_csv, ',', ', '), ''), 'N/A') as visible_damage from fx_image_analysis""",
        "fx_image_analysis",
    ),
}
