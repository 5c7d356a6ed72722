"""Queries that merge sources and map values to form fields."""

from pyspark.sql import functions as F

from inspectlake.fixtures import fixture, with_fixtures
from inspectlake.functions import text as T
from inspectlake.operators import mapping as M
from inspectlake.operators import merge as G
from inspectlake.plans.common import NORM_NAME, RENAMED, matched_sql, merged_extraction


def union_sources(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_extracted")
    parts = [rows.filter(F.col("phase") == n).drop("phase") for n in (1, 2, 3)]
    return G.union_sources(*parts)


def rename_keys(spark, sf_dir):
    return G.rename_keys(fixture(spark, sf_dir, "fx_extracted"))


def last_wins_merge(spark, sf_dir):
    return merged_extraction(spark, sf_dir)


def normalize_field_name(spark, sf_dir):
    fields = fixture(spark, sf_dir, "fx_form_field")
    return fields.select("project_id", "ord", "name", T.normalize_field_name(F.col("name")).alias("norm"))


def _fields(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_form_field")


def alias_join(spark, sf_dir):
    named = M.alias_join(_fields(spark, sf_dir), M.alias_table(spark))
    return named.filter("canonical_name is not null").select("project_id", "ord", "name", "canonical_name")


def aliases_of(spark, sf_dir):
    aliases = M.alias_table(spark)
    named = M.alias_join(_fields(spark, sf_dir), aliases)
    listed = M.aliases_of(named, aliases)
    return listed.select(
        "project_id", "ord", "canonical_name", F.array_join("aliases", ",").alias("aliases")
    )


def map_fields(spark, sf_dir):
    mapped = M.map_fields(_fields(spark, sf_dir), merged_extraction(spark, sf_dir), M.alias_table(spark))
    return mapped.select(
        "project_id", "ord", "form_id", "name", "canonical_name", F.array_join("aliases", ",").alias("aliases"), "value", "confidence_score", "evidence"
    )


def _matched(spark, sf_dir):
    return M.match_fields(_fields(spark, sf_dir), merged_extraction(spark, sf_dir), M.alias_table(spark))


def unmapped_fields(spark, sf_dir):
    return M.unmapped_fields(_matched(spark, sf_dir))


def first_unmapped(spark, sf_dir):
    return M.first_unmapped(_matched(spark, sf_dir)).withColumn("rn", F.col("rn").cast("bigint"))


def mapping_summary(spark, sf_dir):
    return M.mapping_summary(_matched(spark, sf_dir))


def fill_plan(spark, sf_dir):
    return M.fill_plan(_matched(spark, sf_dir), "ord % 5 <> 0")


QUERIES = {
    "union_sources": union_sources,
    "rename_keys": rename_keys,
    "last_wins_merge": last_wins_merge,
    "normalize_field_name": normalize_field_name,
    "alias_join": alias_join,
    "aliases_of": aliases_of,
    "map_fields": map_fields,
    "unmapped_fields": unmapped_fields,
    "first_unmapped": first_unmapped,
    "mapping_summary": mapping_summary,
    "fill_plan": fill_plan,
}

ORACLES = {
    "union_sources": with_fixtures("select project_id, ord, src_key, value, phase from fx_extracted", "fx_extracted"),
    "rename_keys": with_fixtures(
        RENAMED + 'select project_id, ord, phase, value, "key" from renamed where "key" is not null', "fx_extracted"
    ),
    "last_wins_merge": with_fixtures(RENAMED + "select * from merged", "fx_extracted"),
    "normalize_field_name": with_fixtures(
        f"select project_id, ord, name, {NORM_NAME} as norm from fx_form_field", "fx_form_field"
    ),
    "alias_join": matched_sql(
        "select project_id, ord, name, canonical_name from matched where canonical_name is not null"
    ),
    "aliases_of": matched_sql(
        """select project_id, ord, canonical_name, coalesce((select string_agg(norm, ',' order by a.ord) from aliases a
 where a.canonical = m.canonical_name and a.norm <> a.canonical), '') as aliases from matched m"""
    ),
    "map_fields": matched_sql(
        """select project_id, ord, form_id, name, canonical_name, (select string_agg(norm, ',' order by a.ord) from aliases a
 where a.canonical = m.canonical_name and a.ord > 0) as aliases, value, cast(0.9 as double) as confidence_score, 'Mapped from ' || name as evidence
 from matched m where found"""
    ),
    "unmapped_fields": matched_sql("select project_id, ord, name from matched where not found"),
    "first_unmapped": matched_sql(
        """select * from (select project_id, ord, name, row_number() over (partition by project_id order by ord) as rn
 from matched where not found) where rn <= 5"""
    ),
    "mapping_summary": matched_sql(
        """select project_id, count(*) filter (where found) as n_mapped, count(*) filter (where not found) as n_unmapped,
 cast(0.9 as double) as confidence_score, 'Mapped ' || count(*) filter (where found) || ' fields' as evidence from matched group by project_id"""
    ),
    "fill_plan": matched_sql(
        """select project_id, name, '[name=''' || name || ''']' as selector, coalesce(arg_min_null(value, ord), 'None') as fill_value
 from matched where found group by project_id, name having bool_or(ord % 5 <> 0)"""
    ),
}
