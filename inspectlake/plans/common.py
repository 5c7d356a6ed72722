"""Shared pieces of the registered queries."""

from pyspark.sql import functions as F

from inspectlake.fixtures import fixture, with_fixtures
from inspectlake.functions.envelope import parse_envelope
from inspectlake.operators.merge import last_wins_merge, rename_keys

# The JSON text of a raw response, on the oracle's side.
UNFENCED = (
    "regexp_replace(regexp_replace(regexp_replace(raw_response, '^```json\\s*', ''),"
    " '\\s*```\\s*$', ''), '^\\s+|\\s+$', '', 'g')"
)


def normalized(source):
    """CTEs that add ``j``, the normalized text, to a response input."""
    return f""", unfenced as (select *, {UNFENCED} as u from {source}),
norm as (select *, case when regexp_matches(u, '(?s)\\{{.*\\}}') then regexp_extract(u, '(?s)\\{{.*\\}}') else u end as j from unfenced),
parsed as (select *, json_valid(j) as ok, case when json_valid(j) then lower(json_type(j)) end as kind from norm)
"""


# The error of the failing texts in the inputs, on the oracle's side.
PARSE_ERROR = (
    "case when j like '{\"room\": \"a\"} and%' then 'Extra data: line 1 column 15 (char 14)'"
    " else 'Expecting value: line 1 column 1 (char 0)' end"
)


def given(key, default):
    """``j.key`` on the oracle's side, the default only when absent."""
    return f"case when json_exists(j, '$.{key}') then j->>'$.{key}' else {default} end"


def all_cores(rows, key):
    """Rows of a small scan dealt over all cores before costly Python work.

    A scan that already has that many partitions stays as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def envelopes(spark, sf_dir, name="fx_response"):
    return parse_envelope(all_cores(fixture(spark, sf_dir, name), "resp_id"))


def joined(col, sep=","):
    return F.array_join(col, sep)


def merged_extraction(spark, sf_dir):
    """The last value of every project and key of ``fx_extracted``."""
    return last_wins_merge(rename_keys(fixture(spark, sf_dir, "fx_extracted")))


# The same on the oracle's side, as CTEs after fx_extracted.
RENAMED = """, renamed as (
 select project_id, phase, ord, value,
  case when phase < 3 and src_key in ('owner_name', 'inspection_date') then src_key
       when phase < 3 and src_key = 'property_address' then 'address'
       when phase = 3 and src_key = 'overall_condition' then 'building_condition'
       when phase = 3 and src_key = 'visible_damage' then 'damage' end as "key" from fx_extracted),
merged as (select project_id, "key", value from renamed where "key" is not null
 qualify row_number() over (partition by project_id, "key" order by phase desc, ord desc) = 1)
"""

# The alias table and the form fields matched to the merged values.
ALIASES = """, aliases(norm, canonical, priority, ord) as (values
 ('owner_name','owner_name',0,0),('owner','owner_name',0,1),('property_owner','owner_name',0,2),('client_name','owner_name',0,3),('name','owner_name',0,4),
 ('address','address',1,0),('property_address','address',1,1),('location','address',1,2),('site_address','address',1,3),
 ('roof_type','roof_type',2,0),('roof','roof_type',2,1),('roofing','roof_type',2,2),('roof_material','roof_type',2,3),
 ('wall_type','wall_type',3,0),('wall','wall_type',3,1),('walls','wall_type',3,2),('wall_material','wall_type',3,3),
 ('building_condition','building_condition',4,0),('condition','building_condition',4,1),('building_status','building_condition',4,2),('overall_condition','building_condition',4,3),
 ('damage','damage',5,0),('damage_type','damage',5,1),('damage_description','damage',5,2),('issues','damage',5,3))
"""
NORM_NAME = "replace(replace(lower(name), ' ', '_'), '-', '_')"
MATCHED = f"""{RENAMED}{ALIASES}, matched as (
 select f.project_id, f.ord, f.form_id, f.name, a.canonical as canonical_name, m.value, m.project_id is not null as found
 from fx_form_field f left join aliases a on a.norm = {NORM_NAME.replace('name)', 'f.name)')}
 left join merged m on m.project_id = f.project_id and m."key" = a.canonical)
"""


def matched_sql(text):
    return with_fixtures(MATCHED + text, "fx_extracted", "fx_form_field")
