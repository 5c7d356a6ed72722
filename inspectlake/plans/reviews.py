"""Queries over review events, approvals and logs."""

from inspectlake.fixtures import fixture, with_fixtures
from inspectlake.operators import mapping as M
from inspectlake.operators import projects as P
from inspectlake.operators import review as R
from inspectlake.plans.common import MATCHED, RENAMED, merged_extraction


def _events(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_review_event")


def _projects(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_project").select("project_id")


def approval_status(spark, sf_dir):
    return R.approval_status(_events(spark, sf_dir))


def approval_default(spark, sf_dir):
    return R.approval_default(_projects(spark, sf_dir), approval_status(spark, sf_dir))


def approval_gate(spark, sf_dir):
    fields = fixture(spark, sf_dir, "fx_form_field")
    summary = M.mapping_summary(
        M.match_fields(fields, merged_extraction(spark, sf_dir), M.alias_table(spark))
    ).select("project_id", "n_mapped", "n_unmapped", "evidence")
    return R.approval_gate(_projects(spark, sf_dir), approval_status(spark, sf_dir), summary)


def review_overlay(spark, sf_dir):
    return R.review_overlay(merged_extraction(spark, sf_dir), _events(spark, sf_dir))


def latest_artifact(spark, sf_dir):
    return P.latest_artifact(fixture(spark, sf_dir, "fx_artifact"))


def project_status(spark, sf_dir):
    return P.project_status(fixture(spark, sf_dir, "fx_log"))


def stage_log_rollup(spark, sf_dir):
    return P.stage_log_rollup(fixture(spark, sf_dir, "fx_log"))


QUERIES = {
    "approval_status": approval_status,
    "approval_default": approval_default,
    "approval_gate": approval_gate,
    "review_overlay": review_overlay,
    "latest_artifact": latest_artifact,
    "project_status": project_status,
    "stage_log_rollup": stage_log_rollup,
}

STATUS = """, statuses as (select project_id, action as approval_status from fx_review_event where action in ('approved', 'rejected')
 qualify row_number() over (partition by project_id order by seq desc) = 1)
"""

ORACLES = {
    "approval_status": with_fixtures(STATUS + "select * from statuses", "fx_review_event"),
    "approval_default": with_fixtures(
        STATUS + "select p.project_id, coalesce(approval_status, 'pending') as approval_status from fx_project p left join statuses s on s.project_id = p.project_id",
        "fx_review_event", "fx_project",
    ),
    "approval_gate": with_fixtures(
        MATCHED
        + STATUS
        + """, summary as (select project_id, count(*) filter (where found) as n_mapped, count(*) filter (where not found) as n_unmapped from matched group by project_id)
select p.project_id, coalesce(approval_status, 'pending') as approval_status,
 case when approval_status = 'approved' then coalesce(n_mapped, 0) else 0 end as n_mapped,
 case when approval_status = 'approved' then coalesce(n_unmapped, 0) else 0 end as n_unmapped,
 cast(case when approval_status = 'approved' then 0.9 else 0.0 end as double) as confidence_score,
 case when approval_status = 'approved' then 'Mapped ' || coalesce(n_mapped, 0) || ' fields' else 'Awaiting user approval' end as evidence
 from fx_project p left join statuses s on s.project_id = p.project_id left join summary m on m.project_id = p.project_id""",
        "fx_extracted", "fx_form_field", "fx_review_event", "fx_project",
    ),
    "review_overlay": with_fixtures(
        RENAMED
        + """, edits as (select project_id, field_name as "key", new_value from fx_review_event where action = 'edit'
 qualify row_number() over (partition by project_id, field_name order by seq desc) = 1)
select coalesce(m.project_id, e.project_id) as project_id, coalesce(m."key", e."key") as "key",
 case when e.project_id is not null then new_value else value end as value, e.project_id is not null as edited
 from merged m full join edits e on e.project_id = m.project_id and e."key" = m."key" """,
        "fx_extracted", "fx_review_event",
    ),
    "latest_artifact": with_fixtures(
        "select * from fx_artifact qualify row_number() over (partition by project_id, artifact order by write_seq desc) = 1", "fx_artifact"
    ),
    "project_status": with_fixtures(
        "select project_id, status from fx_log qualify row_number() over (partition by project_id order by seq desc) = 1", "fx_log"
    ),
    "stage_log_rollup": with_fixtures(
        """select step, status, grouping(step, status) as grouping_id, count(*) as n, count(error) as n_errors, cast(sum(duration_ms) as bigint) as total_ms, round(avg(duration_ms), 6) as avg_ms
 from fx_log group by rollup(step, status)""",
        "fx_log",
    ),
}
