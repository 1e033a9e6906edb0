"""Queries of the log operators over events and audit_log, and their SQL.

events are log rows (severity and context = event_type, service by user, body = props); audit_log rows are spans
of the tools and logs of their environments.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..operators import logs as op
from ..sources.tables import table

A, B = datetime(2024, 1, 10, tzinfo=timezone.utc), datetime(2024, 1, 17, tzinfo=timezone.utc)
_SENTINEL = "svc0"


def _logs(s, d):
    user = F.col("user_id")
    name = F.concat(F.lit("svc"), F.pmod(user, F.lit(7)).cast("string"))
    return table(s, d, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("severity"), name.alias("service_name"),
        F.when(F.pmod(user, F.lit(3)) == 0, F.concat(F.lit("app"), F.pmod(user, F.lit(5)).cast("string"))).alias("app"),
        F.when(F.col("event_type") != "view", F.concat(F.col("event_type"), F.lit("."), name)).alias("context"), F.col("props").alias("body"), "value",
    )


def _spans(s, d):
    return table(s, d, "audit_log").select("id", F.col("tool").alias("service"), F.col("ts").alias("start_at"), F.col("sql_hash").alias("traceid"), "environment", "status")


def _service(s, d):
    df = _logs(s, d)
    return df, op.service(df, _SENTINEL)


def _inventory(s, d):
    df, name = _service(s, d)
    return op.service_inventory(df, name)


def _contexts(s, d, with_service=False):
    df, name = _service(s, d)
    return op.contexts(df.withColumn("service", name), with_service)


def _shaped(s, d):
    df = table(s, d, "documents").select("doc_id", F.col("text").alias("message"), F.col("text").alias("exception"))
    return op.shape(df, 30, 60)


def _catalog(s, d):
    a = table(s, d, "audit_log").groupBy(F.col("environment").alias("service"), F.lit("logs").alias("lane"), F.col("status").alias("environment"), F.col("target_table").alias("context")).agg(F.count(F.lit(1)).alias("n"))
    b = table(s, d, "audit_log").groupBy(F.split_part(F.col("target_table"), F.lit("."), F.lit(1)).alias("service"), F.lit("traces").alias("lane"), F.col("environment"), F.lit(None).cast("string").alias("context")).agg(F.count(F.lit(1)).alias("n"))
    return op.catalog(a.unionByName(b).where("service is not null"))


QUERIES = {
    "agg_service_inventory": _inventory,
    "agg_identity_source": lambda s, d: _inventory(s, d).select("service", op.identity_source(F.col("by_resource"), F.col("by_enricher")).alias("source")),
    "agg_log_stats": lambda s, d: op.stats(_logs(s, d), "severity"),
    "agg_log_stats_by_service": lambda s, d: op.stats(*_service(s, d)),
    "agg_trace_inventory": lambda s, d: op.trace_inventory(_spans(s, d)),
    "agg_context_inventory": lambda s, d: _contexts(s, d),
    "agg_service_context_matrix": lambda s, d: _contexts(s, d, True),
    "agg_namespace_rollup": lambda s, d: op.namespace_rollup(_contexts(s, d), ["click."], 1),
    "agg_service_catalog": _catalog,
    "agg_field_census": lambda s, d: op.field_census(table(s, d, "audit_log"), "detail"),
    "flt_time_window": lambda s, d: op.in_window(_logs(s, d), "at", A, B).select("id", "at"),
    "flt_log_level": lambda s, d: op.level(_logs(s, d), "err%").select("id", "severity"),
    "flt_log_contains": lambda s, d: _logs(s, d).where(F.col("body").contains("7}")).select("id", "body"),
    "flt_log_service": lambda s, d: (lambda df, n: df.where(n == "app1").select("id"))(*_service(s, d)),
    "flt_log_context": lambda s, d: _logs(s, d).where(F.col("context") == "error.svc3").select("id"),
    "flt_trace_id": lambda s, d: op.trace(_spans(s, d), "0e108395378253b2", "start_at").select("id", "traceid"),
    "prj_columns": lambda s, d: op.project(_logs(s, d), ["id", "severity", "missing"]),
    "prj_pick": lambda s, d: (lambda df: df.select("id", op.pick(df, "missing", "app", "service_name").alias("name")))(_logs(s, d)),
    "prj_service_identity": lambda s, d: (lambda df, n: df.select("id", n.alias("service")))(*_service(s, d)),
    "prj_shape_profile": _shaped,
    "jn_lanes": lambda s, d: op.lanes(table(s, d, "ddl_history").select(F.col("environment").alias("service")), table(s, d, "audit_log").where("tool = 'ddl_apply' and status = 'failed'").select(F.col("environment").alias("service"))),
    "x_log_sample": lambda s, d: _logs(s, d).orderBy(F.desc("at"), F.desc("id")).limit(50).select("id", "severity"),
    "st_tail": lambda s, d: op.tail(_logs(s, d), B, 15).select("id", "at"),
    "lim_clamp": lambda s, d: op.stats(_logs(s, d), "context", 5000),
}

_L = """with lg as (
    select event_id as id, ts as "at", event_type as severity, 'svc' || (user_id % 7) as service_name, case when user_id % 3 = 0 then 'app' || (user_id % 5) end as app,
           case when event_type <> 'view' then event_type || '.svc' || (user_id % 7) end as context, props as body from events),
    nm as (select *, coalesce(nullif(service_name, 'svc0'), nullif(app, ''), service_name) as service from lg)"""

SQL = {
    "agg_service_inventory": _L + " select service, count(*) as n, min(\"at\") as first_at, max(\"at\") as last_at, count(*) filter (upper(severity) like 'ERR%') as errors, count(*) filter (upper(severity) like 'WARN%') as warnings, count(distinct context) as contexts, count(service_name) as by_resource, count(app) as by_enricher from nm group by 1",
    "agg_identity_source": _L + " select service, case when count(service_name) > 0 and count(app) > 0 then 'mixed' when count(service_name) > 0 then 'resource' when count(app) > 0 then 'enricher' end as source from nm group by 1",
    "agg_log_stats": "select event_type as key, count(*) as n from events group by 1",
    "agg_log_stats_by_service": _L + " select service as key, count(*) as n from nm group by 1",
    "agg_trace_inventory": "select tool as service, count(*) as spans, min(ts) as first_at, max(ts) as last_at from audit_log group by 1",
    "agg_context_inventory": _L + " select context, count(*) as n from nm where context is not null group by 1",
    "agg_service_context_matrix": _L + " select service, context, count(*) as n from nm where context is not null group by 1, 2",
    "agg_namespace_rollup": _L + " select split_part(context, '.', 1) as root, count(*) as n from nm where context is not null and context not like 'click.%' group by 1",
    "agg_service_catalog": """with inv as (
        select environment as service, 'logs' as lane, status as environment, target_table as context from audit_log
        union all select split_part(target_table, '.', 1), 'traces', environment, null from audit_log where target_table is not null),
        own as (select service, array_to_string(list_sort(list(distinct lane)), ',') as lanes, array_to_string(list_sort(list(distinct environment)), ',') as environments,
            coalesce(array_to_string(list_sort(list(distinct context) filter (context is not null)), ','), '') as own, count(*) as n from inv where service is not null group by 1),
        lent as (select split_part(context, '.', 1) as service, array_to_string(list_sort(list(distinct context)), ',') as lent from inv where context is not null group by 1)
        select service, lanes, environments, case when own <> '' then own else coalesce(lent, '') end as contexts, n from own left join lent using (service)""",
    "agg_field_census": """with j as (select detail, unnest(json_keys(detail)) as field from audit_log where detail is not null)
        select field, array_to_string(list_sort(list(distinct case json_type(detail, '$."' || field || '"') when 'VARCHAR' then 'string' when 'UBIGINT' then 'number' when 'BIGINT' then 'number' when 'DOUBLE' then 'number' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'null' end)), ',') as types,
               count(*) filter (json_type(detail, '$."' || field || '"') <> 'NULL') as non_null from j group by 1""",
    "flt_time_window": "select event_id as id, ts as at from events where ts >= '2024-01-10' and ts < '2024-01-17'",
    "flt_log_level": "select event_id as id, event_type as severity from events where upper(event_type) like 'ERR%'",
    "flt_log_contains": "select event_id as id, props as body from events where contains(props, '7}')",
    "flt_log_service": _L + " select id from nm where service = 'app1'",
    "flt_log_context": _L + " select id from nm where context = 'error.svc3'",
    "flt_trace_id": "select id, sql_hash as traceid from audit_log where sql_hash = '0e108395378253b2'",
    "prj_columns": "select event_id as id, event_type as severity from events",
    "prj_pick": _L + " select id, coalesce(nullif(app, ''), service_name) as name from nm",
    "prj_service_identity": _L + " select id, service from nm",
    "prj_shape_profile": """with y as (select doc_id, text as m, case when length(text) > 60 then substr(text, 1, 60) || '…[+' || (length(text) - 60) || ' chars]' else text end as exception from documents)
        select doc_id, case when strpos(coalesce(exception, ''), m) > 0 then null when length(m) > 30 then substr(m, 1, 30) || '…[+' || (length(m) - 30) || ' chars]' else m end as message, exception from y""",
    "jn_lanes": "with a as (select distinct environment as service from ddl_history), b as (select distinct environment as service from audit_log where tool = 'ddl_apply' and status = 'failed') select coalesce(a.service, b.service) as service, concat_ws(',', case when a.service is not null then 'logs' end, case when b.service is not null then 'traces' end) as lanes from a full join b on a.service = b.service",
    "x_log_sample": "select event_id as id, event_type as severity from events order by ts desc, event_id desc limit 50",
    "st_tail": "select event_id as id, ts as at from events where ts >= '2024-01-16 23:45:00' and ts < '2024-01-17' order by ts desc, event_id desc limit 100",
    "lim_clamp": _L + " select context as key, count(*) as n from nm group by 1",
}
