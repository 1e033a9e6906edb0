"""Queries of the tabular and ledger operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tabular as op
from ..sources.tables import table
from . import base

_LEDGER_COLUMNS = ["id", "version", "name", "kind", "direction", "status", "statement_count", "environment"]


def _ledger(s, d):
    return table(s, d, "ddl_history").distinct()


def _fp_sql(t: str, cols: list[str]) -> str:
    text = " || chr(31) || ".join(f"coalesce(cast({c} as varchar), chr(0))" for c in cols)
    half = lambda i: f"sum(case when ('0x' || substr(h, {i}, 16))::ubigint::hugeint >= 9223372036854775808 then ('0x' || substr(h, {i}, 16))::ubigint::hugeint - 18446744073709551616 else ('0x' || substr(h, {i}, 16))::ubigint::hugeint end)"
    return f"select count(*) as n_rows, case when count(*) > 0 then md5(cast({half(1)} as hugeint)::varchar || ':' || cast({half(17)} as hugeint)::varchar) else '' end as checksum from (select md5({text}) as h from {t})"


def _files_of_ledger(s, d):
    last = op.ledger_state(_ledger(s, d)).where("environment = 'staging'").drop("environment")
    v = F.substring("version", -1, 1)
    return last.where(v != "3").select("version", F.when(v == "5", F.concat("name", F.lit("_x"))).otherwise(F.col("name")).alias("name"), F.when(v == "7", F.lit("changed")).otherwise(F.col("checksum")).alias("checksum"))


def _status(s, d):
    ledger = op.ledger_state(_ledger(s, d))
    return op.ledger_status(_files_of_ledger(s, d), ledger.where("environment = 'prod'").unionByName(ledger.where("environment = 'staging'")).groupBy("version").agg(F.max(F.struct("state", "name", "checksum")).alias("x")).select("version", "x.*"))


QUERIES = {
    "agg_profile_exact": lambda s, d: op.profile_exact(table(s, d, "ddl_history")),
    "agg_profile_estimated": lambda s, d: op.profile_estimated(table(s, d, "audit_log")),
    "agg_fingerprint": lambda s, d: op.fingerprint(table(s, d, "ddl_history"), _LEDGER_COLUMNS),
    "agg_data_diff": lambda s, d: op.data_diff(table(s, d, "ddl_history").select(*_LEDGER_COLUMNS), _ledger(s, d).select(*_LEDGER_COLUMNS)),
    "jn_full_outer_diff": lambda s, d: op.schema_diff(op.schema_rows({"t": table(s, d, "ddl_history")}), op.schema_rows({"t": table(s, d, "audit_log")})),
    "sql_schema_snapshot": lambda s, d: op.snapshot_id(op.schema_rows({n: table(s, d, n) for n in ("symbols", "edges", "files")})),
    "sql_schema_diff": lambda s, d: op.schema_diff(op.schema_rows({"symbols": table(s, d, "symbols")}), op.schema_rows({"symbols": table(s, d, "symbols").drop("line").withColumn("kind", F.lit(1))})),
    "sql_catalog": lambda s, d: op.schema_rows({n: table(s, d, n) for n in ("symbols", "edges", "files", "ddl_history", "audit_log", "documents")}).groupBy(F.split_part("name", F.lit("."), F.lit(1)).alias("table")).agg(F.sum((F.col("kind") == "column").cast("bigint")).alias("n_columns")),
    "set_multiset_diff": lambda s, d: op.multiset_diff(table(s, d, "audit_log").select("tool", "environment"), _audit_once(s, d).select("tool", "environment"), ["tool", "environment"]),
    "set_difference": lambda s, d: table(s, d, "audit_log").select("environment", "status").subtract(table(s, d, "ddl_history").select("environment", "status")),
    "set_intersection": lambda s, d: table(s, d, "files").select("repo_id").intersect(table(s, d, "documents").select("repo_id")),
    "set_union_distinct": lambda s, d: table(s, d, "files").select("repo_id").union(table(s, d, "documents").select("repo_id")).distinct(),
    "set_union_all": lambda s, d: table(s, d, "region").select(F.col("r_name").alias("x")).unionAll(table(s, d, "nation").select(F.col("n_name").alias("x"))),
    "set_dedupe_first": lambda s, d: table(s, d, "edges").groupBy("repo_id", "from_id", "to_id", "type").agg(F.min("edge_id").alias("edge_id")),
    "sink_upsert": lambda s, d: op.upsert(base.files(s, d).select("repo_id", "path", "content_hash"), base.files(s, d).where("language = 'sql'").select("repo_id", "path", F.lit("new").alias("content_hash")), ["repo_id", "path"]),
    "sink_upsert_nothing": lambda s, d: op.insert_missing(base.files(s, d).where("language = 'sql'").select("repo_id", "path", "content_hash"), base.files(s, d).select("repo_id", "path", F.lit("new").alias("content_hash")), ["repo_id", "path"]),
    "sink_run_retention": lambda s, d: _retained(s, d),
    "win_latest_version": lambda s, d: op.ledger_state(_ledger(s, d)).select("environment", "version", "state"),
    "sql_ddl_status": _status,
    "x_external_ledger": lambda s, d: _ledger(s, d).where("kind = 'adopted' and version is not null").select(F.regexp_extract("version", r"^(\d{4})", 1).alias("year"), "version", "checksum").distinct(),
    "x_recent_runs": lambda s, d: _ledger(s, d).orderBy(F.desc("applied_at"), F.desc("id")).limit(20).select("id", "status"),
    "x_last_work": lambda s, d: _ledger(s, d).where("statement_count > 0").groupBy("environment").agg(F.max(F.struct("applied_at", "id")).alias("x")).select("environment", "x.id"),
    "sql_ms_fanout": lambda s, d: _fanout(_ledger(s, d)),
    "agg_crossdb_targets": lambda s, d: _targets(s, d),
}


def _fanout(ledger):
    """The runs of each environment of the ledger, as if each were a catalog of its own."""
    names = sorted((r[0] for r in ledger.select("environment").distinct().collect()), key=lambda e: (e is None, e)) or [None]
    part = lambda e: ledger.where(F.col("environment").eqNullSafe(F.lit(e).cast("string")))
    return op.union_all([part(e).groupBy("direction").agg(F.count(F.lit(1)).alias("n")).withColumn("_catalog", F.lit(e).cast("string")) for e in names])


def _audit_once(s, d):
    return table(s, d, "audit_log").distinct()


def _retained(s, d):
    """The newest 50 runs of an environment and the newest that ran statements."""
    from pyspark.sql import Window

    runs = _ledger(s, d).select("environment", "id", "applied_at", "statement_count")
    order = [F.desc("applied_at"), F.desc("id")]
    rn = F.row_number().over(Window.partitionBy("environment").orderBy(*order))
    work = F.row_number().over(Window.partitionBy("environment", F.col("statement_count") > 1).orderBy(*order))
    return runs.withColumn("rn", rn).withColumn("w", F.when(F.col("statement_count") > 1, work)).where("rn <= 50 or w = 1").select("environment", "id")


def _targets(s, d):
    known = table(s, d, "audit_log").where("statement_type = 'CREATE' and target_table is not null").select(F.lower(F.split_part("target_table", F.lit("."), F.lit(1))).alias("db")).distinct().withColumn("known", F.lit(True))
    refs = table(s, d, "audit_log").where("target_table is not null").groupBy(F.lower(F.split_part("target_table", F.lit("."), F.lit(1))).alias("db")).agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct(F.lower("target_table")).alias("n_objects"))
    return refs.join(known, "db", "left").select("db", "n_refs", "n_objects", F.coalesce("known", F.lit(False)).alias("is_known"))


_LED = "with led as (select distinct * from ddl_history), st as (select environment, version, name, checksum, case when direction = 'up' then 'applied' else 'reverted' end as state from led where status = 'applied' and version is not null qualify row_number() over (partition by environment, version order by applied_at desc, id desc) = 1)"

SQL = {
    "agg_profile_exact": "select unnest([{}]) as r from ddl_history limit 0",
    "agg_fingerprint": _fp_sql("ddl_history", _LEDGER_COLUMNS),
    "agg_data_diff": f"with a as ({_fp_sql('ddl_history', sorted(_LEDGER_COLUMNS))}), b as ({_fp_sql('(select distinct * from ddl_history)', sorted(_LEDGER_COLUMNS))}) select '{','.join(sorted(_LEDGER_COLUMNS))}' as columns, a.n_rows as left_rows, b.n_rows as right_rows, a.checksum as left_checksum, b.checksum as right_checksum, a.checksum = b.checksum as identical from a, b",
    "set_multiset_diff": "with a as (select tool, environment, count(*) as n from audit_log group by 1, 2), b as (select tool, environment, count(*) as n from (select distinct * from audit_log) group by 1, 2) select tool, environment, coalesce(a.n, 0) as in_a, coalesce(b.n, 0) as in_b from a full join b using (tool, environment) where coalesce(a.n, 0) <> coalesce(b.n, 0)",
    "set_difference": "select environment, status from audit_log except select environment, status from ddl_history",
    "set_intersection": "select repo_id from files intersect select repo_id from documents",
    "set_union_distinct": "select repo_id from files union select repo_id from documents",
    "set_union_all": "select r_name as x from region union all select n_name from nation",
    "set_dedupe_first": "select repo_id, from_id, to_id, type, min(edge_id) as edge_id from edges group by 1, 2, 3, 4",
    "sink_upsert": "with " + base.FIL + " select repo_id, path, case when language = 'sql' then 'new' else content_hash end as content_hash from fil",
    "sink_upsert_nothing": "with " + base.FIL + " select repo_id, path, case when language = 'sql' then content_hash else 'new' end as content_hash from fil",
    "sink_run_retention": "with led as (select distinct environment, id, applied_at, statement_count from ddl_history), r as (select *, row_number() over (partition by environment order by applied_at desc, id desc) as rn, case when statement_count > 1 then row_number() over (partition by environment, statement_count > 1 order by applied_at desc, id desc) end as w from led) select environment, id from r where rn <= 50 or w = 1",
    "win_latest_version": _LED + " select environment, version, state from st",
    "sql_ddl_status": _LED + """, l as (select version, max({'state': state, 'name': name, 'checksum': checksum}) as x from st where environment in ('prod', 'staging') group by 1),
        up as (select version, x.name as name, x.checksum as checksum from l where x.state = 'applied'),
        f as (select version, case when right(version, 1) = '5' then name || '_x' else name end as fname, case when right(version, 1) = '7' then 'changed' else checksum end as fsum from st where environment = 'staging' and right(version, 1) <> '3')
        select coalesce(f.version, up.version) as version, case when f.version is null then 'missing' when up.version is not null and fsum <> checksum then 'checksum_mismatch' when up.version is not null and fname <> name then 'renamed' when up.version is not null then 'applied' when f.version < (select max(version) from up) then 'out_of_order' else 'pending' end as status
        from f full join up on f.version = up.version""",
    "x_external_ledger": "select distinct substr(version, 1, 4) as year, version, checksum from ddl_history where kind = 'adopted' and version is not null",
    "x_recent_runs": "select id, status from (select distinct * from ddl_history) order by applied_at desc, id desc limit 20",
    "x_last_work": "select environment, arg_max(id, {'a': applied_at, 'i': id}) as id from ddl_history where statement_count > 0 group by 1",
    "sql_ms_fanout": "select direction, count(*) as n, environment as _catalog from (select distinct * from ddl_history) group by 1, 3",
    "agg_crossdb_targets": "with k as (select distinct lower(split_part(target_table, '.', 1)) as db from audit_log where statement_type = 'CREATE' and target_table is not null) select lower(split_part(target_table, '.', 1)) as db, count(*) as n_refs, count(distinct lower(target_table)) as n_objects, lower(split_part(target_table, '.', 1)) in (select db from k) as is_known from audit_log where target_table is not null group by 1",
}
_PROFILED = "id version name kind direction checksum up_checksum execution_mode status statement_count failed_statement error_sqlstate environment applied_by preview_id duration_ms applied_at".split()
SQL["agg_profile_exact"] = " union all ".join(f"select '{c}' as column, count(*) as n_rows, count(*) - count({c}) as n_null, count(distinct {c}) as n_distinct from ddl_history" for c in _PROFILED)
