"""Queries of remote sources, git output, the guarded SQL surface and ledger plans, and their SQL.

What the data folder does not hold (git output, statements of users, texts with NUL) comes from small tables given here
as text, to which the folder's own rows are added where they are of the same kind.
"""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import sqlguard
from ..operators import tabular as tab
from ..operators.logs import trace
from ..session import Scratch
from ..sources import files as src
from ..sources import git, remote
from ..sources.tables import table
from . import base
from .tabular import SQL as _TABULAR
from .tabular import _status

STATEMENTS = {
    "select 1": "allowed", "with a as (select 1) select * from a;": "allowed", "select 'drop table x' -- delete": "allowed", "select \"a;b\" from t /* ; */": "allowed",
    "": "the statement is empty, too long or not closed", "select 'open": "the statement is empty, too long or not closed", "/* x": "the statement is empty, too long or not closed",
    "select 1; select 2": "only one statement is allowed", "explain select 1": "only SELECT is allowed", "create table y as select 1": "only SELECT is allowed", "update t set a = 1": "only SELECT is allowed",
    "with a as (delete from x returning 1) select * from a": "DELETE is not allowed", "select * from (truncate t)": "TRUNCATE is not allowed",
}
THREE_PART = {"select * from Sales.dbo.orders o join hr.dbo.people p on p.id = o.id": "Sales,hr", "select 'a.b.c' from dbo.t": "", "select * from x.y": ""}
REQUESTS = [("sales", None), (None, "hr,Sales,HR"), (None, None), ("sales", "hr"), ("other", None), (None, "sales,hr,ops,dev")]
CATALOGS = ["Sales", "hr", "ops", "dev"]
STATUS = {
    "a": "# branch.oid 1\n1 .M N... 100644 100644 100644 aa bb src/a file.ts\n1 A. N... 000000 100644 100644 00 cc src/new.ts\n2 R. N... 100644 100644 100644 dd dd R100 src/now.ts\tsrc/was.ts\n? notes.txt\n! out.log",
    "b": "u UU N... 100644 100644 100644 100644 aa bb cc src/both.cs\n1 D. N... 100644 000000 000000 aa 00 gone.sql\n",
    "c": None,
}
_H, _K = "a" * 40, "b" * 40
BLAME = f"{_H} 1 1 2\nauthor Mai\nfilename a.ts\n\tline\n{_H} 2 2\n\tline\n{_K} 1 3 1\nauthor Luc\n\tline\n{_H} 3 4 1\n\t{_K} 1 3 1 in a text\n"


def _events_fetch(folder: str):
    """A search service over events.parquet: the first request of each window fails, and unknown columns are refused."""
    asked: set[str] = set()

    def fetch(request: dict) -> tuple[int, str]:
        if request["start"] not in asked:
            asked.add(request["start"])
            return 503, "busy"
        if "missing" in request["sql"]:
            return 400, "Schema error: No field named missing"
        t = pd.read_parquet(f"{folder}/events.parquet", columns=["event_id", "ts", "event_type"])
        t = t[(t["ts"] >= pd.Timestamp(request["start"])) & (t["ts"] < pd.Timestamp(request["end"]))]
        return 200, json.dumps({"hits": [{"event_id": int(i), "event_type": k, "value": 1} for i, k in zip(t["event_id"], t["event_type"])]})

    return fetch


def _http(s, d):
    a, b = table(s, d, "events").agg(F.min("ts"), F.max("ts")).first() or (None, None)
    if a is None:
        return s.createDataFrame([], "event_id bigint, event_type string, missing string")
    days = max(1, (b - a).days // 6)
    return remote.http_logs(s, _events_fetch(d), "events", "event_id bigint, event_type string, missing string", a, b + timedelta(microseconds=1), timedelta(days=days))


def _catalog_file(s, d):
    """The repositories as a catalog file, one JSON object a line."""
    scratch = Scratch(s, "catalog")
    table(s, d, "repositories").select(F.to_json(F.struct(F.col("repo_id").alias("service"), F.col("updated_at").alias("capturedAt"), F.struct(F.lit("repo").alias("kind"), F.col("repo_path").alias("path")).alias("entry"))).alias("value")).write.text(f"{scratch.base}/file")
    return remote.catalog(s, f"{scratch.base}/file", date(2026, 7, 1))


def _nul(s, d):
    own = table(s, d, "file_contents").select("repo_id", "path", "content")
    return own.unionByName(own.select("repo_id", F.concat(F.lit("bin/"), "path").alias("path"), F.concat(F.lit("MZ"), F.char(F.lit(0)), "content").alias("content"))).unionByName(own.select("repo_id", F.concat(F.lit("late/"), "path").alias("path"), F.concat(F.repeat(F.lit("x"), 512), F.char(F.lit(0)), "content").alias("content")))


def _statements(s, texts):
    return s.createDataFrame([(t,) for t in texts], "statement string")


def _guard(function, name):
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"statement": b["statement"], name: [function(t) for t in b["statement"]]})

    return run


def _resolved(s, d):
    def one(database, databases):
        try:
            return ",".join(sqlguard.resolve_catalogs(database, databases.split(",") if databases is not None else None, CATALOGS, 3))
        except sqlguard.Refused as e:
            return f"refused: {e}"

    return s.createDataFrame([(a, b, one(a, b)) for a, b in REQUESTS], "database string, databases string, catalogs string")


def _scan(s, d):
    """The SQL files without comments and literals, white space left out."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"repo_id": b["repo_id"], "path": b["path"], "code": ["".join(sqlguard.blank(t)[0].split()) for t in b["content"]]})

    c = table(s, d, "file_contents").where("path like '%.sql' and content is not null").select("repo_id", "path", "content")
    return c.mapInPandas(run, "repo_id string, path string, code string").select("repo_id", "path", F.md5("code").alias("code"))


def _pg_read(s, d):
    tables = {"edges": base.edges(s, d), "symbols": base.symbols(s, d)}
    return sqlguard.pg_read(s, tables, "select e.type, count(*) as n from edges e, symbols y where e.repo_id = y.repo_id and e.to_id = y.symbol_id group by e.type", most=50)[0]


def _bounded(s, d):
    rows = table(s, d, "ddl_history").where("version is not null").select("version").distinct().orderBy("version")
    found, state = sqlguard.bounded(rows, 25, 300)
    return s.createDataFrame([(r.version, state) for r in found], "version string, state string")


def _trace(s, d):
    a = table(s, d, "audit_log").distinct().select("id", F.col("tool").alias("service"), "status", F.col("sql_hash").alias("traceid"), F.col("ts").alias("at"))
    least = a.agg(F.min("traceid")).first()[0]
    return trace(a, least or "", "at")


def _small(s, rows: dict, schema: str):
    return s.createDataFrame(list(rows.items()), schema)


QUERIES = {
    "src_http_logs": _http,
    "src_catalog_json": lambda s, d: _catalog_file(s, d).select(F.col("service").alias("repo_id"), "stale"),
    "x_catalog_rows": lambda s, d: _catalog_file(s, d).select("service", F.col("entry.kind").alias("kind"), F.col("entry.path").alias("path")),
    "src_streams": lambda s, d: remote.streams(s, d),
    "src_pg": lambda s, d: remote.environment_table(s, {"prod": d}, "prod", "ddl_history").groupBy("_environment", "direction").agg(F.count(F.lit(1)).alias("n")),
    "src_mssql": lambda s, d: remote.environment_table(s, {"prod": d, "qa": d}, "qa", "audit_log").groupBy("_environment", "statement_type").agg(F.count(F.lit(1)).alias("n")),
    "src_binary_filter": lambda s, d: _nul(s, d).where(~src.is_binary(F.encode("content", "UTF-8"))).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")),
    "x_git_changes": lambda s, d: git.porcelain(_small(s, STATUS, "repo_id string, output string")),
    "x_symbol_blame": lambda s, d: git.blame(s.createDataFrame([("a", "a.ts", BLAME)], "repo_id string, path string, output string")),
    "sql_readonly": lambda s, d: _statements(s, STATEMENTS).mapInPandas(_guard(sqlguard.verdict, "verdict"), "statement string, verdict string"),
    "x_ms_catalog_candidates": lambda s, d: _statements(s, THREE_PART).mapInPandas(_guard(lambda t: ",".join(sqlguard.catalogs_named(t)), "catalogs"), "statement string, catalogs string"),
    "x_resolve_catalogs": _resolved,
    "sql_scan": _scan,
    "sql_pg_read": _pg_read,
    "sql_ms_bounded": _bounded,
    "sql_ddl_plan": lambda s, d: tab.ledger_plan(_status(s, d)),
    "x_trace_spans": lambda s, d: _trace(s, d).select("id", "service", "status"),
    "x_trace_logs": lambda s, d: _trace(s, d).select("id", "at"),
}


def _values(rows: list[tuple]) -> str:
    quote = lambda x: "null" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "(values " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + ")"


SQL = {
    "src_http_logs": "select event_id, event_type, cast(null as varchar) as missing from events",
    "src_catalog_json": "select repo_id, date_diff('day', cast(cast(updated_at as timestamptz) as date), date '2026-07-01') > 30 as stale from repositories",
    "x_catalog_rows": "select repo_id as service, 'repo' as kind, repo_path as path from repositories",
    "src_streams": "select unnest(string_split('audit_log customer ddl_history documents edges embeddings eval_items events file_contents files lineitem mix_targets nation orders part region repositories supplier symbols', ' ')) as stream",
    "src_pg": "select 'prod' as _environment, direction, count(*) as n from ddl_history group by 2",
    "src_mssql": "select 'qa' as _environment, statement_type, count(*) as n from audit_log group by 2",
    "src_binary_filter": "with x as (select repo_id, content from file_contents union all select repo_id, 'MZ' || chr(0) || content from file_contents union all select repo_id, repeat('x', 512) || chr(0) || content from file_contents) select repo_id, count(*) as n from x where strpos(substr(content, 1, 512), chr(0)) = 0 group by 1",
    "x_git_changes": "select * from " + _values([("a", "src/a file.ts", None, "modified"), ("a", "src/new.ts", None, "added"), ("a", "src/now.ts", "src/was.ts", "renamed"), ("a", "notes.txt", None, "untracked"), ("b", "src/both.cs", None, "conflict"), ("b", "gone.sql", None, "deleted")]) + " t(repo_id, path, old_path, change)",
    "x_symbol_blame": "select * from " + _values([("a", "a.ts", "Mai", _H, 3, 1), ("a", "a.ts", "Luc", _K, 1, 3)]) + " t(repo_id, path, author, commit, n_lines, first_line)",
    "sql_readonly": "select * from " + _values(list(STATEMENTS.items())) + " t(statement, verdict)",
    "x_ms_catalog_candidates": "select * from " + _values(list(THREE_PART.items())) + " t(statement, catalogs)",
    "x_resolve_catalogs": "select * from " + _values([("sales", None, "Sales"), (None, "hr,Sales,HR", "hr,Sales"), (None, None, "refused: exactly one of database and databases is needed"), ("sales", "hr", "refused: exactly one of database and databases is needed"), ("other", None, "refused: no such database"), (None, "sales,hr,ops,dev", "refused: at most 3 databases at once")]) + " t(database, databases, catalogs)",
    "sql_scan": r"""select repo_id, path, md5(regexp_replace(regexp_replace(content, '--[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|''(?:[^'']|'''')*''|"(?:[^"]|"")*"', '', 'g'), '\s', '', 'g')) as code from file_contents where path like '%.sql'""",
    "sql_pg_read": "with " + base.SYM + " select e.type, count(*) as n from edges e join sym y on e.repo_id = y.repo_id and e.to_id = y.symbol_id group by 1",
    "sql_ms_bounded": "select distinct version, 'capped' as state from ddl_history where version is not null order by 1 limit 25",
    "sql_ddl_plan": "with t as (" + _TABULAR["sql_ddl_status"] + """), p as (select version from t where status in ('pending', 'out_of_order'))
        select version, row_number() over (order by version) as step, (select arg_min(status, case status when 'checksum_mismatch' then 0 when 'missing' then 1 when 'renamed' then 2 else 3 end) from t where status in ('checksum_mismatch', 'missing', 'renamed', 'out_of_order')) as refusal,
            sha256((select string_agg(version, ',' order by version) from p)) as digest from p""",
    "x_trace_spans": "select distinct id, tool as service, status from audit_log where sql_hash = (select min(sql_hash) from audit_log)",
    "x_trace_logs": "select id, ts as at from (select distinct * from audit_log) where sql_hash = (select min(sql_hash) from audit_log)",
}
