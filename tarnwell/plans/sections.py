"""Queries of sections, terms, statements and endpoints, and their SQL."""

from __future__ import annotations

from datetime import timezone

import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import context
from ..operators import sections as op
from ..operators import sqlguard
from ..sources.tables import table
from . import base
from .context import _ROUTES, _routes
from .graph import _B
from .search import _DEF, _definitions

TIMES = {"15m": "900", "2 h": "7200", "7D": "604800", "soon": "refused", "-5m": "refused", "30": "refused"}
INSTANTS = {"1704067200000": "2024-01-01 00:00:00", "2024-01-01T02:00:00+02:00": "2024-01-01 00:00:00", "2024-01-01": "2024-01-01 00:00:00", "2024-01-01T00:00:00Z": "2024-01-01 00:00:00", "soon": "refused"}
LINKED = r"src/[a-z_]+/\w+\.\w+"


def _applied(function, texts: dict):
    """A function of a text over a small table; what it refuses is said so."""

    def one(t):
        try:
            return function(t)
        except ValueError:
            return "refused"

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"text": b["text"], "result": [one(t) for t in b["text"]]})

    return lambda s, d: s.createDataFrame([(t,) for t in texts], "text string").mapInPandas(run, "text string, result string")


def _scripts(s, d):
    return table(s, d, "file_contents").select("repo_id", fn.norm_path(F.col("path")).alias("path"), "content").where("path like '%.sql'")


def _lint(s, d):
    def run(batches):
        for b in batches:
            yield pd.DataFrame([(r, p, risk) for r, p, t in zip(b["repo_id"], b["path"], b["content"]) for risk in sqlguard.lint(t)], columns=["repo_id", "path", "risk"])

    return _scripts(s, d).where("content is not null").mapInPandas(run, "repo_id string, path string, risk string")


def _bound(s, d):
    names = _scripts(s, d).where("content is not null").select(F.explode(F.regexp_extract_all("content", F.lit(r"\b(?:from|join|into|on)\s+([a-z_]+)"), F.lit(1))).alias("name")).select("name", F.lit(None).cast("string").alias("schema"))
    d_ = _definitions(s, d).select(F.split_part("key", F.lit("."), F.lit(1)).alias("schema"), F.split_part("key", F.lit("."), F.lit(2)).alias("name"), "state")
    return op.bind_sql_names(names.unionByName(d_.where("schema = 'public'").select("name", "schema")), d_)


def _handlers(s, d):
    return context.route_handlers(_routes(s, d), base.symbols(s, d))


QUERIES = {
    "x_doc_sections_mentioning": lambda s, d: op.sections_mentioning(table(s, d, "documents").dropDuplicates(["doc_id"]), LINKED),
    "term_lookup": lambda s, d: op.terms_defined(table(s, d, "documents")),
    "jn_lateral_unnest": lambda s, d: op.inserted_values(_scripts(s, d)),
    "r_sql": _bound,
    "x_endpoint_deps": lambda s, d: op.endpoint_dependants(base.edges(s, d), _handlers(s, d)),
    "x_endpoint_contracts": lambda s, d: op.endpoint_contracts(base.symbols(s, d), _handlers(s, d)),
    "sql_ddl_lint": _lint,
    "fn_relative_time": _applied(lambda t: str(int(fn.relative_time(t).total_seconds())), TIMES),
    "fn_instant": _applied(lambda t: fn.instant(t).astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S"), INSTANTS),
}


def _values(rows: dict) -> str:
    return "select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in rows.items()) + ") t(text, result)"


_CODE = r"""c as (select repo_id, replace(path, '\', '/') as path, content from file_contents where path like '%.sql'),
    b as (select repo_id, path, unnest(string_split(regexp_replace(lower(regexp_replace(content, '--[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|''(?:[^'']|'''')*''|"(?:[^"]|"")*"', ' ', 'g')), '\s+', ' ', 'g'), ';')) as s from c)"""
SQL = {
    "x_doc_sections_mentioning": r"""with d as (select distinct doc_id, text from documents where text is not null), l as (select doc_id, unnest(string_split_regex(text, '\r?\n')) as l, generate_subscripts(string_split_regex(text, '\r?\n'), 1) as pos from d),
        h as (select doc_id, l, last_value(nullif(regexp_extract(l, '^#{1,6} +(.*)$', 1), '') ignore nulls) over (partition by doc_id order by pos) as heading from l),
        m as (select doc_id, heading, unnest(regexp_extract_all(l, 'src/[a-z_]+/\w+\.\w+')) as target from h) select doc_id, heading, target, count(*) as n from m group by 1, 2, 3""",
    "term_lookup": r"with t as (select doc_id, unnest(regexp_extract_all(text, '(?m)^\*\*([^*\n]+)\*\* +[–-] +\S', 1)) as term from documents) select term, count(distinct doc_id) as n_docs, min(doc_id) as first_doc from t group by 1",
    "jn_lateral_unnest": r"""with i as (select repo_id, replace(path, '\', '/') as path, unnest(regexp_extract_all(content, '(?i)insert into (\w+) \(([^()]*)\)\s*values \(([^()]*)\)')) as s from file_contents where path like '%.sql'),
        p as (select repo_id, path, regexp_extract(s, '(?i)insert into (\w+)', 1) as target, string_split_regex(regexp_extract(s, '\(([^()]*)\)\s*(?i:values)', 1), ',\s*') as c, string_split_regex(regexp_extract(s, '(?i)values \(([^()]*)\)', 1), ',\s*') as v from i),
        u as (select repo_id, path, target, unnest(c[1:least(len(c), len(v))]) as "column", unnest(v[1:least(len(c), len(v))]) as value from p) select repo_id, path, target, "column", value, count(*) as n from u group by 1, 2, 3, 4, 5""",
    "r_sql": _DEF + r""", dd as (select split_part(key, '.', 1) as schema, split_part(key, '.', 2) as name, state from l),
        asked as (select unnest(regexp_extract_all(content, '\b(?:from|join|into|on)\s+([a-z_]+)', 1)) as name, cast(null as varchar) as schema from file_contents where path like '%.sql' union select name, schema from dd where schema = 'public'),
        n as (select a.name, a.schema, count(*) filter (d.state = 'current') as live, count(d.schema) as seen, min(d.schema) filter (d.state = 'current') as only_one from asked a left join dd d on d.name = a.name and (a.schema is null or a.schema = d.schema) group by 1, 2)
        select name, case when live = 1 then only_one else schema end as schema, case when live = 1 then 'bound' when live > 1 then 'ambiguous' when seen > 0 then 'dropped' else 'unknown' end as state, case when live = 1 then case when schema is null then 0.5::double else 0.6::double end end as confidence from n""",
    "x_endpoint_deps": _B + ", " + _ROUTES + " select e.repo_id, e.from_id as symbol_id, b.route_id, count(*) as n from edges e join bound b on b.repo_id = e.repo_id and b.handler_id = e.to_id where e.type = 'CALLS' group by 1, 2, 3",
    "x_endpoint_contracts": _B + ", " + _ROUTES + " select distinct b.repo_id, b.route_id, y.symbol_id from bound b join sym h on h.repo_id = b.repo_id and h.symbol_id = b.handler_id join sym y on y.repo_id = h.repo_id and y.file_path = h.file_path and y.line = h.line",
    "sql_ddl_lint": "with " + _CODE + r""" select distinct repo_id, path, risk from (
        select repo_id, path, 'rewrites the table' as risk from b where regexp_matches(s, '\balter\s+table\b.*\balter\s+column\b.*\btype\b')
        union all select repo_id, path, 'fails on rows that exist' from b where regexp_matches(s, '\balter\s+table\b.*\badd\s+column\b.*\bnot\s+null\b') and not regexp_matches(s, '\bnot\s+null\b.*\bdefault\b')
        union all select repo_id, path, 'locks writes' from b where regexp_matches(s, '\bcreate\s+(?:unique\s+)?index\b') and not regexp_matches(s, '\bindex\s+concurrently')
        union all select repo_id, path, 'loses data' from b where regexp_matches(s, '\bdrop\s+(?:table|column)\b|\btruncate\b')
        union all select repo_id, path, 'scans under a lock' from b where regexp_matches(s, '\balter\s+table\b.*\badd\s+constraint\b') and not regexp_matches(s, '\badd\s+constraint\b.*\bnot\s+valid\b'))""",
    "fn_relative_time": _values(TIMES),
    "fn_instant": _values(INSTANTS),
}
