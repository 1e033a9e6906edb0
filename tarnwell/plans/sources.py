"""Queries of sources, extractors, streams and the SQL surface, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import sqlguard
from ..operators.search import search_matches
from ..sources import files as src
from ..sources.tables import table
from ..streaming import changes
from . import base


def _contents(s, d):
    return table(s, d, "file_contents").withColumn("path", fn.norm_path(F.col("path")))


def _graph_query(s, d):
    tables = {"symbols": base.symbols(s, d), "edges": base.edges(s, d)}
    return sqlguard.scoped_query(s, tables, "select kind, count(*) as n from symbols where line > :least group by kind", "wharf-core", args={"least": 5})[0]


def _events(s, d):
    f = base.files(s, d)
    return f.select("repo_id", "path", F.when(F.col("language").isNull(), "deleted").otherwise("changed").alias("event"), F.col("updated_at").alias("at")).unionByName(f.select("repo_id", "path", F.lit("changed").alias("event"), (F.col("updated_at") - F.expr("interval 1 day")).alias("at")))


def _stream(s, d):
    t = table(s, d, "files")
    return changes.keep_current(s, f"{d}/files.parque[t]", t.schema, ["repo_id", "path"], ["updated_at", "content_hash"]).select("repo_id", "path", "content_hash")


QUERIES = {
    "src_files": lambda s, d: src.skip_tally(_contents(s, d).select("path", F.length("content").alias("length"))),
    "src_secret_filter": lambda s, d: _contents(s, d).groupBy(src.is_secret(F.col("path")).alias("secret")).agg(F.count(F.lit(1)).alias("n")),
    "src_lang_detect": lambda s, d: _contents(s, d).select("repo_id", "path", src.language(F.col("path")).alias("language")),
    "src_extract_python": lambda s, d: src.extract_python(_contents(s, d).where("path like '%.py'")),
    "src_extract_declarations": lambda s, d: src.extract_by_pattern(_contents(s, d), src.DECLARATIONS),
    "src_extract_literals": lambda s, d: src.literals(_contents(s, d)),
    "src_extract_markdown": lambda s, d: src.markdown_sections(table(s, d, "documents"), "doc_id", "text"),
    "src_code_blocks": lambda s, d: src.code_blocks(table(s, d, "documents"), "doc_id", "text"),
    "sql_graph_query": _graph_query,
    "sql_observe_raw": lambda s, d: sqlguard.scoped_query(s, {"events": table(s, d, "events")}, "select event_type, count(*) as n from events group by event_type", "", column="none")[0],
    "sql_scan_refs": lambda s, d: _contents(s, d).where("path like '%.sql'").select(F.explode(F.regexp_extract_all("content", F.lit(r"(?i)\b(?:from|join|into|on)\s+([a-z_]+)"), F.lit(1))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")),
    "st_watch": lambda s, d: changes.coalesce_changes(_events(s, d)),
    "st_incremental": _stream,
    "st_windowed_counts": lambda s, d: changes.windowed_counts(s, f"{d}/events.parque[t]", table(s, d, "events").schema, "ts", "event_type").select(F.date_format("start", "yyyy-MM-dd").alias("day"), F.col("key").alias("event_type"), "n"),
    "st_freshness": lambda s, d: changes.freshness(base.files(s, d).where("language <> 'css' or language is null"), base.files(s, d).withColumn("content_hash", F.when(F.col("language") == "sql", F.lit("x")).otherwise(F.col("content_hash")))),
    "x_staleness": lambda s, d: base.files(s, d).groupBy("repo_id").agg(F.max("updated_at").alias("last_at"), F.count_if(F.col("language").isNull()).alias("dirty")),
    "x_test_plan": lambda s, d: base.files(s, d).where(fn.is_test_path(F.col("path"))).groupBy("repo_id", F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("package")).agg(F.count(F.lit(1)).alias("n_tests")),
    "x_change_value_repr": lambda s, d: src.literals(_contents(s, d)).groupBy(F.when(F.col("value").rlike(r"^\d+$"), "number").when(F.col("value").rlike(r"^[a-z]+$"), "word").otherwise("text").alias("form")).agg(F.sum("n").alias("n")),
    "x_citations_from": lambda s, d: search_matches(table(s, d, "documents").where("file_path is not null").withColumn("k", F.concat_ws(":", "repo_id", "file_path")), r"GX-\d+", "k", "text").groupBy("k", F.col("match").alias("target")).agg(F.count(F.lit(1)).alias("n")),
    "x_doc_targets": lambda s, d: table(s, d, "documents").where("file_path is not null").select("repo_id", "file_path").distinct(),
}

_LANG = "case lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"when '{k}' then '{v}'" for k, v in src.EXTENSIONS.items()) + " end"
_C = "with c as (select repo_id, replace(path, '\\', '/') as path, content from file_contents)"
_EXC = src.EXCLUDED

SQL = {
    "x_citations_from": r"with m as (select concat_ws(':', repo_id, file_path) as k, unnest(regexp_extract_all(text, 'GX-\d+')) as target from documents where file_path is not null) select k, target, count(*) as n from m group by 1, 2",
    "x_test_plan": "with " + base.FIL + f" select repo_id, array_to_string(string_split(path, '/')[1:2], '/') as package, count(*) as n_tests from fil where {base.test_sql('path')} group by 1, 2",
    "src_extract_literals": _C + r""", v as (select repo_id, path, unnest(regexp_extract_all(content, '"((?:[^"\\\n]|\\.)+)"', 1)) as value from c) select repo_id, path, value, count(*) as n from v group by 1, 2, 3""",
    "src_extract_declarations": _C + ", v as (" + " union all ".join(f"select repo_id, path, '{k}' as kind, unnest(regexp_extract_all(content, '{p}', 1)) as name from c" for k, p in src.DECLARATIONS.items()) + ") select repo_id, path, kind, name, count(*) as n from v group by 1, 2, 3, 4",
    "src_extract_markdown": r"""with d as (select doc_id, string_split_regex(regexp_replace(regexp_replace(text, '(?ms)^```.*?^```[ \t]*$', '', 'g'), '(?ms)^~~~.*?^~~~[ \t]*$', '', 'g'), '\r?\n') as ls from documents where text is not null),
        l as (select doc_id, unnest(ls) as l, unnest(range(0, len(ls))) as position from d)
        select doc_id, position, length(regexp_extract(l, '^(#+)', 1)) as level, trim(regexp_replace(l, '^#+ ', '')) as heading from l where regexp_matches(l, '^#{1,6} ')""",
    "src_files": _C + f", r as (select lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) as ext, case when regexp_matches(path, '{_EXC}') then 'excluded' when regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{src.SECRETS}') then 'secret' when length(content) > 1000000 then 'too large' when {_LANG} is null then 'unknown language' end as reason from c) select reason, ext, count(*) as n from r where reason is not null group by 1, 2",
    "src_secret_filter": _C + f" select regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{src.SECRETS}') as secret, count(*) as n from c group by 1",
    "src_lang_detect": _C + f" select repo_id, path, {_LANG} as language from c",
    "sql_graph_query": "with " + base.SYM + " select kind, count(*) as n from sym where repo_id = 'wharf-core' and line > 5 group by 1",
    "sql_observe_raw": "select event_type, count(*) as n from events group by 1",
    "sql_scan_refs": _C + r", m as (select unnest(regexp_extract_all(content, '(?i)\b(?:from|join|into|on)\s+([a-z_]+)', 1)) as name from c where path like '%.sql') select name, count(*) as n from m group by 1",
    "st_watch": "with " + base.FIL + " select repo_id, count(*) filter (language is not null) as changed, count(*) filter (language is null) as deleted, false as recheck from fil group by 1",
    "st_incremental": "select repo_id, path, content_hash from files qualify row_number() over (partition by repo_id, path order by updated_at desc, content_hash desc) = 1",
    "st_windowed_counts": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2",
    "st_freshness": "with " + base.FIL + " select repo_id, path, case when language = 'css' then 'missing' when language = 'sql' then 'stale' else 'fresh' end as label from fil",
    "x_staleness": "with " + base.FIL + " select repo_id, max(updated_at) as last_at, count(*) filter (language is null) as dirty from fil group by 1",
    "x_doc_targets": "select distinct repo_id, file_path from documents where file_path is not null",
}
