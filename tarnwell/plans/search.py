"""Queries of the resolution and search operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import graph, resolve, search
from ..sources import files as src
from ..sources.tables import table
from . import base

CALLABLE = ["method", "function", "constructor", "class"]
TYPES = ["class", "interface", "struct", "record", "type"]
EXTERNAL = ["System", "react", "Microsoft"]


def _resolve(prefix, kinds):
    return lambda s, d: resolve.resolve(base.edges(s, d), base.symbols(s, d), prefix, kinds, EXTERNAL)


def _docs(s, d):
    return table(s, d, "documents")


def _mentions(s, d):
    return resolve.mentions(_docs(s, d).dropDuplicates(["doc_id"]))


def _bound(s, d):
    return resolve.bind_mentions(_mentions(s, d), base.symbols(s, d))


def _drift(s, d):
    names = _bound(s, d).where("status = 'unbound'").join(_docs(s, d).select("doc_id", "repo_id"), "doc_id").select("repo_id", "mention").distinct()
    return resolve.drift(names, base.symbols(s, d))


def _headings(s, d):
    return src.markdown_sections(_docs(s, d), "doc_id", "text").select("doc_id", "heading")


def _behind(s, d):
    """Newest mention's file time against the document's, in whole days."""
    f = base.files(s, d).select("repo_id", F.col("path").alias("file_path"), "updated_at")
    m = _bound(s, d).where("status = 'bound'").join(_docs(s, d).select("doc_id", "repo_id", "recorded_at"), "doc_id").join(base.symbols(s, d).select("repo_id", "symbol_id", "file_path"), ["repo_id", "symbol_id"]).join(f, ["repo_id", "file_path"])
    r = m.groupBy("doc_id").agg(F.max("updated_at").alias("code_at"), F.max("recorded_at").alias("doc_at"), F.countDistinct("file_path").alias("n_files"))
    days = F.floor((F.unix_micros("code_at") - F.unix_micros("doc_at")) / 86400000000)
    return r.select("doc_id", days.cast("bigint").alias("days"), "n_files").where("days >= 1")


def _affinity(s, d):
    """Test and source files of a repository that share distinctive words of their names."""
    f = base.files(s, d)
    stem = F.lower(fn.split_case(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")))
    w = f.select("repo_id", "path", F.explode(F.array_distinct(F.filter(F.split(stem, r"[^a-z]+"), lambda t: F.length(t) >= 3))).alias("w"))
    t, c = w.where(fn.is_test_path(F.col("path"))).withColumnRenamed("path", "test"), w.where(~fn.is_test_path(F.col("path"))).withColumnRenamed("path", "source")
    return t.join(c, ["repo_id", "w"]).groupBy("repo_id", "test", "source").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").withColumn("score", F.round(F.least(F.lit(0.5), 0.42 + 0.05 * (F.col("n") - 1)), 6))


def _covering(s, d):
    y = base.symbols(s, d).where("kind = 'method' and parent_symbol_id is not null")
    owner = lambda kind, name: y.join(base.symbols(s, d).where(f"kind = '{kind}'").select("repo_id", F.col("symbol_id").alias("parent_symbol_id")), ["repo_id", "parent_symbol_id"]).select(F.concat_ws("/", "repo_id", "parent_symbol_id").alias(name), F.concat_ws("/", "repo_id", "name").alias("member"))
    return resolve.covering(owner("interface", "owner"), owner("class", "taker"))


def _routes(s, d):
    p = table(s, d, "files").select(F.regexp_replace(F.regexp_replace(fn.norm_path(F.col("path")), r"\.[^/]*$", ""), r"\d+", "{id}").alias("p"))
    return p.select(F.concat(F.lit("/"), "p").alias("path")), p.select(F.concat(F.lit("/gw/"), F.replace("p", F.lit("{id}"), F.lit("{x}"))).alias("path"))


def _definitions(s, d):
    """Objects that the audit log creates, alters and drops."""
    a = table(s, d, "audit_log").where("target_table is not null").distinct()
    action = F.when(F.col("statement_type") == "DROP", "drop").otherwise("define")
    return resolve.sql_definitions(a.select(F.lower("target_table").alias("key"), F.struct("ts", "id").alias("seq"), action.alias("action"), F.col("sql_hash").alias("definition")))


def _contracts(s, d):
    """The dependencies on packages, every fourth edge as its publisher and the others as its consumers."""
    role = F.when(F.pmod("edge_id", F.lit(4)) == 0, "PUBLISHES").otherwise("CONSUMES")
    return base.edges(s, d).where("type = 'DEPENDS_ON'").withColumn("type", role)


QUERIES = {
    "r_best_candidate": lambda s, d: resolve.best_candidate(base.edges(s, d), base.symbols(s, d), "callee", CALLABLE),
    "r_calls": _resolve("callee", CALLABLE),
    "r_types": _resolve("type", TYPES),
    "r_imports": _resolve("import", ["module", "class", "type"]),
    "r_properties": _resolve("property", ["property", "method"]),
    "r_implements": _resolve("iface", ["interface"]),
    "r_extends": _resolve("base", ["class"]),
    "r_css": lambda s, d: base.edges(s, d).where(F.col("to_id").startswith("cssclass:")).select("repo_id", "edge_id", F.regexp_replace("to_id", "^cssclass:", "").alias("name")).join(base.symbols(s, d).where("kind = 'css_class'").select("repo_id", "name", "symbol_id"), ["repo_id", "name"]).select("edge_id", "symbol_id"),
    "r_external_tag": lambda s, d: base.edges(s, d).where("type = 'IMPORTS'").where(F.substring_index(F.regexp_replace("to_id", "^import:", ""), ".", 1).isin(*EXTERNAL)).select("edge_id", F.lit(0.1).alias("confidence")),
    "r_packages": lambda s, d: resolve.packages(base.edges(s, d), base.symbols(s, d)),
    "r_publish_consume": lambda s, d: resolve.publish_consume(_contracts(s, d)),
    "r_components": lambda s, d: resolve.components(base.edges(s, d).withColumn("to_id", F.when(F.col("type") == "EXTENDS", F.regexp_replace("to_id", "^base:", "component:")).otherwise(F.col("to_id"))), base.symbols(s, d)),
    "x_python_mro": lambda s, d: resolve.base_chain(base.edges(s, d)),
    "win_current_definition": lambda s, d: _definitions(s, d),
    "g_sql_drop_state": lambda s, d: _definitions(s, d).groupBy("state").agg(F.count(F.lit(1)).alias("n")),
    "win_predecessor": lambda s, d: table(s, d, "ddl_history").where("version is not null").select("environment", "version").distinct().withColumn("before", F.lag("version").over(Window.partitionBy("environment").orderBy("version"))),
    "win_position_penalty": lambda s, d: search.symbol_candidates(base.symbols(s, d), "trace"),
    "r_cross_repo": lambda s, d: resolve.cross_repo(base.edges(s, d), base.symbols(s, d)),
    "r_edge_policy": lambda s, d: graph.cap_per_group(base.edges(s, d).where("type = 'CALLS' and confidence >= 0.4"), ["repo_id", "from_id"], "edge_id", 12).select("edge_id"),
    "r_mentions": _bound,
    "r_drift": _drift,
    "r_stale_docs": lambda s, d: _bound(s, d).where("status <> 'unbound'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ambiguous").alias("n_ambiguous")),
    "r_docs_behind_code": _behind,
    "r_citations": lambda s, d: search.search_matches(_docs(s, d), r"GX-\d+", "doc_id", "text").groupBy(F.col("match").alias("target")).agg(F.countDistinct("doc_id").alias("n_docs")),
    "x_imported_files": lambda s, d: resolve.imported_files(base.edges(s, d), base.symbols(s, d)),
    "x_py_protocol": _covering,
    "x_class_bases": lambda s, d: resolve.class_bases(base.edges(s, d)),
    "jn_cross_affinity": _affinity,
    "g_link_tests": lambda s, d: _affinity(s, d).groupBy("repo_id", "test").agg(F.min(F.struct((-F.col("score")).alias("s"), "source")).alias("b")).select("repo_id", "test", "b.source", (-F.col("b.s")).alias("score")),
    "g_endpoint_match": lambda s, d: (lambda r, c: resolve.endpoint_match(c, r))(*_routes(s, d)),
    "fts_rank": lambda s, d: search.bm25(_docs(s, d), ["registry", "planner", "timeouts"]).select("doc_id", "score"),
    "fts_query_intent": lambda s, d: search.bm25(_docs(s, d), ["regis", "plan"], prefix=True).select("doc_id", "n_terms"),
    "fts_query_name": lambda s, d: search.symbol_search(base.symbols(s, d), ["sampler", "tr"]),
    "search_symbols": lambda s, d: search.symbol_candidates(base.symbols(s, d), "walker").where("confidence >= 0.7"),
    "symbol_candidates": lambda s, d: search.symbol_candidates(base.symbols(s, d), "walker"),
    "search_docs": lambda s, d: search.search_docs(_docs(s, d), ["registry", "planner"]),
    "search_literals": lambda s, d: table(s, d, "file_contents").where(F.col("content").contains("'it\\'s {'")).select("repo_id", "path"),
    "search_comments": lambda s, d: search.search_lines(table(s, d, "file_contents").withColumn("k", F.concat_ws(":", "repo_id", "path")), r"^\s*(//|#).*called once per run", "k", "content").select("k", "line"),
    "search_regex": lambda s, d: search.search_lines(_docs(s, d), r"GX-[0-9]{4}", "doc_id", "text", 3),
    "win_per_file_cap": lambda s, d: search.search_lines(_docs(s, d), r"harbor", "doc_id", "text", 1).select("doc_id", "line"),
    "vector_knn": lambda s, d: search.knn(table(s, d, "embeddings"), table(s, d, "embeddings").where("vec_id % 50 = 0"), 5),
    "topk_knn_ties": lambda s, d: search.knn(table(s, d, "embeddings"), table(s, d, "embeddings").where("vec_id % 50 = 0"), 1).select("query_id", "vec_id"),
    "nearest_headings": lambda s, d: search.nearest_headings(_headings(s, d), "Open point"),
    "intent_classifier": lambda s, d: search.intent(_docs(s, d), {"limit": ["limit", "kilobytes"], "outage": ["timeouts", "paged", "lost"], "rename": ["renames", "moved"]}),
    "agg_doc_language": lambda s, d: _docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("p", "c")).select("doc_id", fn.non_ascii_letters(F.col("c")).alias("n"), F.regexp_count("c", F.lit(r"\p{L}")).alias("l")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if((F.col("l") > 0) & (F.col("n") / F.col("l") >= 0.02)).alias("flagged")),
    "agg_doc_coverage": lambda s, d: base.symbols(s, d).join(_bound(s, d).where("status = 'bound'").join(_docs(s, d).select("doc_id", "repo_id"), "doc_id").groupBy("repo_id", "symbol_id").agg(F.countDistinct("doc_id").alias("n")), ["repo_id", "symbol_id"], "left").groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_symbols"), F.count_if(F.col("n") > 0).alias("documented")),
    "x_ambiguous_count": lambda s, d: _bound(s, d).join(_docs(s, d).select("doc_id", "repo_id").dropDuplicates(["doc_id"]), "doc_id").groupBy("repo_id").agg(F.count_if(F.col("status") == "ambiguous").alias("n_ambiguous"), F.count(F.lit(1)).alias("n")),
    "agg_stale_groups": lambda s, d: _bound(s, d).where("status = 'ambiguous'").groupBy("mention").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.max("n_candidates").alias("most")),
    "agg_citation_counts": lambda s, d: search.search_matches(_docs(s, d), r"GX-\d+|src/[\w/.]+", "doc_id", "text").groupBy(F.when(F.col("match").startswith("GX"), "issue").otherwise("path").alias("kind")).agg(F.count(F.lit(1)).alias("n")),
    "agg_suggestions": lambda s, d: base.symbols(s, d).select("name").distinct().withColumn("hits", F.size(F.array_intersect(fn.tokens(F.col("name")), F.array(F.lit("walker"), F.lit("trace"), F.lit("lookup"))))).where("hits > 0").orderBy(F.desc("hits"), F.length("name"), "name").limit(10),
    "agg_doc_links": lambda s, d: search.search_matches(_docs(s, d), r"src/[a-z_]+/\w+\.\w+", "doc_id", "text").groupBy(F.col("match").alias("path")).agg(F.countDistinct("doc_id").alias("n_docs")),
}

_S = "with " + base.SYM
_RANK = "case kind when 'method' then 0 when 'function' then 1 when 'constructor' then 2 when 'class' then 3 when 'interface' then 4 when 'struct' then 5 when 'record' then 6 when 'property' then 7 when 'variable' then 8 else 999 end"


def _best(prefix: str, kinds: list[str]) -> str:
    k = ", ".join(f"'{x}'" for x in kinds)
    return (
        _S + f""", imp as (select distinct e.repo_id, a.file_path as source_file, b.file_path as target_file from edges e join sym a on a.repo_id = e.repo_id and a.symbol_id = e.from_id
            join sym b on b.repo_id = e.repo_id and b.symbol_id = e.to_id where e.type = 'IMPORTS'),
        asks as (select e.repo_id, e.edge_id, e.to_id, e.confidence, a.file_path as source_file, regexp_extract(regexp_replace(e.to_id, '^{prefix}:', ''), '([^.]*)$', 1) as name from edges e left join sym a on a.repo_id = e.repo_id and a.symbol_id = e.from_id where e.to_id like '{prefix}:%'),
        cand as (select q.repo_id, q.source_file, q.name, s.symbol_id, s.file_path, case when q.source_file = s.file_path then 'same file' when i.repo_id is not null then 'imported' else 'name' end as how, s.kind
            from (select distinct repo_id, source_file, name from asks where source_file is not null) q join sym s on s.repo_id = q.repo_id and s.name = q.name and s.kind in ({k})
            left join imp i on i.repo_id = q.repo_id and i.source_file = q.source_file and i.target_file = s.file_path),
        best as (select * from cand qualify row_number() over (partition by repo_id, source_file, name order by case how when 'same file' then 0 when 'imported' then 25 else 100 end + {_RANK}, file_path, symbol_id) = 1)"""
    )


def _resolved(prefix: str, kinds: list[str]) -> str:
    return _best(prefix, kinds) + f""", r as (select a.edge_id, coalesce(b.symbol_id, a.to_id) as to_id, a.confidence, coalesce(b.how, case when split_part(regexp_replace(a.to_id, '^{prefix}:', ''), '.', 1) in ('System', 'react', 'Microsoft') then 'external' end) as how
            from asks a left join best b on b.repo_id = a.repo_id and b.source_file = a.source_file and b.name = a.name)
        select edge_id, to_id, case how when 'same file' then 0.9 when 'imported' then 0.8 when 'name' then 0.6 when 'external' then 0.1 else confidence end::double as confidence, coalesce(how, 'unresolved') as reason from r"""


def _bm25(qs: list[str], prefix: bool = False) -> str:
    w = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
    t = ", ".join(f"len(list_filter({w}, lambda x: " + (f"starts_with(x, '{q}')" if prefix else f"x = '{q}'") + f")) as t{i}" for i, q in enumerate(qs))
    d = ", ".join(f"count(*) filter (t{i} > 0) as d{i}" for i in range(len(qs)))
    sc = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len / av))" for i in range(len(qs)))
    nt = " + ".join(f"(t{i} > 0)::int" for i in range(len(qs)))
    return f"with c as (select doc_id, file_path, len({w}) as len, {t} from documents where text is not null), st as (select count(*) as n, avg(len) as av, {d} from c), sc as (select doc_id, file_path, round({sc}, 6) as score, {nt} as n_terms from c, st where {nt} > 0)"


_CT = "greatest(0.0, least(1.0, base - least(rn * 0.01, 0.2)))"
_CAND = _S + r""", b as (select repo_id, symbol_id, name, (case when lower(name) = 'walker' then 0.96 when lower(name) like 'walker%' then 0.88 when lower(name) like '%walker%' then 0.72 end + case when kind in ('class', 'interface', 'function', 'method') then 0.03 else 0.0 end - case when TESTSQL then 0.08 else 0.0 end)::double as base from sym where lower(name) like '%walker%'),
    c as (select *, row_number() over (partition by repo_id order by base desc, length(name), name, symbol_id) - 1 as rn from b)""".replace("TESTSQL", base.test_sql("file_path"))
_KNN = "with q as (select vec_id as query_id, embedding as e from embeddings where vec_id % 50 = 0), x as (select query_id, vec_id, sqrt(list_sum(list_transform(list_zip(embedding, e), lambda p: (p[1]::double - p[2]::double) ** 2))) as distance from q, embeddings where vec_id <> query_id)"

_DEF = "with a as (select distinct id, ts, lower(target_table) as key, statement_type, sql_hash from audit_log where target_table is not null), l as (select key, sql_hash as definition, case when statement_type = 'DROP' then 'dropped' else 'current' end as state from a qualify row_number() over (partition by key order by ts desc, id desc) = 1)"

_MEN = _S + r""", d1 as (select doc_id, first(repo_id) as repo_id, first(text) as text from documents where text is not null group by doc_id),
    men as (select distinct doc_id, repo_id, mention from (
        select doc_id, repo_id, unnest(regexp_extract_all(text, '`([A-Za-z_][\w.]{2,})`', 1)) as mention from d1 union all
        select doc_id, repo_id, unnest(regexp_extract_all(text, '\b([a-z]+(?:[A-Z][a-z]+)+|[A-Z][a-z]+(?:[A-Z][a-z]+)+|[a-z]+(?:_[a-z]+)+)\b', 1)) from d1)),
    grade as (select repo_id, name, lower(name) as low, symbol_id, case when TESTSQL then 1 else 0 end as test,
        case kind when 'method' then 0 when 'function' then 1 when 'constructor' then 2 when 'class' then 3 when 'interface' then 4 when 'struct' then 5 when 'record' then 6 when 'property' then 7 when 'variable' then 8 else 999 end as rank from sym),
    keys as (select distinct repo_id, mention from men),
    hit as (select k.repo_id, k.mention, g.symbol_id, min({'t': case when g.name = k.mention then 0 else 1 end, 'e': test, 'r': rank}) as grade from keys k join grade g on g.repo_id = k.repo_id and g.low = lower(k.mention) group by 1, 2, 3),
    top as (select * from hit qualify grade = min(grade) over (partition by repo_id, mention)),
    cnt as (select repo_id, mention, count(distinct symbol_id) as n, min(symbol_id) as first from top group by 1, 2),
    bound as (select m.doc_id, m.repo_id, m.mention, case when n is null then 'unbound' when n = 1 then 'bound' else 'ambiguous' end as status, case when n = 1 then first end as symbol_id, coalesce(n, 0) as n_candidates
        from men m left join cnt c on c.repo_id = m.repo_id and c.mention = m.mention)""".replace("TESTSQL", base.test_sql("file_path"))

_AFF = "with " + base.FIL + r""", w as (select repo_id, path, unnest(list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z]+'), lambda x: length(x) >= 3))) as w, TESTSQL as test from fil),
    aff as (select a.repo_id, a.path as test, b.path as source, count(*) as n, round(least(0.5, 0.42 + 0.05 * (count(*) - 1)), 6)::double as score from w a join w b on b.repo_id = a.repo_id and b.w = a.w and a.test and not b.test group by 1, 2, 3 having count(*) >= 2)""".replace("TESTSQL", base.test_sql("path"))

SQL = {
    "win_position_penalty": _CAND.replace("walker", "trace") + f" select repo_id, symbol_id, round({_CT}, 6) as confidence from c",
    "agg_doc_coverage": _MEN + """, hitd as (select b.repo_id, b.symbol_id, count(distinct doc_id) as n from bound b where status = 'bound' group by 1, 2)
        select y.repo_id, count(*) as n_symbols, count(h.n) as documented from sym y left join hitd h on h.repo_id = y.repo_id and h.symbol_id = y.symbol_id group by 1""",
    "search_comments": r"""with l as (select repo_id || ':' || path as k, unnest(string_split_regex(content, '\r?\n')) as l, generate_subscripts(string_split_regex(content, '\r?\n'), 1) as line from file_contents)
        select k, line from l where regexp_matches(l, '^\s*(//|#).*called once per run')""",
    "fts_query_name": _S + r""", t as (select repo_id, symbol_id, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2) as w from sym)
        select repo_id, symbol_id, 2 as matched from t where len(list_filter(w, lambda x: starts_with(x, 'sampler'))) > 0 and len(list_filter(w, lambda x: starts_with(x, 'tr'))) > 0""",
    "agg_suggestions": _S + r""", t as (select distinct name, list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda x: x in ('walker', 'trace', 'lookup'))) as w from sym)
        select name, len(w) as hits from t where len(w) > 0 order by 2 desc, length(name), name limit 10""",
    "r_docs_behind_code": _MEN + ", " + base.FIL + """, m as (select b.doc_id, f.updated_at as code_at, d.recorded_at as doc_at, y.file_path from bound b join documents d on d.doc_id = b.doc_id join sym y on y.repo_id = d.repo_id and y.symbol_id = b.symbol_id
            join fil f on f.repo_id = y.repo_id and f.path = y.file_path where status = 'bound'),
        g as (select doc_id, max(code_at) as c, max(doc_at) as d, count(distinct file_path) as n from m group by 1)
        select doc_id, cast(floor((epoch_us(c) - epoch_us(d)) / 86400000000.0) as bigint) as days, n as n_files from g where floor((epoch_us(c) - epoch_us(d)) / 86400000000.0) >= 1""",
    "jn_cross_affinity": _AFF + " select repo_id, test, source, n, score from aff",
    "g_link_tests": _AFF + " select repo_id, test, arg_min(source, {'s': -score, 'n': source}) as source, max(score) as score from aff group by 1, 2",
    "r_mentions": _MEN + " select doc_id, mention, status, symbol_id, n_candidates from bound",
    "r_stale_docs": _MEN + " select doc_id, count(*) as n, count(*) filter (status = 'ambiguous') as n_ambiguous from bound where status <> 'unbound' group by 1",
    "x_ambiguous_count": _MEN + " select repo_id, count(*) filter (status = 'ambiguous') as n_ambiguous, count(*) as n from bound group by 1",
    "agg_stale_groups": _MEN + " select mention, count(*) as n, count(distinct doc_id) as n_docs, max(n_candidates) as most from bound where status = 'ambiguous' group by 1",
    "r_packages": _S + ", m as (select name, arg_min(symbol_id, {'r': repo_id, 's': symbol_id}) as symbol_id from sym where kind in ('module', 'class', 'interface', 'type') group by 1) select edge_id, m.symbol_id from edges join m on to_id in ('npm:' || m.name, 'nuget:' || m.name)",
    "r_publish_consume": "with d as (select *, edge_id % 4 = 0 as pub from edges where type = 'DEPENDS_ON') select distinct a.to_id as contract, a.from_id as producer, b.from_id as consumer from d a join d b on a.to_id = b.to_id where a.pub and not b.pub and a.from_id <> b.from_id",
    "win_current_definition": _DEF + " select key, definition, state from l",
    "g_sql_drop_state": _DEF + " select state, count(*) as n from l group by 1",
    "win_predecessor": "select environment, version, lag(version) over (partition by environment order by version) as before from (select distinct environment, version from ddl_history where version is not null)",
    "r_best_candidate": _best("callee", CALLABLE) + " select a.edge_id, b.symbol_id, b.how from asks a join best b on b.repo_id = a.repo_id and b.source_file = a.source_file and b.name = a.name",
    "r_calls": _resolved("callee", CALLABLE),
    "r_types": _resolved("type", TYPES),
    "r_imports": _resolved("import", ["module", "class", "type"]),
    "r_properties": _resolved("property", ["property", "method"]),
    "r_implements": _resolved("iface", ["interface"]),
    "r_extends": _resolved("base", ["class"]),
    "r_css": _S + " select e.edge_id, s.symbol_id from edges e join sym s on s.repo_id = e.repo_id and s.kind = 'css_class' and e.to_id = 'cssclass:' || s.name",
    "r_external_tag": "select edge_id, 0.1::double as confidence from edges where type = 'IMPORTS' and split_part(regexp_replace(to_id, '^import:', ''), '.', 1) in ('System', 'react', 'Microsoft')",
    "r_cross_repo": _S + ", size as (select repo_id, count(*) as n from sym group by 1), best as (select s.symbol_id as to_id, s.repo_id as to_repo from sym s join size z using (repo_id) qualify row_number() over (partition by s.symbol_id order by n desc, s.repo_id desc) = 1) select e.edge_id, b.to_repo from edges e join best b on b.to_id = e.to_id where not contains(e.to_id, ':') and not exists (select 1 from sym s where s.repo_id = e.repo_id and s.symbol_id = e.to_id)",
    "r_edge_policy": "select edge_id from edges where type = 'CALLS' and confidence >= 0.4 qualify row_number() over (partition by repo_id, from_id order by edge_id) <= 12",
    "x_imported_files": _S + " select distinct e.repo_id, a.file_path as source_file, b.file_path as target_file from edges e join sym a on a.repo_id = e.repo_id and a.symbol_id = e.from_id join sym b on b.repo_id = e.repo_id and b.symbol_id = e.to_id where e.type = 'IMPORTS'",
    "x_class_bases": "with o as (select repo_id, from_id as class_id, to_id as base_id, min(edge_id) as e from edges where type = 'EXTENDS' group by 1, 2, 3) select repo_id, class_id, base_id, row_number() over (partition by repo_id, class_id order by e, base_id) as position from o",
    "x_py_protocol": _S + ", m as (select y.repo_id || '/' || y.parent_symbol_id as o, y.repo_id || '/' || y.name as member, p.kind from sym y join sym p on p.repo_id = y.repo_id and p.symbol_id = y.parent_symbol_id where y.kind = 'method'), r as (select distinct o as owner, member from m where kind = 'interface'), t as (select distinct o as taker, member from m where kind = 'class'), need as (select owner, count(*) as need from r group by 1) select owner, taker from (select owner, taker, count(*) as got from r join t using (member) group by 1, 2) join need using (owner) where got = need and owner <> taker",
    "fts_rank": _bm25(["registry", "planner", "timeouts"]) + " select doc_id, score from sc",
    "fts_query_intent": _bm25(["regis", "plan"], True) + " select doc_id, n_terms from sc",
    "search_docs": _bm25(["registry", "planner"]) + ", r as (select *, case when n_terms = 2 then 'strict' else 'broad' end as tier from sc), best as (select * from r qualify row_number() over (partition by coalesce(file_path, doc_id::varchar) order by tier desc, score desc, doc_id) = 1) select doc_id, tier, score from best order by tier desc, score desc, doc_id limit 20",
    "symbol_candidates": _CAND + f" select repo_id, symbol_id, round({_CT}, 6) as confidence from c",
    "search_symbols": _CAND + f" select repo_id, symbol_id, round({_CT}, 6) as confidence from c where round({_CT}, 6) >= 0.7",
    "search_literals": "select repo_id, path from file_contents where contains(content, '''it\\''s {''')",
    "search_regex": r"with l as (select doc_id, unnest(string_split_regex(text, '\r?\n')) as l, generate_subscripts(string_split_regex(text, '\r?\n'), 1) as line from documents) select doc_id, line, len(regexp_extract_all(l, 'GX-[0-9]{4}')) as n_hits, regexp_extract(l, 'GX-[0-9]{4}') as first from l where regexp_matches(l, 'GX-[0-9]{4}') qualify row_number() over (partition by doc_id order by line) <= 3",
    "win_per_file_cap": r"with l as (select doc_id, unnest(string_split_regex(text, '\r?\n')) as l, generate_subscripts(string_split_regex(text, '\r?\n'), 1) as line from documents) select doc_id, min(line) as line from l where contains(l, 'harbor') group by 1",
    "r_citations": r"with m as (select doc_id, unnest(regexp_extract_all(text, 'GX-\d+')) as target from documents) select target, count(distinct doc_id) as n_docs from m group by 1",
    "agg_citation_counts": r"with m as (select unnest(regexp_extract_all(text, 'GX-\d+|src/[\w/.]+')) as x from documents) select case when starts_with(x, 'GX') then 'issue' else 'path' end as kind, count(*) as n from m group by 1",
    "agg_doc_links": r"with m as (select doc_id, unnest(regexp_extract_all(text, 'src/[a-z_]+/\w+\.\w+')) as path from documents) select path, count(distinct doc_id) as n_docs from m group by 1",
    "vector_knn": _KNN + " select query_id, vec_id, round(distance, 5) as distance, row_number() over (partition by query_id order by distance, vec_id) as rank from x qualify rank <= 5",
    "topk_knn_ties": _KNN + " select query_id, vec_id from x qualify row_number() over (partition by query_id order by distance, vec_id) = 1",
}
