"""Queries of the graph operators over the code index, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import graph as op
from ..operators.skew import salted_join
from ..sources.tables import table
from . import base

KINDS = ["function", "method", "class", "interface", "variable", "type"]


def _pairs(s, d):
    return op.token_pairs(base.symbols(s, d), base.edges(s, d))


def _call_edges(s, d):
    e = base.edges(s, d).where(F.col("type").isin(*op.CALL_TYPES))
    return op.without_tests(op.endpoints(e, base.symbols(s, d)), "target_file").select("repo_id", "edge_id", "from_id", "to_id", "source_name", "target_name")


def _start(s, d):
    return base.symbols(s, d).where("kind = 'class'").select("repo_id", F.col("symbol_id").alias("id"))


def _resolved(s, d, types=None):
    e = base.edges(s, d).where(~op.is_token(F.col("to_id")))
    return e.where(F.col("type").isin(*types)) if types else e


def _impact(s, d):
    return op.impact_files(base.symbols(s, d), base.edges(s, d))


def _risk(s, d):
    n = op.caller_files(base.symbols(s, d), base.edges(s, d)).groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"))
    r = op.reliability(base.edges(s, d), ["repo_id"])
    score = fn.risk_score(F.coalesce("files", F.lit(0)), F.col("unresolved"), F.col("median"), F.col("low"), F.col("n"))
    return r.join(n, "repo_id", "left").select("repo_id", score.cast("bigint").alias("score")).withColumn("level", fn.risk_level(F.col("score")))


def _folder(s, d):
    f = base.files(s, d).select("repo_id", F.col("path").alias("file_path"))
    y = base.symbols(s, d)
    exported = F.countDistinct(F.when(F.col("kind").isin("class", "interface", "function", "type"), F.col("symbol_id")))
    per = f.join(y.select("repo_id", "file_path", "symbol_id", "kind"), ["repo_id", "file_path"], "left").groupBy("repo_id", "file_path").agg(F.countDistinct("symbol_id").alias("n_symbols"), exported.alias("n_exported"))
    callers = op.endpoints(_resolved(s, d), y, "inner").where("source_file <> target_file").groupBy("repo_id", F.col("target_file").alias("file_path")).agg(F.countDistinct("source_file").alias("n_callers"))
    return per.join(callers, ["repo_id", "file_path"], "left").select("repo_id", "file_path", "n_symbols", "n_exported", F.coalesce("n_callers", F.lit(0)).alias("n_callers"))


def _module_flow(s, d):
    e = op.endpoints(base.edges(s, d), base.symbols(s, d)).where(~(F.col("source_file").eqNullSafe(F.col("target_file"))) & F.col("source_file").isNotNull())
    return e.groupBy("repo_id", "source_file", "to_id", "type").agg(F.min("edge_id").alias("edge_id"), F.count(F.lit(1)).alias("n"))


def _unresolved(s, d):
    e = base.edges(s, d)
    of = lambda p: F.sum(F.col("to_id").startswith(p + ":").cast("bigint")).alias(p)
    imports = F.col("type") == "IMPORTS"
    ratio = F.when(F.sum(imports.cast("int")) > 0, F.least(F.lit(1.0), F.sum((imports & ~op.is_token(F.col("to_id"))).cast("int")) / F.sum(imports.cast("int")))).otherwise(1.0)
    return e.groupBy("repo_id").agg(*[of(p) for p in ("callee", "import", "type", "property")], F.round(ratio, 6).alias("import_ratio"))


def _probe_ids(s, d):
    p = base.symbols(s, d).where("end_line is not null").select("repo_id", "file_path", F.col("end_line").alias("line")).distinct()
    return op.enclosing(p.withColumn("probe", F.lit(1)), base.symbols(s, d)).select("repo_id", "file_path", "line", "symbol_id")


def _next_start(s, d):
    y = base.symbols(s, d).select("repo_id", "file_path", "line", "end_line", "symbol_id")
    after = y.select("repo_id", "file_path", "line").distinct().withColumn("next", F.lead("line").over(Window.partitionBy("repo_id", "file_path").orderBy("line")))
    return y.join(after, ["repo_id", "file_path", "line"]).select("repo_id", "symbol_id", "line", F.coalesce(F.col("end_line"), F.col("next") - 1, F.col("line") + 200).cast("bigint").alias("last_line"), F.col("end_line").isNull().alias("estimated"))


def _implementations(s, d):
    e, y = base.edges(s, d).where("type = 'IMPLEMENTS'"), base.symbols(s, d).where("kind = 'interface'")
    by_id = e.join(y.select("repo_id", F.col("symbol_id").alias("to_id"), F.col("symbol_id").alias("iface")), ["repo_id", "to_id"])
    by_name = e.join(y.select("repo_id", F.concat(F.lit("iface:"), "name").alias("to_id"), F.col("symbol_id").alias("iface")), ["repo_id", "to_id"])
    return by_id.unionByName(by_name).select("repo_id", "iface", F.col("from_id").alias("implementor")).distinct()


def _reverse(s, d):
    """Files that need, over two steps, a file whose rows know several contents."""
    e = op.endpoints(_resolved(s, d), base.symbols(s, d), "inner").where("source_file <> target_file").select("repo_id", F.col("source_file").alias("from_id"), F.col("target_file").alias("to_id")).distinct()
    f = table(s, d, "files").groupBy("repo_id", fn.norm_path(F.col("path")).alias("id")).agg(F.countDistinct("content_hash").alias("n"))
    return op.reach(f.where("n > 1").select("repo_id", "id"), e, 2, backward=True)


QUERIES = {
    "jn_edge_endpoints": lambda s, d: op.endpoints(base.edges(s, d), base.symbols(s, d)).select("edge_id", "source_name", "source_file", "target_name", "target_file"),
    "jn_inner_endpoints": lambda s, d: op.endpoints(base.edges(s, d), base.symbols(s, d), "inner").select("edge_id", "source_name", "target_name"),
    "jn_symbol_token_pairs": _pairs,
    "jn_parent": lambda s, d: (lambda y: y.join(y.select("repo_id", F.col("symbol_id").alias("parent_symbol_id"), F.col("name").alias("parent_name")), ["repo_id", "parent_symbol_id"], "left").select("repo_id", "symbol_id", "name", "parent_name"))(base.symbols(s, d)),
    "jn_semi": lambda s, d: base.edges(s, d).join(base.symbols(s, d).where("kind = 'class'").select("repo_id", F.col("symbol_id").alias("from_id")), ["repo_id", "from_id"], "left_semi").select("edge_id"),
    "jn_anti": lambda s, d: base.symbols(s, d).join(base.edges(s, d).select("repo_id", F.col("to_id").alias("symbol_id")).distinct(), ["repo_id", "symbol_id"], "left_anti").select("repo_id", "symbol_id"),
    "jn_asof_enclosing": _probe_ids,
    "jn_correlated_scalar": lambda s, d: base.symbols(s, d).join(base.edges(s, d).where("type = 'CALLS'").groupBy("repo_id", F.col("from_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("calls")), ["repo_id", "symbol_id"], "left").select("repo_id", "symbol_id", F.coalesce("calls", F.lit(0)).alias("calls")),
    "flt_repo_scope": lambda s, d: base.edges(s, d).where("repo_id = 'wharf-core'").select("edge_id"),
    "flt_kind_lang_path": lambda s, d: base.symbols(s, d).where("kind = 'class' and contains(file_path, 'src/')").join(base.files(s, d).where("language = 'csharp'").select("repo_id", F.col("path").alias("file_path")), ["repo_id", "file_path"], "left_semi").select("repo_id", "symbol_id"),
    "flt_path_prefix": lambda s, d: base.symbols(s, d).where(F.col("file_path").startswith("packages/ledger")).select("repo_id", "symbol_id"),
    "flt_exclude_tests": lambda s, d: op.without_tests(op.endpoints(base.edges(s, d), base.symbols(s, d)), "target_file").select("edge_id"),
    "flt_resolved_target": lambda s, d: _resolved(s, d).select("edge_id"),
    "flt_private": lambda s, d: base.symbols(s, d).where(~F.col("name").startswith("_") & ~F.coalesce(F.col("signature").startswith("private "), F.lit(False))).select("repo_id", "symbol_id"),
    "flt_canonical_path": lambda s, d: base.files(s, d).select("repo_id", F.lower("path").alias("asked"), "path").groupBy("repo_id", "asked").agg(F.min("path").alias("path")),
    "flt_risk": lambda s, d: _risk(s, d).where("score >= 34"),
    "agg_repo_snapshot": lambda s, d: base.files(s, d).groupBy("repo_id", F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("n")),
    "agg_folder_summary": _folder,
    "agg_module_group": lambda s, d: base.files(s, d).groupBy("repo_id", F.when(F.col("path").contains("/"), F.array_join(F.slice(F.split("path", "/"), 1, 2), "/")).otherwise("(root)").alias("module")).agg(F.count(F.lit(1)).alias("n")),
    "agg_unresolved_stats": _unresolved,
    "agg_graph_health": lambda s, d: op.endpoints(base.edges(s, d), base.symbols(s, d)).where("source_file is not null").groupBy("repo_id", "source_file").agg(F.count(F.lit(1)).alias("n"), F.count_if(op.is_token(F.col("to_id"))).alias("unresolved")),
    "agg_reliability": lambda s, d: op.reliability(base.edges(s, d), ["repo_id"]),
    "agg_impact_files": _impact,
    "agg_impact_surface": lambda s, d: op.endpoints(_resolved(s, d).where("not (type = 'PROPERTY_REF' and confidence < 0.7)"), base.symbols(s, d), "inner").groupBy("repo_id", "source_file", "source_name", "to_id").agg(F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"), F.max("confidence").alias("confidence")),
    "agg_edge_provenance": lambda s, d: base.edges(s, d).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("reason").contains("name"), F.lit(False))).alias("by_name"), F.min("confidence").alias("least")),
    "agg_blank_zones": lambda s, d: base.symbols(s, d).groupBy("repo_id", "file_path").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("k")).groupBy("repo_id").agg(F.round(F.avg(((F.col("n") == 1) & (F.col("k") == "module")).cast("int")), 6).alias("ratio")).withColumn("verdict", F.when(F.col("ratio") <= 0.4, "PASS").when(F.col("ratio") <= 0.7, "WARN").otherwise("FAIL")),
    "g_dependencies": lambda s, d: op.endpoints(base.edges(s, d).where(F.col("type").isin(*op.DEPENDENCY_TYPES)), base.symbols(s, d)).select("repo_id", "edge_id", "source_name", "to_id", "target_name"),
    "g_call_edges": _call_edges,
    "g_module_flow": _module_flow,
    "g_trace_flow": lambda s, d: op.reach(_start(s, d), _resolved(s, d, op.CALL_TYPES), 3),
    "g_change_context": lambda s, d: op.reach(_start(s, d), _resolved(s, d, op.CALL_TYPES), 2, backward=True),
    "g_reverse_files": _reverse,
    "g_interface_siblings": lambda s, d: op.interface_siblings(base.symbols(s, d), base.edges(s, d)),
    "g_cycles": lambda s, d: op.cycles(_resolved(s, d, ["CALLS", "IMPORTS", "DEPENDS_ON"]), 4),
    "g_dead_code": lambda s, d: op.uncalled(base.symbols(s, d), base.edges(s, d), KINDS),
    "g_call_blind_langs": lambda s, d: (lambda c, f: f.join(c, ["repo_id", "language"], "left_anti").join(c.select("repo_id").distinct(), "repo_id", "left_semi"))(
        op.endpoints(base.edges(s, d).where("type = 'CALLS'"), base.symbols(s, d)).join(base.files(s, d).select("repo_id", F.col("path").alias("source_file"), "language"), ["repo_id", "source_file"]).where("language is not null").select("repo_id", "language").distinct(), base.files(s, d).where("language is not null").select("repo_id", "language").distinct()),
    "g_entry_points": lambda s, d: op.entry_points(base.symbols(s, d), base.edges(s, d), ["function", "method"]),
    "g_implementations": _implementations,
    "g_field_access": lambda s, d: op.token_pairs(base.symbols(s, d), base.edges(s, d).where("type in ('PROPERTY_REF', 'PROPERTY_WRITE')"), "type", "from_id"),
    "g_rename_impact": lambda s, d: op.endpoints(_resolved(s, d, ["CALLS", "IMPORTS"]), base.symbols(s, d), "inner").groupBy("repo_id", "to_id").agg(F.countDistinct("source_file").alias("n_files"), F.count(F.lit(1)).alias("n_edges")),
    "g_file_summary": lambda s, d: op.endpoints(_resolved(s, d), base.symbols(s, d), "inner").where("source_file <> target_file and type = 'IMPORTS'").select("repo_id", F.col("target_file").alias("file_path"), F.col("source_file").alias("imported_by")).distinct(),
    "g_symbol_detail": lambda s, d: base.edges(s, d).select("repo_id", F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.lit("out").alias("way")), F.struct(F.col("to_id").alias("id"), F.lit("in").alias("way")))).alias("x")).groupBy("repo_id", "x.id", "x.way").agg(F.count(F.lit(1)).alias("n")).join(base.symbols(s, d).select("repo_id", F.col("symbol_id").alias("id")), ["repo_id", "id"], "left_semi"),
    "g_callers_by_name": lambda s, d: op.endpoints(base.edges(s, d).where("type = 'CALLS'"), base.symbols(s, d)).select(F.coalesce("target_name", F.regexp_replace("to_id", "^callee:", "")).alias("name"), "repo_id", "from_id").distinct(),
    "g_cross_repo_impact": lambda s, d: (lambda e, y: e.join(y.select(F.col("symbol_id").alias("to_id"), F.col("repo_id").alias("to_repo")), "to_id").where("to_repo <> repo_id").groupBy("repo_id", "to_repo").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("to_id").alias("n_symbols")))(_resolved(s, d), base.symbols(s, d)),
    "g_package_consumers": lambda s, d: base.edges(s, d).where(F.col("to_id").startswith("npm:")).groupBy(F.col("to_id").alias("package")).agg(F.countDistinct("repo_id").alias("n_repos"), F.count(F.lit(1)).alias("n_edges")),
    "sink_dedup_edges": lambda s, d: op.dedupe_resolved(base.edges(s, d)),
    "sink_prune_orphans": lambda s, d: base.edges(s, d).where(~F.col("from_id").startswith("callee:")).join(base.symbols(s, d).select("repo_id", F.col("symbol_id").alias("from_id")), ["repo_id", "from_id"], "left_anti").select("edge_id"),
    "sink_prune_dangling": lambda s, d: salted_join(_resolved(s, d).select("repo_id", "to_id", "edge_id"), base.symbols(s, d).select("repo_id", F.col("symbol_id").alias("to_id")), ["repo_id", "to_id"], "left_anti", spread=F.col("edge_id")).select("edge_id"),
    "sink_prune_files": lambda s, d: base.symbols(s, d).join(base.files(s, d).where("language is not null").select("repo_id", F.col("path").alias("file_path")), ["repo_id", "file_path"], "left_anti").select("repo_id", "symbol_id"),
    "sink_replace_file": lambda s, d: (lambda y: y.where("file_path not like '%.sql'").select("repo_id", "symbol_id", "name").unionByName(y.where("file_path like '%.sql'").select("repo_id", "symbol_id", F.upper("name").alias("name"))))(base.symbols(s, d)),
    "sink_purge_repo": lambda s, d: base.edges(s, d).select("repo_id", F.lit("edges").alias("t")).unionAll(base.symbols(s, d).select("repo_id", F.lit("symbols").alias("t"))).where("repo_id = 'onyx-docs'").groupBy("t").agg(F.count(F.lit(1)).alias("n")),
    "sink_seed_clone": lambda s, d: base.symbols(s, d).where("repo_id = 'onyx-docs'").withColumn("repo_id", F.lit("onyx-docs-2")).select("repo_id", "symbol_id", "name"),
    "win_max_rowid": lambda s, d: base.edges(s, d).groupBy("repo_id", "from_id", "type").agg(F.max("edge_id").alias("edge_id")),
    "win_latest_run": lambda s, d: base.files(s, d).withColumn("rn", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("updated_at"), "path"))).where("rn = 1").select("repo_id", "path"),
    "win_edge_cap_per_file": lambda s, d: op.cap_per_group(op.endpoints(base.edges(s, d).where("type = 'CALLS'"), base.symbols(s, d)).where("source_file is not null"), ["repo_id", "source_file"], "edge_id", 20).select("edge_id"),
    "ord_case_rank": lambda s, d: base.edges(s, d).withColumn("rank", F.when(F.col("type") == "CALLS", 0).when(F.col("type") == "TYPE_REF", 1).otherwise(2)).withColumn("rn", F.row_number().over(Window.partitionBy("repo_id", "from_id").orderBy("rank", "edge_id"))).where("rn = 1").select("repo_id", "from_id", "edge_id"),
    "lim_plus_one": lambda s, d: base.edges(s, d).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).select("repo_id", F.least("n", F.lit(1000)).alias("shown"), (F.col("n") > 1000).alias("truncated")),
    "lim_offset": lambda s, d: base.symbols(s, d).select("repo_id", "symbol_id").orderBy("repo_id", "symbol_id").offset(100).limit(50),
    "lim_keyset": lambda s, d: base.symbols(s, d).where(F.struct("file_path", "line") > F.struct(F.lit("packages/ledger"), F.lit(5))).select("file_path", "line", "symbol_id", "repo_id").orderBy("file_path", "line", "repo_id", "symbol_id").limit(50).select("repo_id", "symbol_id"),
    "x_symbol_source": _next_start,
    "x_repo_lookup": lambda s, d: base.symbols(s, d).groupBy("symbol_id").agg(F.array_join(F.sort_array(F.collect_set("repo_id")), ",").alias("repos")),
    "x_csharp_types": lambda s, d: base.symbols(s, d).where("kind in ('class', 'interface', 'struct', 'record') and file_path like '%.cs'").select("name", "kind").distinct(),
    "x_member_decls": lambda s, d: (lambda y: y.where("kind in ('method', 'property')").join(y.select("repo_id", F.col("symbol_id").alias("parent_symbol_id"), F.col("name").alias("owner")), ["repo_id", "parent_symbol_id"]).select("repo_id", "name", "owner").distinct())(base.symbols(s, d)),
    "x_unresolved_calls": lambda s, d: base.edges(s, d).groupBy("repo_id").agg(F.count_if(F.col("to_id").startswith("callee:")).alias("n")),
    "x_symbols_in_file": lambda s, d: base.symbols(s, d).select("repo_id", "file_path", "symbol_id", F.row_number().over(Window.partitionBy("repo_id", "file_path").orderBy("line", "symbol_id")).cast("bigint").alias("position")),
    "x_dangling_sources": lambda s, d: op.endpoints(_resolved(s, d), base.symbols(s, d), "inner").where("target_file like '%.sql'").select("repo_id", "source_file").distinct(),
    "x_edges_into": lambda s, d: op.endpoints(_resolved(s, d), base.symbols(s, d), "inner").groupBy("repo_id", "target_file").agg(F.countDistinct("source_file").alias("n")),
}

_B = "with " + base.SYM
_EP = _B + """, ep as (select e.*, a.name as source_name, a.file_path as source_file, b.name as target_name, b.file_path as target_file
    from edges e left join sym a on a.repo_id = e.repo_id and a.symbol_id = e.from_id left join sym b on b.repo_id = e.repo_id and b.symbol_id = e.to_id)"""
_TOK = "contains(to_id, ':')"
_PAIRS = _B + """, s as (select y.repo_id, y.symbol_id, y.name, y.kind, p.name as owner from sym y left join sym p on p.repo_id = y.repo_id and p.symbol_id = y.parent_symbol_id),
    pairs as (
        select s.repo_id, s.symbol_id, e.edge_id from s join edges e on e.repo_id = s.repo_id and e.to_id = s.symbol_id
        union select s.repo_id, s.symbol_id, e.edge_id from s join edges e on e.repo_id = s.repo_id and e.type = 'CALLS' and e.to_id = 'callee:' || s.name
        union select s.repo_id, s.symbol_id, e.edge_id from s join edges e on e.repo_id = s.repo_id and e.type = 'TYPE_REF' and e.to_id = 'type:' || s.name
        union select s.repo_id, s.symbol_id, e.edge_id from s join edges e on e.repo_id = s.repo_id and e.type in ('PROPERTY_REF', 'PROPERTY_WRITE') and e.to_id = 'property:' || s.name
        union select s.repo_id, s.symbol_id, e.edge_id from s join edges e on e.repo_id = s.repo_id and e.type in ('PROPERTY_REF', 'PROPERTY_WRITE') and e.to_id = 'property:' || coalesce(s.owner, '') || '.' || s.name
        union select s.repo_id, s.symbol_id, e.edge_id from s join edges e on e.repo_id = s.repo_id and e.type in ('PROPERTY_REF', 'PROPERTY_WRITE') and s.kind = 'property' and e.to_id like 'property:%.%' and regexp_extract(e.to_id, '([^.]*)$', 1) = s.name)"""
_IMPACT = _PAIRS + """, imp as (select p.repo_id, t.file_path as target_file, c.file_path as caller_file, max(e.confidence) as confidence,
        arg_max(e.reason, {'c': e.confidence, 'f': -e.edge_id}) as reason0, first(e.reason order by e.confidence desc, e.edge_id) as reason, count(distinct p.symbol_id) as n_symbols
    from pairs p join edges e on e.edge_id = p.edge_id join sym t on t.repo_id = p.repo_id and t.symbol_id = p.symbol_id join sym c on c.repo_id = p.repo_id and c.symbol_id = e.from_id
    where t.file_path <> c.file_path group by 1, 2, 3)"""
_REL = """rel as (select repo_id, count(*) as n, coalesce(median(confidence) filter (confidence <> 0.8), 1.0) as med, count(*) filter (confidence < 0.75 and confidence <> 0.8) as low, avg(contains(to_id, ':')::int) as unr from edges group by 1)"""
_USED = "used as (select distinct repo_id, to_id from edges where type in ('CALLS', 'TYPE_REF', 'IMPORTS', 'PUBLISHES', 'USES_COMPONENT'))"
_DEAD = _B + ", " + _USED + ", dead as (select repo_id, symbol_id, name, file_path, kind from sym s where not " + base.test_sql("file_path") + " and name not like '\\_%' escape '\\' and coalesce(signature, '') not like 'private %' and name not in ('constructor', 'toString', 'main', 'index', 'get', 'set')" + "".join(f" and not exists (select 1 from used u where u.repo_id = s.repo_id and u.to_id = {k})" for k in ("s.symbol_id", "'callee:' || s.name", "'type:' || s.name", "'import:' || s.name", "'component:' || s.name")) + ")"
_RES = "res as (select distinct repo_id, from_id, to_id from edges where not contains(to_id, ':') and type in ('CALLS', 'PUBLISHES', 'USES_COMPONENT', 'USES_CSS_VAR', 'USES_CSS_CLASS', 'SQL_USES', 'SQL_REFERENCES', 'SQL_GRANT', 'SQL_QUERY'))"

_RISK = "cast(floor(100 * (0.7 * least(1.0, coalesce(n.files, 0) / 50.0) + 0.15 * round(r.unr, 6) + 0.1 * (1 - round(r.med, 6)) + 0.05 * (r.low / r.n)) + 0.5) as bigint)"


def _walk(a: str, b: str, depth: int) -> str:
    return f", {_RES}, walk as (select distinct repo_id, symbol_id as id, 0 as distance from sym where kind = 'class' union select w.repo_id, r.{b}, w.distance + 1 from walk w join res r on r.repo_id = w.repo_id and r.{a} = w.id where w.distance < {depth}) select repo_id, id, min(distance) as distance from walk group by 1, 2"


_REC = "with recursive " + base.SYM
_CYC = """with cur as (select distinct repo_id, from_id as f, to_id as t from edges where not contains(to_id, ':') and type in ('CALLS', 'IMPORTS', 'DEPENDS_ON') and from_id <> to_id),
    c2 as (select a.repo_id, [a.f, a.t] as p from cur a join cur b on b.repo_id = a.repo_id and b.f = a.t and b.t = a.f where a.f < a.t),
    c3 as (select a.repo_id, [a.f, a.t, b.t] as p from cur a join cur b on b.repo_id = a.repo_id and b.f = a.t join cur c on c.repo_id = a.repo_id and c.f = b.t and c.t = a.f where a.f < a.t and a.f < b.t and a.t <> b.t),
    c4 as (select a.repo_id, [a.f, a.t, b.t, c.t] as p from cur a join cur b on b.repo_id = a.repo_id and b.f = a.t join cur c on c.repo_id = a.repo_id and c.f = b.t join cur e on e.repo_id = a.repo_id and e.f = c.t and e.t = a.f where a.f < a.t and a.f < b.t and a.f < c.t and a.t <> b.t and a.t <> c.t and b.t <> c.t),
    al as (select * from c2 union all select * from c3 union all select * from c4)
    select distinct repo_id, len(p)::int as length, least(array_to_string(p, '>'), array_to_string(list_concat(p[1:1], list_reverse(p[2:])), '>')) as cycle from al"""

SQL = {
    "g_reverse_files": "with recursive " + _EP.removeprefix("with ") + r""", fe as (select distinct repo_id, source_file as f, target_file as t from ep where not contains(to_id, ':') and source_file <> target_file),
        walk as (select repo_id, replace(path, '\\', '/') as id, 0 as distance from files group by 1, 2 having count(distinct content_hash) > 1
            union select w.repo_id, fe.f, w.distance + 1 from walk w join fe on fe.repo_id = w.repo_id and fe.t = w.id where w.distance < 2)
        select repo_id, id, min(distance) as distance from walk group by 1, 2""",
    "flt_risk": _IMPACT + ", " + _REL + """, n as (select repo_id, count(distinct caller_file) as files from imp group by 1)
        select r.repo_id, RISK as score, case when RISK >= 67 then 'high' when RISK >= 34 then 'medium' else 'low' end as level from rel r left join n on n.repo_id = r.repo_id where RISK >= 34""".replace("RISK", _RISK),
    "jn_edge_endpoints": _EP + " select edge_id, source_name, source_file, target_name, target_file from ep",
    "jn_inner_endpoints": _EP + " select edge_id, source_name, target_name from ep where source_file is not null and target_file is not null",
    "jn_symbol_token_pairs": _PAIRS + " select * from pairs",
    "jn_parent": _B + " select y.repo_id, y.symbol_id, y.name, p.name as parent_name from sym y left join sym p on p.repo_id = y.repo_id and p.symbol_id = y.parent_symbol_id",
    "jn_semi": _B + " select edge_id from edges e where exists (select 1 from sym s where s.repo_id = e.repo_id and s.symbol_id = e.from_id and kind = 'class')",
    "jn_anti": _B + " select repo_id, symbol_id from sym s where not exists (select 1 from edges e where e.repo_id = s.repo_id and e.to_id = s.symbol_id)",
    "jn_asof_enclosing": _B + ", p as (select distinct repo_id, file_path, end_line as line from sym where end_line is not null) select p.repo_id, p.file_path, p.line, (select arg_max(s.symbol_id, {'l': s.line, 'i': s.symbol_id}) from sym s where s.repo_id = p.repo_id and s.file_path = p.file_path and s.line <= p.line) as symbol_id from p",
    "jn_correlated_scalar": _B + " select repo_id, symbol_id, (select count(*) from edges e where e.repo_id = s.repo_id and e.from_id = s.symbol_id and e.type = 'CALLS') as calls from sym s",
    "flt_repo_scope": "select edge_id from edges where repo_id = 'wharf-core'",
    "flt_kind_lang_path": _B + ", " + base.FIL + " select repo_id, symbol_id from sym s where kind = 'class' and contains(file_path, 'src/') and exists (select 1 from fil f where f.repo_id = s.repo_id and f.path = s.file_path and language = 'csharp')",
    "flt_path_prefix": _B + " select repo_id, symbol_id from sym where file_path like 'packages/ledger%'",
    "flt_exclude_tests": _EP + " select edge_id from ep where target_file is null or not " + base.test_sql("target_file"),
    "flt_resolved_target": f"select edge_id from edges where not {_TOK}",
    "flt_private": _B + " select repo_id, symbol_id from sym where name not like '\\_%' escape '\\' and coalesce(signature, '') not like 'private %'",
    "flt_canonical_path": "with " + base.FIL + " select repo_id, lower(path) as asked, min(path) as path from fil group by 1, 2",
    "agg_repo_snapshot": "with " + base.FIL + " select repo_id, coalesce(language, 'unknown') as language, count(*) as n from fil group by 1, 2",
    "agg_folder_summary": _EP + ", " + base.FIL + ", cl as (select repo_id, target_file, count(distinct source_file) as n from ep where not contains(to_id, ':') and source_file <> target_file group by 1, 2) select f.repo_id, f.path as file_path, count(distinct symbol_id) as n_symbols, count(distinct case when kind in ('class', 'interface', 'function', 'type') then symbol_id end) as n_exported, coalesce(any_value(cl.n), 0) as n_callers from fil f left join sym s on s.repo_id = f.repo_id and s.file_path = f.path left join cl on cl.repo_id = f.repo_id and cl.target_file = f.path group by 1, 2",
    "agg_module_group": "with " + base.FIL + " select repo_id, case when contains(path, '/') then split_part(path, '/', 1) || '/' || split_part(path, '/', 2) else '(root)' end as module, count(*) as n from fil group by 1, 2",
    "agg_unresolved_stats": "select repo_id, count(*) filter (to_id like 'callee:%') as callee, count(*) filter (to_id like 'import:%') as import, count(*) filter (to_id like 'type:%') as type, count(*) filter (to_id like 'property:%') as property, round(case when count(*) filter (type = 'IMPORTS') > 0 then least(1.0, count(*) filter (type = 'IMPORTS' and not contains(to_id, ':')) / (count(*) filter (type = 'IMPORTS'))::double) else 1.0 end, 6) as import_ratio from edges group by 1",
    "agg_graph_health": _EP + " select repo_id, source_file, count(*) as n, count(*) filter (contains(to_id, ':')) as unresolved from ep where source_file is not null group by 1, 2",
    "agg_reliability": "with " + _REL + " select repo_id, n, round(med, 6) as median, low, round(unr, 6) as unresolved, case when unr >= 0.3 then 'many unresolved' when unr >= 0.15 then 'some unresolved' when med < 0.75 and low > 5 then 'low confidence' when unr >= 0.05 then 'few unresolved' end as warning from rel",
    "agg_impact_files": _IMPACT + " select repo_id, target_file, caller_file, confidence, reason, n_symbols from imp",
    "agg_impact_surface": _EP + " select repo_id, source_file, source_name, to_id, array_to_string(list_sort(list(distinct type)), ',') as types, max(confidence) as confidence from ep where not contains(to_id, ':') and source_file is not null and target_file is not null and not (type = 'PROPERTY_REF' and confidence < 0.7) group by 1, 2, 3, 4",
    "agg_edge_provenance": "select repo_id, count(*) as n, count(*) filter (contains(reason, 'name')) as by_name, min(confidence) as least from edges group by 1",
    "agg_blank_zones": _B + ", f as (select repo_id, file_path, count(*) = 1 and max(kind) = 'module' as b from sym group by 1, 2), r as (select repo_id, round(avg(b::int), 6) as ratio from f group by 1) select repo_id, ratio, case when ratio <= 0.4 then 'PASS' when ratio <= 0.7 then 'WARN' else 'FAIL' end as verdict from r",
    "g_dependencies": _EP + " select repo_id, edge_id, source_name, to_id, target_name from ep where type in ('IMPORTS', 'DEPENDS_ON')",
    "g_call_edges": _EP + " select repo_id, edge_id, from_id, to_id, source_name, target_name from ep where type in ('CALLS', 'PUBLISHES', 'USES_COMPONENT', 'USES_CSS_VAR', 'USES_CSS_CLASS', 'SQL_USES', 'SQL_REFERENCES', 'SQL_GRANT', 'SQL_QUERY') and (target_file is null or not " + base.test_sql("target_file") + ")",
    "g_module_flow": _EP + " select repo_id, source_file, to_id, type, min(edge_id) as edge_id, count(*) as n from ep where source_file is not null and source_file is distinct from target_file group by 1, 2, 3, 4",
    "g_trace_flow": _REC + _walk("from_id", "to_id", 3),
    "g_change_context": _REC + _walk("to_id", "from_id", 2),
    "g_interface_siblings": _B + ", im as (select distinct repo_id, from_id, to_id from edges where type = 'IMPLEMENTS'), p as (select distinct im.repo_id, a.symbol_id as a, b.symbol_id as b from im join sym a on a.repo_id = im.repo_id and a.parent_symbol_id = im.from_id and a.kind = 'method' join sym b on b.repo_id = im.repo_id and b.parent_symbol_id = im.to_id and b.kind = 'method' and a.name = b.name), u as (select repo_id, a as symbol_id, b as sibling_id from p union select repo_id, b, a from p) select * from u qualify row_number() over (partition by repo_id, symbol_id order by sibling_id) <= 20",
    "g_cycles": _CYC,
    "g_dead_code": _DEAD + " select repo_id, symbol_id, name, file_path from dead where kind in ('function', 'method', 'class', 'interface', 'variable', 'type')",
    "g_call_blind_langs": _EP + ", " + base.FIL + ", c as (select distinct ep.repo_id, f.language from ep join fil f on f.repo_id = ep.repo_id and f.path = ep.source_file where type = 'CALLS' and language is not null) select distinct repo_id, language from fil where language is not null and repo_id in (select repo_id from c) and (repo_id, language) not in (select repo_id, language from c)",
    "g_entry_points": _DEAD + r""", ways as (select repo_id, symbol_id, file_path, 1 as rank from sym where kind in ('function', 'method') and regexp_matches(file_path, '(?i)(^|/)(main|index|app|program|startup)\.[a-z]+$')
        union all select repo_id, symbol_id, file_path, 2 from dead where kind in ('function', 'method')), one as (select repo_id, symbol_id, file_path, min(rank) as rank from ways group by 1, 2, 3)
        select repo_id, symbol_id, case rank when 1 then 'bootstrap' else 'uncalled' end as how from one qualify row_number() over (partition by repo_id order by rank, file_path, symbol_id) <= 20""",
    "g_implementations": _B + " select distinct e.repo_id, s.symbol_id as iface, e.from_id as implementor from edges e join sym s on s.repo_id = e.repo_id and s.kind = 'interface' and e.to_id in (s.symbol_id, 'iface:' || s.name) where e.type = 'IMPLEMENTS'",
    "g_field_access": _PAIRS + " select p.repo_id, p.symbol_id, p.edge_id, e.type, e.from_id from pairs p join edges e using (edge_id) where e.type in ('PROPERTY_REF', 'PROPERTY_WRITE')",
    "g_rename_impact": _EP + " select repo_id, to_id, count(distinct source_file) as n_files, count(*) as n_edges from ep where source_file is not null and target_file is not null and not contains(to_id, ':') and type in ('CALLS', 'IMPORTS') group by 1, 2",
    "g_file_summary": _EP + " select distinct repo_id, target_file as file_path, source_file as imported_by from ep where not contains(to_id, ':') and type = 'IMPORTS' and source_file <> target_file",
    "g_symbol_detail": _B + ", x as (select repo_id, from_id as id, 'out' as way from edges union all select repo_id, to_id, 'in' from edges) select repo_id, id, way, count(*) as n from x where exists (select 1 from sym s where s.repo_id = x.repo_id and s.symbol_id = x.id) group by 1, 2, 3",
    "g_callers_by_name": _EP + " select distinct coalesce(target_name, regexp_replace(to_id, '^callee:', '')) as name, repo_id, from_id from ep where type = 'CALLS'",
    "g_cross_repo_impact": _B + " select e.repo_id, s.repo_id as to_repo, count(*) as n, count(distinct e.to_id) as n_symbols from edges e join sym s on s.symbol_id = e.to_id where not contains(to_id, ':') and s.repo_id <> e.repo_id group by 1, 2",
    "g_package_consumers": "select to_id as package, count(distinct repo_id) as n_repos, count(*) as n_edges from edges where to_id like 'npm:%' group by 1",
    "sink_dedup_edges": f"select max(edge_id) as edge_id from edges where not {_TOK} group by repo_id, from_id, to_id, type, assigned_expression union all select edge_id from edges where {_TOK}",
    "sink_prune_orphans": _B + " select edge_id from edges e where from_id not like 'callee:%' and not exists (select 1 from sym s where s.repo_id = e.repo_id and s.symbol_id = e.from_id)",
    "sink_prune_dangling": _B + f" select edge_id from edges e where not {_TOK} and not exists (select 1 from sym s where s.repo_id = e.repo_id and s.symbol_id = e.to_id)",
    "sink_prune_files": _B + ", " + base.FIL + " select repo_id, symbol_id from sym s where not exists (select 1 from fil f where f.repo_id = s.repo_id and f.path = s.file_path and f.language is not null)",
    "sink_replace_file": _B + " select repo_id, symbol_id, case when file_path like '%.sql' then upper(name) else name end as name from sym",
    "sink_purge_repo": _B + " select 'edges' as t, count(*) as n from edges where repo_id = 'onyx-docs' union all select 'symbols', count(*) from sym where repo_id = 'onyx-docs'",
    "sink_seed_clone": _B + " select 'onyx-docs-2' as repo_id, symbol_id, name from sym where repo_id = 'onyx-docs'",
    "win_max_rowid": "select repo_id, from_id, type, max(edge_id) as edge_id from edges group by 1, 2, 3",
    "win_latest_run": "with " + base.FIL + " select repo_id, path from fil qualify row_number() over (partition by repo_id order by updated_at desc, path) = 1",
    "win_edge_cap_per_file": _EP + " select edge_id from ep where type = 'CALLS' and source_file is not null qualify row_number() over (partition by repo_id, source_file order by edge_id) <= 20",
    "ord_case_rank": "select repo_id, from_id, edge_id from edges qualify row_number() over (partition by repo_id, from_id order by case type when 'CALLS' then 0 when 'TYPE_REF' then 1 else 2 end, edge_id) = 1",
    "lim_plus_one": "select repo_id, least(count(*), 1000) as shown, count(*) > 1000 as truncated from edges group by 1",
    "lim_offset": _B + " select repo_id, symbol_id from sym order by 1, 2 limit 50 offset 100",
    "lim_keyset": _B + " select repo_id, symbol_id from sym where file_path > 'packages/ledger' or (file_path = 'packages/ledger' and line > 5) order by file_path, line, repo_id, symbol_id limit 50",
    "x_symbol_source": _B + ", n as (select repo_id, file_path, line, lead(line) over (partition by repo_id, file_path order by line) as nx from (select distinct repo_id, file_path, line from sym)) select s.repo_id, symbol_id, s.line, coalesce(end_line, nx - 1, s.line + 200)::bigint as last_line, end_line is null as estimated from sym s join n using (repo_id, file_path, line)",
    "x_repo_lookup": _B + " select symbol_id, array_to_string(list_sort(list(distinct repo_id)), ',') as repos from sym group by 1",
    "x_csharp_types": _B + " select distinct name, kind from sym where kind in ('class', 'interface', 'struct', 'record') and file_path like '%.cs'",
    "x_member_decls": _B + " select distinct y.repo_id, y.name, p.name as owner from sym y join sym p on p.repo_id = y.repo_id and p.symbol_id = y.parent_symbol_id where y.kind in ('method', 'property')",
    "x_unresolved_calls": "select repo_id, count(*) filter (to_id like 'callee:%') as n from edges group by 1",
    "x_symbols_in_file": _B + " select repo_id, file_path, symbol_id, row_number() over (partition by repo_id, file_path order by line, symbol_id) as position from sym",
    "x_dangling_sources": _EP + " select distinct repo_id, source_file from ep where not contains(to_id, ':') and source_file is not null and target_file like '%.sql'",
    "x_edges_into": _EP + " select repo_id, target_file, count(distinct source_file) as n from ep where not contains(to_id, ':') and source_file is not null and target_file is not null group by 1, 2",
}
