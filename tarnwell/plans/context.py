"""Queries of the operators on what surrounds symbols, files and changes, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import context as op
from ..sources.tables import table
from . import base
from .graph import _B, _EP, _IMPACT, _PAIRS

SUFFIXES = ["Resolver", "Broker", "Beacon", "Bucket", "Token", "Planner", "Cursor", "Catalog"]
PREFIXES = ["Pending", "Cached", "Silent", "Stale", "Batched"]
ROLES = ["{E}Resolver", "{E}Broker", "{E}Beacon", "{E}Bucket", "{E}Token", "{E}Planner"]


def _of(function, *more):
    return lambda s, d: function(base.edges(s, d), base.symbols(s, d), *more)


def _changes(s, d):
    """Files of whose rows several contents are known, as modified, and those also known by the other separator, as renamed."""
    f = table(s, d, "files").groupBy("repo_id", fn.norm_path(F.col("path")).alias("path")).agg(F.countDistinct("content_hash").alias("n"), F.max(F.when(F.col("path").contains("\\"), F.col("path"))).alias("old_path"))
    return f.where("n > 1 or old_path is not null").select("repo_id", "path", "old_path", F.when(F.col("old_path").isNotNull(), "renamed").otherwise("modified").alias("change"))


def _routes(s, d):
    """Every method of a class as a route of that class."""
    y = base.symbols(s, d)
    owner = y.where("kind = 'class'").select("repo_id", F.col("symbol_id").alias("parent_symbol_id"), F.col("name").alias("controller"), F.col("file_path").alias("at"))
    m = y.where("kind = 'method'").join(owner, ["repo_id", "parent_symbol_id"]).groupBy("repo_id", "controller", F.col("name").alias("handler")).agg(F.min("at").alias("file_path"))
    verb = F.when(F.col("handler").rlike("^(fetch|get|load|probe|rank)"), "GET").otherwise("POST")
    return m.select("repo_id", F.concat_ws(".", "controller", "handler").alias("route_id"), "controller", "handler", "file_path", verb.alias("verb"), F.lower(F.concat(F.lit("/"), "controller", F.lit("/"), "handler")).alias("path"))


def _asked(s, d):
    """Packages to ask for: those of the edges, and each with a letter more."""
    p = base.edges(s, d).where("type = 'DEPENDS_ON'").select(F.regexp_replace("to_id", "^npm:", "").alias("package")).distinct()
    return p.unionByName(p.select(F.concat("package", F.lit("x")).alias("package")))


def _renumbered(s, d):
    y = base.symbols(s, d).select("repo_id", "name", "symbol_id")
    return op.ids_at_risk(y.withColumn("new", fn.stable_id(F.concat("symbol_id", F.lit("+1")))), ["repo_id", "name"], "symbol_id", "symbol_id", "new")


def _objects(s, d):
    a = table(s, d, "audit_log").where("target_table is not null").distinct()
    action = F.when(F.col("statement_type") == "DROP", "drop").otherwise("define")
    return a.select(F.lower("target_table").alias("key"), F.struct("ts", "id").alias("seq"), action.alias("action"), F.col("sql_hash").alias("definition"))


def _batches(by):
    return lambda s, d: op.file_context(base.symbols(s, d), base.edges(s, d), base.files(s, d).select("repo_id", F.col("path").alias("file_path"), by(F.col("path")).alias("batch")), 20)


def _contents(s, d):
    return table(s, d, "file_contents")


QUERIES = {
    "g_references": lambda s, d: op.references(base.symbols(s, d), base.edges(s, d)),
    "g_file_context": _batches(lambda p: p),
    "g_batch_context": _batches(lambda p: F.substring_index(p, "/", 2)),
    "g_impact_seed": lambda s, d: op.impact_seed(base.symbols(s, d), base.edges(s, d)),
    "g_change_impact": lambda s, d: op.change_impact(_changes(s, d), base.symbols(s, d), base.edges(s, d)),
    "g_route_map": lambda s, d: op.route_map(_routes(s, d), base.symbols(s, d)),
    "r_route_handlers": lambda s, d: op.route_handlers(_routes(s, d), base.symbols(s, d)),
    "r_interface_dispatch": _of(op.dispatch, "IMPLEMENTS"),
    "r_base_dispatch": _of(op.dispatch, "EXTENDS"),
    "x_typed_dispatch": _of(op.typed_dispatch),
    "jn_fk_reach2": _of(op.fixture_reach, fn.is_test_path),
    "x_importing_files": _of(op.importing_files),
    "x_ids_at_risk": _renumbered,
    "x_provider_symbol": _of(op.provider_symbols),
    "g_package_providers": _of(op.package_providers),
    "g_package_exists": lambda s, d: op.package_exists(_asked(s, d), base.edges(s, d)),
    "g_package_similar": lambda s, d: op.package_similar(_asked(s, d), base.edges(s, d)),
    "agg_package_bridge": _of(op.package_bridge),
    "g_feature_bundle": lambda s, d: op.feature_bundle(base.symbols(s, d).where("kind = 'class'").select("repo_id", F.col("name").alias("seed")), base.symbols(s, d), SUFFIXES, PREFIXES, ROLES),
    "context_pack": lambda s, d: op.context_pack(base.symbols(s, d), base.edges(s, d), "lookup"),
    "g_sql_superseded": lambda s, d: op.superseded(_objects(s, d)),
    "agg_literal_roles": lambda s, d: op.literal_roles(_contents(s, d)),
    "g_value_contract": lambda s, d: op.value_contracts(op.literal_roles(_contents(s, d))),
    "x_unify_via": lambda s, d: op.unify_via(base.edges(s, d)),
    "x_suppress_bare": _of(op.suppress_bare, "name_resolved", "resolved call edge"),
    "x_cross_repo_deps": lambda s, d: base.edges(s, d).where(F.coalesce(F.col("reason").contains("cross-repo"), F.lit(False))).groupBy("repo_id", F.col("from_id").alias("symbol_id")).agg(F.countDistinct("to_id").alias("n_targets"), F.count(F.lit(1)).alias("n_edges")),
    "x_applied_hashes": lambda s, d: table(s, d, "ddl_history").where("status = 'applied'").withColumn("rn", F.row_number().over(Window.partitionBy("environment", "name").orderBy(F.desc("applied_at"), F.desc("id")))).where("rn = 1").select("environment", "name", "checksum"),
    "ord_rowid": lambda s, d: op._first(base.edges(s, d), ["repo_id", "from_id"], F.desc("confidence"), "edge_id").select("repo_id", "from_id", "edge_id"),
}

_DISPATCH = _B + """, link as (select distinct repo_id, from_id as taker, to_id as giver from edges where type = '{t}' and not contains(to_id, ':')),
    plan as (select distinct l.repo_id, g.symbol_id as called, k.symbol_id as to_id from link l join sym g on g.repo_id = l.repo_id and g.parent_symbol_id = l.giver and g.kind = 'method'
        join sym k on k.repo_id = l.repo_id and k.parent_symbol_id = l.taker and k.name = g.name and k.kind = 'method'),
    capped as (select * from plan qualify row_number() over (partition by repo_id, called order by to_id) <= 10),
    calls as (select distinct repo_id, from_id, to_id from edges where type = 'CALLS')
    select distinct c.repo_id, c.from_id, p.to_id, 0.7::double as confidence from calls c join capped p on p.repo_id = c.repo_id and p.called = c.to_id
    where not exists (select 1 from calls x where x.repo_id = c.repo_id and x.from_id = c.from_id and x.to_id = p.to_id)"""
_SIB = _B + """, im as (select distinct repo_id, from_id as cls, to_id as iface from edges where type = 'IMPLEMENTS'),
    pr as (select a.repo_id, a.symbol_id as x, b.symbol_id as y from im join sym a on a.repo_id = im.repo_id and a.parent_symbol_id = im.cls and a.kind = 'method'
        join sym b on b.repo_id = im.repo_id and b.parent_symbol_id = im.iface and b.name = a.name and b.kind = 'method'),
    sib as (select * from (select repo_id, x as symbol_id, y as sibling_id from pr union select repo_id, y, x from pr) qualify row_number() over (partition by repo_id, symbol_id order by sibling_id) <= 20)"""
_ROUTES = """own as (select m.repo_id, m.symbol_id, m.name as handler, c.name as controller, c.kind as okind, m.kind as mkind, m.file_path as handler_file, c.file_path as home
        from sym m join sym c on c.repo_id = m.repo_id and c.symbol_id = m.parent_symbol_id where m.kind in ('method', 'function') and c.kind in ('class', 'interface', 'record', 'struct')),
    routes as (select repo_id, controller || '.' || handler as route_id, controller, handler, min(home) as file_path from own where okind = 'class' and mkind = 'method' group by 1, 2, 3, 4),
    cand as (select r.repo_id, r.route_id, o.symbol_id, len(list_filter(range(1, least(len(string_split(r.file_path, '/')), len(string_split(o.handler_file, '/')))),
            lambda k: string_split(r.file_path, '/')[1:k] = string_split(o.handler_file, '/')[1:k])) as depth
        from routes r join own o on o.repo_id = r.repo_id and o.controller = r.controller and o.handler = r.handler),
    bound as (select repo_id, route_id, arg_min(symbol_id, {'a': -depth, 'b': symbol_id}) as handler_id from cand group by 1, 2 having count(*) = 1 or max(depth) > 0)"""
_CONTEXT = _EP + """, bf as (select repo_id, replace(path, '\\', '/') as file_path from files group by 1, 2),
    side as (select repo_id, edge_id, type, source_file as file_path, 1 as o from ep where source_file is not null union all select repo_id, edge_id, type, target_file, 0 from ep where target_file is not null),
    met as (select s.repo_id, {batch} as batch, edge_id, min(type) as type, min(o) as a, max(o) as b from side s join bf using (repo_id, file_path) group by 1, 2, 3),
    rk as (select repo_id, batch, edge_id, case when a < b then 'inner' when a = 1 then 'out' else 'in' end as way, count(*) over (partition by repo_id, batch) > 20 as truncated,
        row_number() over (partition by repo_id, batch order by case when type in ('CALLS', 'PUBLISHES', 'USES_COMPONENT', 'USES_CSS_VAR', 'USES_CSS_CLASS', 'SQL_USES', 'SQL_REFERENCES', 'SQL_GRANT', 'SQL_QUERY') then 0
            when type in ('IMPORTS', 'DEPENDS_ON') then 1 when type = 'TYPE_REF' then 2 else 3 end, edge_id) as position from met)
    select * from rk where position <= 20"""
_PKG = _B + """, used as (select distinct regexp_replace(to_id, '^(npm|nuget):', '') as package, repo_id as consumer_repo from edges where regexp_matches(to_id, '^(npm|nuget):')),
    prov as (select distinct package, y.repo_id as provider_repo, consumer_repo from used join sym y on y.name = package where y.repo_id <> consumer_repo)"""
_ASK = """known as (select distinct regexp_replace(to_id, '^(npm|nuget):', '') as package from edges where regexp_matches(to_id, '^(npm|nuget):')),
    dep as (select distinct regexp_replace(to_id, '^npm:', '') as package from edges where type = 'DEPENDS_ON'), asked as (select package from dep union select package || 'x' from dep)"""
_ROLE = r"""kinds as (select repo_id, unnest(regexp_extract_all(content, '[''"]([A-Za-z][\w.-]*)[''"]', 1)) as value, 'a' as kind from file_contents
    union all select repo_id, unnest(regexp_extract_all(content, '(?:[=!]==?|\bcase|\bin|\bincludes\(|\bfrom|\brequire\()\s*\(?[''"]([A-Za-z][\w.-]*)[''"]', 1)), 'c' from file_contents
    union all select repo_id, unnest(regexp_extract_all(content, '(?:[^=!<>]=|\breturn|:|=>)\s*[''"]([A-Za-z][\w.-]*)[''"]', 1)), 'p' from file_contents),
    roles as (select value, repo_id, count(*) filter (kind = 'p') as producer, count(*) filter (kind = 'c') as consumer,
        greatest(count(*) filter (kind = 'a') - count(*) filter (kind = 'p') - count(*) filter (kind = 'c'), 0) as unknown from kinds group by 1, 2)"""
_BUNDLE_ROLES = ", ".join(f"('{r}')" for r in ROLES)

SQL = {
    "g_references": _PAIRS + " select p.repo_id, p.symbol_id, p.edge_id, e.type, e.from_id, a.file_path as source_file from pairs p join edges e on e.edge_id = p.edge_id left join sym a on a.repo_id = e.repo_id and a.symbol_id = e.from_id",
    "g_file_context": _CONTEXT.replace("{batch}", "file_path"),
    "g_batch_context": _CONTEXT.replace("{batch}", "array_to_string(string_split(file_path, '/')[1:2], '/')"),
    "g_impact_seed": _SIB + """, own as (select repo_id, file_path, symbol_id, row_number() over (partition by repo_id, file_path
            order by case when kind in ('class', 'interface', 'struct', 'record', 'type') then 0 else 1 end, line, symbol_id) as rn from sym where kind <> 'module')
        select repo_id, file_path, symbol_id, 'own' as how from own
        union all select distinct o.repo_id, o.file_path, s.sibling_id, 'sibling' from own o join sib s on s.repo_id = o.repo_id and s.symbol_id = o.symbol_id where rn <= 60
            and not exists (select 1 from own x where x.repo_id = o.repo_id and x.file_path = o.file_path and x.symbol_id = s.sibling_id)""",
    "g_change_impact": _IMPACT + r""", f as (select repo_id, replace(path, '\', '/') as path, count(distinct content_hash) as n, max(case when contains(path, '\') then path end) as old_path from files group by 1, 2),
        raw as (select repo_id, path, case when old_path is not null then 'added' else 'modified' end as change from f where n > 1 or old_path is not null
            union all select repo_id, old_path, 'removed' from f where old_path is not null),
        c as (select repo_id, path from raw group by 1, 2),
        m as (select i.repo_id, i.caller_file, i.confidence from imp i join c on c.repo_id = i.repo_id and c.path = i.target_file where not exists (select 1 from c x where x.repo_id = i.repo_id and x.path = i.caller_file)),
        per as (select repo_id, count(distinct caller_file) as n, max(confidence) as confidence from m group by 1)
        select c.repo_id, count(*) as n_changed, coalesce(any_value(p.n), 0) as n_affected, any_value(p.confidence) as confidence,
            case when coalesce(any_value(p.n), 0) > 20 then 'high' when coalesce(any_value(p.n), 0) > 5 then 'medium' else 'low' end as level
        from c left join per p on p.repo_id = c.repo_id group by c.repo_id""",
    "g_route_map": _B + ", " + _ROUTES + """ select r.repo_id, r.route_id, case when regexp_matches(handler, '^(fetch|get|load|probe|rank)') then 'GET' else 'POST' end as verb,
        lower('/' || controller || '/' || handler) as path, b.handler_id, handler as handler_name from routes r left join bound b on b.repo_id = r.repo_id and b.route_id = r.route_id""",
    "r_route_handlers": _B + ", " + _ROUTES + " select * from bound",
    "r_interface_dispatch": _DISPATCH.replace("{t}", "IMPLEMENTS"),
    "r_base_dispatch": _DISPATCH.replace("{t}", "EXTENDS"),
    "x_typed_dispatch": _B + """, n as (select e.repo_id, i.symbol_id as interface_id, count(*) as n_calls from edges e join sym m on m.repo_id = e.repo_id and m.symbol_id = e.to_id and m.kind = 'method'
            join sym i on i.repo_id = m.repo_id and i.symbol_id = m.parent_symbol_id and i.kind = 'interface' where e.type = 'CALLS' group by 1, 2),
        l as (select distinct repo_id, to_id as interface_id, from_id as implementor_id from edges where type = 'IMPLEMENTS' and not contains(to_id, ':'))
        select repo_id, interface_id, implementor_id, n_calls from n join l using (repo_id, interface_id) qualify row_number() over (partition by repo_id, interface_id order by implementor_id) <= 10""",
    "jn_fk_reach2": _B + f""", c as (select distinct repo_id, from_id, to_id from edges where type = 'CALLS' and not contains(to_id, ':'))
        select distinct a.repo_id, b.to_id as source_id, a.from_id as test_id from c a join c b on b.repo_id = a.repo_id and b.from_id = a.to_id
        join sym t on t.repo_id = a.repo_id and t.symbol_id = a.from_id join sym x on x.repo_id = b.repo_id and x.symbol_id = b.to_id where {base.test_sql("t.file_path")} and not {base.test_sql("x.file_path")}""",
    "x_importing_files": _EP + " select distinct repo_id, target_file as file_path, source_file as importer from ep join sym m using (repo_id) where m.symbol_id = to_id and m.kind = 'module' and ep.type = 'IMPORTS' and source_file <> target_file",
    "x_ids_at_risk": _B + """, y as (select repo_id, name, symbol_id, substr(sha256(symbol_id || '+1'), 1, 24) as new from sym)
        select distinct a.repo_id, a.name, a.symbol_id from y a join y b on b.repo_id = a.repo_id and b.name = a.name and ((a.symbol_id < b.symbol_id and a.new > b.new) or (a.symbol_id > b.symbol_id and a.new < b.new))""",
    "x_provider_symbol": _B + """, own as (select * from sym where kind in ('class', 'interface', 'struct', 'record', 'type')), used as (select distinct repo_id, regexp_replace(to_id, '^type:', '') as type from edges where starts_with(to_id, 'type:')),
        p as (select name, arg_min({'r': repo_id, 's': symbol_id}, {'a': repo_id, 'b': file_path, 'c': symbol_id}) as b from own group by 1)
        select u.repo_id, u.type, p.b.r as provider_repo, p.b.s as symbol_id from used u join p on p.name = u.type where not exists (select 1 from own o where o.repo_id = u.repo_id and o.name = u.type)""",
    "g_package_providers": _PKG + " select * from prov",
    "g_package_exists": "with " + _ASK + " select a.package, k.package is not null as found from asked a left join known k on k.package = a.package",
    "g_package_similar": "with " + _ASK + " select a.package, k.package as similar from asked a join known k on lower(k.package[1:6]) = lower(a.package[1:6]) and k.package <> a.package qualify row_number() over (partition by a.package order by k.package) <= 10",
    "agg_package_bridge": _PKG + """, tried as (select distinct repo_id, from_id, regexp_replace(to_id, '^(npm|nuget):', '') as package from edges where regexp_matches(to_id, '^(npm|nuget):'))
        select t.repo_id, count(*) as attempted, count(*) filter (exists (select 1 from prov p where p.consumer_repo = t.repo_id and p.package = t.package)) as resolved from tried t group by 1""",
    "g_feature_bundle": _B + f""", seed as (select distinct repo_id, name as seed from sym where kind = 'class'),
        e as (select *, regexp_replace(regexp_replace(seed, '(?:{"|".join(sorted(SUFFIXES, key=lambda x: (-len(x), x)))})$', ''), '^(?:{"|".join(PREFIXES)})([A-Z])', '\\1') as entity from seed),
        x as (select e.repo_id, seed, entity, r.role, y.symbol_id, y.file_path from e, (values {_BUNDLE_ROLES}) r(role), sym y where entity <> '' and entity <> seed and y.repo_id = e.repo_id and y.name = replace(r.role, '{{E}}', entity))
        select repo_id, seed, entity, role, symbol_id from x qualify row_number() over (partition by repo_id, seed order by role, file_path, symbol_id) <= 50""",
    "context_pack": _SIB + """, kr as (select *, case kind when 'method' then 0 when 'function' then 1 when 'constructor' then 2 when 'class' then 3 when 'interface' then 4 when 'struct' then 5 when 'record' then 6 when 'property' then 7 when 'variable' then 8 else 999 end as r from sym where lower(name) = 'lookup'),
        best as (select repo_id, symbol_id from kr qualify row_number() over (partition by repo_id order by case when name = 'lookup' then 0 else 1 end, r, file_path, symbol_id) = 1),
        meant as (select * from best union select b.repo_id, s.sibling_id from best b join sib s on s.repo_id = b.repo_id and s.symbol_id = b.symbol_id),
        e as (select repo_id, from_id, to_id, type in ('IMPORTS', 'DEPENDS_ON') as dep, type in ('CALLS', 'PUBLISHES', 'USES_COMPONENT', 'USES_CSS_VAR', 'USES_CSS_CLASS', 'SQL_USES', 'SQL_REFERENCES', 'SQL_GRANT', 'SQL_QUERY') as call from edges where not contains(to_id, ':')),
        rows as (select e.repo_id, 'caller' as role, e.from_id as symbol_id from e join meant m on m.repo_id = e.repo_id and m.symbol_id = e.to_id where call
            union select e.repo_id, 'callee', e.to_id from e join best b on b.repo_id = e.repo_id and b.symbol_id = e.from_id where call
            union select e.repo_id, 'importer', e.from_id from e join best b on b.repo_id = e.repo_id and b.symbol_id = e.to_id where dep)
        select repo_id, 'symbol' as role, symbol_id from best union all select repo_id, role, symbol_id from (select * from rows qualify row_number() over (partition by repo_id, role order by symbol_id) <= 20)""",
    "g_sql_superseded": """with a as (select distinct id, ts, lower(target_table) as key, case when statement_type = 'DROP' then 'drop' else 'define' end as action, sql_hash as definition from audit_log where target_table is not null),
        l as (select key, arg_max({'a': action, 'd': definition}, {'t': ts, 'i': id}) as last from a group by 1)
        select distinct key, definition, case when last.a <> 'drop' then last.d end as current from a join l using (key) where action <> 'drop' and not (last.a <> 'drop' and definition = last.d)""",
    "agg_literal_roles": "with " + _ROLE + " select * from roles",
    "g_value_contract": "with " + _ROLE + " select value, count(*) filter (producer > 0) as producers, count(*) filter (consumer > 0) as consumers, count(*) as repos from roles group by 1 having producers > 0 and consumers > 0 and repos > 1",
    "x_unify_via": "select repo_id, from_id, to_id, min(reason) as reason from edges where type = 'CALLS' and not contains(to_id, ':') group by 1, 2, 3",
    "x_suppress_bare": _EP + """, q as (select repo_id, from_id, target_name, to_id from ep where type = 'CALLS' and reason = 'resolved call edge' and source_file is not null and target_file is not null)
        select edge_id, 'callee:' || target_name as to_id, 0.1::double as confidence from ep e where type = 'CALLS' and reason = 'name_resolved' and source_file <> target_file
        and exists (select 1 from q where q.repo_id = e.repo_id and q.from_id = e.from_id and q.target_name = e.target_name and q.to_id <> e.to_id)""",
    "x_cross_repo_deps": "select repo_id, from_id as symbol_id, count(distinct to_id) as n_targets, count(*) as n_edges from edges where contains(reason, 'cross-repo') group by 1, 2",
    "x_applied_hashes": "select environment, name, checksum from (select distinct * from ddl_history) where status = 'applied' qualify row_number() over (partition by environment, name order by applied_at desc, id desc) = 1",
    "ord_rowid": "select repo_id, from_id, edge_id from edges qualify row_number() over (partition by repo_id, from_id order by confidence desc nulls last, edge_id) = 1",
}
