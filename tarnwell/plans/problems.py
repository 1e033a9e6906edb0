"""Queries of the general data problems (1, 4 and 5) and their SQL."""

from __future__ import annotations

from ..operators import hierarchy, hotkeys, references
from ..sources.tables import table

_CUR = """
    select repo_id, symbol_id, min(recorded_at) as first_at, bool_or(deleted_at is null and recorded_at = last_at) as live,
           max(case when recorded_at = last_at then parent_symbol_id end) as parent
    from (select *, max(recorded_at) over (partition by repo_id, symbol_id) as last_at from symbols)
    group by repo_id, symbol_id"""

_STATES = f"""
    with cur as ({_CUR}),
    anywhere as (select symbol_id, bool_or(live) as live, min(case when live then first_at end) as first_at from cur group by symbol_id),
    claim as (select edge_id, repo_id, to_id, recorded_at, coalesce(contains(reason, 'cross-repo'), false) as wide
              from edges where to_id is not null and not contains(to_id, ':')),
    met as (
        select edge_id, c.recorded_at, s.symbol_id is not null as seen, s.live, s.first_at
        from claim c left join cur s on s.repo_id = c.repo_id and s.symbol_id = c.to_id where not wide
        union all
        select edge_id, c.recorded_at, s.symbol_id is not null, s.live, s.first_at
        from claim c left join anywhere s on s.symbol_id = c.to_id where wide),
    states as (
        select edge_id, recorded_at,
               case when not seen then 'never_seen' when not live then 'deleted' when recorded_at < first_at then 'late' end as target_state
        from met)"""

_TREE = f"""
    with recursive cur as ({_CUR}),
    live as (select repo_id, symbol_id, parent from cur where live),
    node as (select l.repo_id, l.symbol_id, p.symbol_id as parent
             from live l left join live p on p.repo_id = l.repo_id and p.symbol_id = l.parent),
    walk as (
        select repo_id, symbol_id, symbol_id as path, 0 as depth, symbol_id as root_id from node where parent is null
        union all
        select n.repo_id, n.symbol_id, w.path || '/' || n.symbol_id, w.depth + 1, w.root_id
        from walk w join node n on n.repo_id = w.repo_id and n.parent = w.symbol_id),
    lost as (select * from node n where not exists (select 1 from walk w where w.repo_id = n.repo_id and w.symbol_id = n.symbol_id)),
    climb as (
        select repo_id, symbol_id, parent as up_id from lost
        union
        select c.repo_id, c.symbol_id, l.parent from climb c join lost l on l.repo_id = c.repo_id and l.symbol_id = c.up_id),
    closed as (select distinct repo_id, symbol_id from climb where symbol_id = up_id)"""

QUERIES = {
    "p1_found": lambda s, d: hotkeys.heavy_keys(table(s, d, "edges")).select("to_id", "type"),
    "p1_key_totals": lambda s, d: hotkeys.hot_key_profile(table(s, d, "edges")),
    "p4_found": lambda s, d: references.orphan_edges(table(s, d, "edges"), table(s, d, "symbols")),
    "p4_orphans_by_period": lambda s, d: references.orphans_by_period(table(s, d, "edges"), table(s, d, "symbols")),
    "p5_found": lambda s, d: hierarchy.closed_chains(table(s, d, "symbols")),
    "p5_hierarchy": lambda s, d: hierarchy.hierarchy(table(s, d, "symbols")),
    "p5_descendants": lambda s, d: hierarchy.descendants(table(s, d, "symbols")),
}

SQL = {
    "p1_found": "select to_id, type from edges group by to_id, type having count(*) >= 0.01 * (select count(*) from edges)",
    "p1_key_totals": "select to_id, type, count(*) as n_rows, count(distinct repo_id) as n_repos, count(distinct from_id) as n_from from edges group by to_id, type",
    "p4_found": _STATES + " select edge_id from states where target_state in ('never_seen', 'deleted')",
    "p4_orphans_by_period": _STATES
    + """ select 'edges' as child_table, 'symbols' as parent_table, strftime(recorded_at, '%Y-%m') as period,
        count(*) filter (target_state = 'never_seen') as never_seen, count(*) filter (target_state = 'deleted') as deleted, count(*) filter (target_state = 'late') as late
        from states where target_state is not null group by 3""",
    "p5_found": _TREE + " select repo_id, symbol_id from closed",
    "p5_hierarchy": _TREE
    + """, below as (
        select c.repo_id, c.up_id as symbol_id, count(*) as n from (
            select n.repo_id, n.symbol_id, unnest(string_split(w.path, '/')) as up_id from node n join walk w using (repo_id, symbol_id)) c
        where c.up_id <> c.symbol_id group by 1, 2),
    hang as (
        select repo_id, up_id as symbol_id, count(*) as n from climb where symbol_id <> up_id group by 1, 2)
    select n.repo_id, n.symbol_id, w.path, cast(w.depth as bigint) as depth, w.root_id,
           case when k.symbol_id is null then coalesce(b.n, h.n, 0) end as n_descendants,
           case when k.symbol_id is not null then 'cycle' when w.path is null then 'below_cycle' else 'tree' end as state
    from node n left join walk w using (repo_id, symbol_id) left join closed k using (repo_id, symbol_id)
    left join below b using (repo_id, symbol_id) left join hang h using (repo_id, symbol_id)""",
    "p5_descendants": _TREE
    + """ select repo_id, symbol_id, descendant_id, distance from (
        select w.repo_id, w.symbol_id as descendant_id, p.id as symbol_id, cast(w.depth - p.i + 1 as bigint) as distance
        from walk w, lateral (select unnest(string_split(w.path, '/')) as id, generate_subscripts(string_split(w.path, '/'), 1) as i) p)
        where distance > 0""",
}
