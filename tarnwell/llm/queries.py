"""Queries of the training-data problems (2, 3, 6, 7, 8, 9) and their SQL where there is any."""

from __future__ import annotations

from ..sources.tables import table
from . import handwritten, leakage, mixing, residue, sketch, syntax


def _percentiles(s, d):
    return sketch.percentiles(table(s, d, "ddl_history"), table(s, d, "audit_log"))


QUERIES = {
    "p2_percentiles": _percentiles,
    "p2_daily": lambda s, d: _percentiles(s, d).where("period = 'day'").drop("period", "rank_error"),
    "p3_found": lambda s, d: syntax.invalid_files(table(s, d, "file_contents"), table(s, d, "files")),
    "p3_file_report": lambda s, d: syntax.syntax_report(table(s, d, "file_contents"), table(s, d, "files")),
    "p3_rates": lambda s, d: syntax.invalid_rates(table(s, d, "file_contents"), table(s, d, "files")),
    "p6_found": lambda s, d: handwritten.foreign_files(table(s, d, "file_contents"), table(s, d, "files")),
    "p6_labels": lambda s, d: handwritten.labels(table(s, d, "file_contents"), table(s, d, "files")),
    "p7_found": lambda s, d: leakage.leaks(table(s, d, "documents"), table(s, d, "eval_items")).select("doc_id", "item_id"),
    "p7_leak_report": lambda s, d: leakage.leak_report(table(s, d, "documents"), table(s, d, "eval_items")),
    "p8_mix": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p8_shares": lambda s, d: mixing.shares(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p9_found": lambda s, d: residue.residue(table(s, d, "documents")).select("doc_id"),
    "p9_residue_kinds": lambda s, d: residue.residue(table(s, d, "documents")),
}

#: Exact as long as no day has more values than a sketch holds before it compacts, which is so at scale 0.01.
_DAILY = """
    with v as (
        select 'ddl_history' as source_table, 'duration_ms' as metric, environment as grp, cast(applied_at as date) as d, duration_ms as value
        from (select distinct id, environment, applied_at, duration_ms from ddl_history)
        union all
        select 'audit_log', 'rows_affected', tool, cast(ts as date), rows_affected from (select distinct id, tool, ts, rows_affected from audit_log))
    select source_table, metric, grp, cast(d as varchar) as day, count(*) as n,
           cast(quantile_disc(value, 0.5) as double) as p50, cast(quantile_disc(value, 0.9) as double) as p90, cast(quantile_disc(value, 0.99) as double) as p99
    from v where value >= 0 group by 1, 2, 3, 4"""

SQL: dict[str, str] = {"p2_daily": _DAILY}
