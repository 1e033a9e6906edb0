"""Reference operators: small fixtures, plan shapes, and the queries against their SQL."""

import os
from collections import Counter
from datetime import datetime, timezone
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tarnwell.functions import scalar as fn
from tarnwell.operators import graph, logs, search, sqlguard, tabular

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
SAMPLE = ["p1_found", "p1_key_totals", "p4_found", "p4_orphans_by_period", "p5_found", "agg_service_inventory", "agg_fingerprint", "jn_symbol_token_pairs", "g_cycles", "r_calls", "fts_rank", "vector_knn", "st_incremental", "sql_ddl_status", "g_references", "g_file_context", "g_route_map", "x_ids_at_risk", "r_best_candidate", "r_mentions", "g_reverse_files", "flt_risk", "src_http_logs", "sql_readonly", "sql_scan", "x_git_changes", "x_module_specifier", "search_padding", "sql_ddl_plan"]
NAMES = [n for n in entry.oracle_sql() if n in SAMPLE or os.environ.get("TEST_ALL_QUERIES")]


def _norm(v):
    return round(v, 5) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, datetime) else v


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = entry.queries()[name](spark, str(SF))
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    got = [d[0] for d in cur.description]
    assert sorted(got) == cols
    assert Counter(tuple(_norm(r[got.index(c)]) for c in cols) for r in cur.fetchall()) == Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_token_pairs_plan_has_no_nested_loop(spark):
    df = entry.queries()["jn_symbol_token_pairs"](spark, str(SF))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cycle_and_its_reverse_are_one(spark, rows):
    e = spark.createDataFrame([("r", a, b) for a, b in ["ab", "bc", "ca", "cb", "ac", "ba", "dd", "de"]], "repo_id string, from_id string, to_id string")
    assert rows(graph.cycles(e, 3)) == [("r", 2, "a>b"), ("r", 2, "a>c"), ("r", 2, "b>c"), ("r", 3, "a>b>c")]


def test_fingerprint_ignores_order_but_not_counts(spark):
    f = lambda r: tuple(tabular.fingerprint(spark.createDataFrame(r, "a int, b string"), ["a", "b"]).first())
    assert f([(1, "x"), (2, None)]) == f([(2, None), (1, "x")])
    assert f([(1, "x")]) != f([(1, "x"), (1, "x")])
    assert f([]) == (0, "")
    assert f([(1, None)]) != f([(1, "")])


def test_epoch_units(spark):
    from pyspark.sql import functions as F

    t = 1704067200
    df = spark.createDataFrame([(t,), (t * 1000,), (t * 10**6,), (t * 10**9,)], "x bigint").select(fn.epoch_to_timestamp(F.col("x")).alias("t"))
    assert {r.t.strftime("%Y-%m-%d") for r in df.collect()} == {"2024-01-01"}


def test_scalar_functions(spark):
    from pyspark.sql import functions as F

    df = spark.range(1)
    one = lambda c: df.select(c.alias("x")).first().x
    assert one(fn.split_case(F.lit("parseHTTPRequest"))) == "parse HTTP Request"
    assert one(fn.djb2(F.lit("a"))) == 5381 * 33 + 97
    assert one(fn.dice(F.lit("night"), F.lit("nacht"))) == 0.25
    assert one(fn.norm_endpoint(F.lit('"https://h/A//b?x#y"'))) == "/a/b"
    assert one(fn.param_count(F.lit("f(a: Map<x, y>, b = g(1, 2))"))) == 2
    assert one(fn.param_count(F.lit("f()"))) == 0
    assert one(fn.fold_diacritics(F.lit("Đường dẫn"))) == "Duong dan"
    assert abs(sum(v * v for v in one(fn.trigram_vector(F.lit("walker tree")))) - 1) < 1e-9
    assert one(fn.redact(F.lit("pg://u:p@h token=x a@b.c"))) == "pg://***@h token=*** ***@***"


def test_windows():
    now = datetime(2024, 1, 2, tzinfo=timezone.utc)
    assert logs.window(now, "15m")[0].minute == 45
    assert logs.window(now, start="1704067200000")[0] == datetime(2024, 1, 1, tzinfo=timezone.utc)
    for bad in ({"time": "8d"}, {"start": "2024-01-02", "end": "2024-01-01"}, {"time": "soon"}):
        with pytest.raises(ValueError):
            logs.window(now, **bad)


@pytest.mark.parametrize("sql", ["select 1", "with a as (select 1) select * from a;", "select 'drop table x' -- delete", "select $$;$$"])
def test_guard_accepts(sql):
    sqlguard.check(sql)


@pytest.mark.parametrize("sql", ["", "delete from x", "select 1; select 2", "with a as (delete from x returning 1) select * from a", "select 'open", "explain select 1", "/* x", "create table y as select 1"])
def test_guard_refuses(sql):
    with pytest.raises(sqlguard.Refused):
        sqlguard.check(sql)


def test_scoped_query_sees_its_scope_only(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "repo_id string, v int")
    assert [r.v for r in sqlguard.scoped_query(spark, {"t": df}, "select v from t", "a")[0].collect()] == [1]
    with pytest.raises(sqlguard.Refused):
        sqlguard.scoped_query(spark, {"t": df}, "select * from other", "a")


def test_lint():
    assert sqlguard.lint("create index i on t (a); drop table t") == ["locks writes", "loses data"]


def test_knn_in_blocks_is_exact(spark):
    import random

    rnd = random.Random(3)
    v = [(i, [rnd.random() for _ in range(4)]) for i in range(60)] + [(60, [0.5] * 4), (61, [0.5] * 4)]
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in search.knn(df, df.where("vec_id % 20 = 0"), 3, block=16).collect()}
    data = {r.vec_id: r.embedding for r in df.collect()}
    for q in (0, 20, 40, 60):
        best = sorted((sum((a - b) ** 2 for a, b in zip(data[q], data[i])) ** 0.5, i) for i in data if i != q)[:3]
        assert [got[q, k] for k in (1, 2, 3)] == [i for _, i in best]
