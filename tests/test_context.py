"""Contexts, dispatch, imports, remote sources, streams and the guard on small tables with nulls, ties and empty inputs."""

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnwell.functions.scalar import is_test_path
from tarnwell.operators import context, graph, hierarchy, imports, resolve, search, sections, sqlguard, tabular
from tarnwell.sources import files, git, remote
from tarnwell.streaming import changes

SYMBOL = "repo_id string, symbol_id string, file_path string, name string, kind string, line int, signature string, parent_symbol_id string"
EDGE = "edge_id bigint, repo_id string, from_id string, to_id string, type string, confidence double, reason string, assigned_expression string"


@pytest.fixture(scope="module")
def code(spark):
    y = [
        ("r", "I", "src/i.cs", "Walker", "interface", 1, None, None), ("r", "Im", "src/i.cs", "Run", "method", 2, None, "I"), ("r", "A", "src/a.cs", "FastWalker", "class", 1, None, None),
        ("r", "Am", "src/a.cs", "Run", "method", 2, None, "A"), ("r", "B", "src/b.cs", "SlowWalker", "class", 1, None, None), ("r", "Bm", "src/b.cs", "Run", "method", 2, None, "B"),
        ("r", "C", "src/c.cs", "Caller", "function", 1, None, None), ("r", "T", "tests/c_test.py", "check", "function", 1, None, None), ("q", "A", "src/a.cs", "FastWalker", "class", 1, None, None),
        ("r", "M", "src/a.cs", "a.cs", "module", 1, None, None), ("r", "N", None, None, None, None, None, None),
    ]
    e = [
        ("r", "C", "Im", "CALLS"), ("r", "C", "Bm", "CALLS"), ("r", "A", "I", "IMPLEMENTS"), ("r", "B", "I", "IMPLEMENTS"), ("r", "B", "A", "EXTENDS"), ("r", "T", "C", "CALLS"), ("r", "C", "callee:Run", "CALLS"),
        ("r", "C", "type:FastWalker", "TYPE_REF"), ("q", "x", "type:SlowWalker", "TYPE_REF"), ("r", "C", None, "CALLS"), (None, "C", "Im", "CALLS"), ("r", "C", "M", "IMPORTS"), ("r", "T", "Am", "CALLS"),
    ]
    edges = [(i, *x, 1.0, None, None) for i, x in enumerate(e)]
    return spark.createDataFrame(y, SYMBOL), spark.createDataFrame(edges + edges[:1], EDGE)


def test_dispatch_adds_what_is_no_edge_yet(code, rows):
    y, e = code
    assert rows(context.dispatch(e, y, "IMPLEMENTS").select("from_id", "to_id")) == [("C", "Am")]
    assert rows(context.dispatch(e, y, "EXTENDS").select("from_id", "to_id")) == [("T", "Bm")]
    assert context.dispatch(e, y, "IMPLEMENTS", most=1).count() == 1
    assert rows(context.typed_dispatch(e, y).select("interface_id", "implementor_id", "n_calls")) == [("I", "A", 2), ("I", "B", 2)]
    assert rows(context.fixture_reach(e, y, is_test_path).select("source_id", "test_id")) == [("Bm", "T"), ("Im", "T")]


def test_references_and_contexts(spark, code, rows):
    y, e = code
    refs = {(r.symbol_id, r.edge_id) for r in context.references(y, e).collect()}
    assert {("Im", 0), ("Im", 6), ("Am", 6), ("Bm", 6), ("A", 7)} <= refs and ("A", 8) not in refs
    batch = spark.createDataFrame([("r", "b", "src/c.cs"), ("r", "b", "src/b.cs"), ("r", "none", "src/none.cs")], "repo_id string, batch string, file_path string")
    got = {r.edge_id: (r.way, r.position, r.truncated) for r in context.file_context(y, e, batch, 3).collect()}
    assert len(got) == 3 and got[1][0] == "inner" and all(t for _, _, t in got.values())
    assert context.file_context(y, e.limit(0), batch, 3).count() == 0
    assert rows(context.provider_symbols(e, y).select("repo_id", "type", "provider_repo")) == [("q", "SlowWalker", "r")]
    seeds = rows(context.impact_seed(y, e).where("repo_id = 'r' and file_path = 'src/a.cs'").select("symbol_id", "how"))
    assert seeds == [("A", "own"), ("Am", "own"), ("Im", "sibling")]
    assert rows(context.context_pack(y, e, "run").where("role <> 'symbol'").select("role", "symbol_id")) == [("caller", "C"), ("caller", "T")]
    assert context.context_pack(y, e, "nothing").count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_endpoints_split_hot_targets(spark, code, rows, monkeypatch, how):
    y, e = code
    plain = rows(graph.endpoints(e, y, how))
    monkeypatch.setattr(graph, "hot_keys", lambda c, k: c.where("n > 1").selectExpr(*k, "3 as parts"))
    assert rows(graph.endpoints(e, y, how)) == plain and len(plain) >= 9


def test_candidates_equal_all_pairs(spark, rows):
    rnd = random.Random(3)
    y = [("r", f"s{i}", f"f{rnd.randrange(6)}", f"n{rnd.randrange(5)}", rnd.choice(["method", "class", "module"]), i, None, None) for i in range(60)]
    e = [(i, "r", f"s{rnd.randrange(60)}", f"callee:n{rnd.randrange(6)}", "CALLS", 1.0, None, None) for i in range(80)] + [(100 + i, "r", f"s{rnd.randrange(60)}", f"s{rnd.randrange(60)}", "IMPORTS", 1.0, None, None) for i in range(30)]
    rank, file = {"method": 0, "class": 3}, {x[1]: x[2] for x in y}
    near = {(file[x[2]], file[x[3]]) for x in e if x[4] == "IMPORTS"}
    want = {}
    for i, _, a, to, kind, *_ in e:
        if kind == "CALLS":
            c = [((0 if x[2] == file[a] else 25 if (file[a], x[2]) in near else 100) + rank[x[4]], x[2], x[1]) for x in y if x[3] == to[7:] and x[4] in rank]
            if c:
                want[i] = min(c)[2]
    got = resolve.best_candidate(spark.createDataFrame(e, EDGE), spark.createDataFrame(y, SYMBOL), "callee", ["method", "class"])
    assert {r.edge_id: r.symbol_id for r in got.collect()} == want


def test_ids_at_risk_equal_all_pairs(spark):
    rnd = random.Random(5)
    raw = [(rnd.choice("ab"), f"k{i:02}", rnd.randrange(40), rnd.randrange(40)) for i in range(40)]
    got = {r.k for r in context.ids_at_risk(spark.createDataFrame(raw, "g string, k string, a int, b int"), ["g"], "k", "a", "b").collect()}
    key = lambda x, c: (x[c], x[1])
    assert got == {x[1] for x in raw for z in raw if x[0] == z[0] and (key(x, 2) < key(z, 2)) != (key(x, 3) < key(z, 3)) and x != z}


@pytest.mark.parametrize("path, test", [("a/tests/b.ts", True), ("Tests/b.ts", True), ("a/b.spec.js", True), ("a/test_b.py", True), ("a/b_test.py", True), ("WalkerTests.cs", True), ("a\\__tests__\\b.js", True), ("a/latest/b.ts", False), ("test.ts", False), ("a/tests", False), ("a/testing.py", False)])
def test_paths_of_tests(spark, path, test):
    assert spark.createDataFrame([(path,)], "p string").select(is_test_path(F.col("p"))).first()[0] is test


REFUSED = [
    "select count(*) from t, parquet.`/root/testdata/sf0.001/nation.parquet`", "select v from t, global_secret", "select v from t where v in (select v from global_secret)", "select * from (select * from global_secret)", "with x as (select * from global_secret) select * from x",
    "select (select max(v) from global_secret) from t", "select * from default.t", "select reflect('java.lang.System', 'exit', 1)", "select v from t union all select v from global_secret", "select * from t where exists (select 1 from global_secret g where g.v = t.v)", "select * from read_files('/')", "from t select", "select * from __scoped_x_t",
]


def test_guard_sees_every_table(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "repo_id string, v int")
    df.createOrReplaceTempView("global_secret")
    for sql in REFUSED:
        with pytest.raises(sqlguard.Refused):
            sqlguard.scoped_query(spark, {"t": df}, sql, "a")
    run = lambda sql, scope="a": sorted(map(tuple, sqlguard.scoped_query(spark, {"t": df, "u": df}, sql, scope)[0].collect()))
    assert run("select a.v, b.v as w from t a, u b") == [(1, 1)]
    assert run("with x as (select v from t) select x.v from x join T y on x.v = y.v") == [(1,)]
    assert run("with global_secret as (select 7 as v) select v from global_secret") == [(7,)]
    first = sqlguard.scoped_query(spark, {"t": df}, "select v from t", "a")[0]
    assert run("select v from t", "b") == [(2,)] and [r.v for r in first.collect()] == [1]
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("__scoped")]
    spark.catalog.dropTempView("global_secret")


def test_bounded_reads(spark):
    assert sqlguard.bounded(spark.range(5), 5, 60)[1] == "complete" and len(sqlguard.bounded(spark.range(9), 5, 60)[0]) == 5
    slow = spark.range(40).repartition(4).mapInPandas(lambda it: (b for b in it if not __import__("time").sleep(20)), "id bigint")
    assert sqlguard.bounded(slow, 5, 1) == ([], "timed out")
    rows, size, warning = sqlguard.pg_read(spark, {"t": spark.range(9).toDF("v")}, "select v from t", most=3, costly=0)
    assert rows.count() == 4 and size > 0 and warning


def test_stream_goes_on_where_it_stopped(spark, tmp_path, rows):
    schema = spark.createDataFrame([], "k string, at int, v string").schema
    put = lambda name, raw: spark.createDataFrame(raw, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put("a", [("x", 1, "a"), ("y", 5, "b"), (None, 1, "n")])
    run = lambda: rows(changes.keep_current(spark, str(tmp_path / "in"), schema, ["k"], ["at"], str(tmp_path / "out"), 4))
    assert run() == sorted([("x", 1, "a"), ("y", 5, "b"), (None, 1, "n")], key=repr)
    put("b", [("x", 2, "c"), ("y", 4, "old"), ("z", 1, "d")])
    want = sorted([("x", 2, "c"), ("y", 5, "b"), ("z", 1, "d"), (None, 1, "n")], key=repr)
    assert run() == want and run() == want
    assert rows(changes.current(spark, str(tmp_path / "nothing"), schema)) == []


def test_search_over_http(spark):
    def fetch(request):
        if "select *" not in request["sql"]:
            return 400, "No field named c"
        return 200, json.dumps({"hits": [{"a": request["start"][:10], "b": 1}]})

    got = remote.http_logs(spark, fetch, "s", "a string, c string", datetime(2026, 1, 1), datetime(2026, 1, 3, 1), timedelta(days=1))
    assert sorted(map(tuple, got.collect())) == [("2026-01-01", None), ("2026-01-02", None), ("2026-01-03", None)]
    for answer in ((503, "busy"), (400, "bad"), (401, "no")):
        with pytest.raises(RuntimeError):
            remote.search_window(lambda r, a=answer: a, "s", ["a"], datetime(2026, 1, 1), datetime(2026, 1, 2), 2, 0)
    o = remote.jdbc_options("pg", "h:5432", "db", "u", "public.t", "id", (0, 100), 4)
    assert o["url"] == "jdbc:postgresql://h:5432/db" and o["numPartitions"] == "4" and "read_only" in o["sessionInitStatement"]
    assert "ReadOnly" in remote.jdbc_options("mssql", "h", "db", "u", "t")["url"]
    with pytest.raises(ValueError):
        remote.environment_table(spark, {"a": "/x"}, "b", "t")


def test_catalog_file(spark, tmp_path, rows):
    (tmp_path / "c.json").write_text('{"service": "a", "capturedAt": "2026-06-20T00:00:00Z"}\n{"service": "b", "capturedAt": "2026-01-01T00:00:00Z"}\n{"service": "c"}\n')
    assert rows(remote.catalog(spark, str(tmp_path / "c.json"), date(2026, 7, 1)).select("service", "stale")) == [("a", False), ("b", True), ("c", True)]


def test_git_output(spark, rows):
    out = spark.createDataFrame([("r", "M\ta.ts\nR100\told.ts\tnew.ts\nA\tb c.ts\n"), ("n", None), ("e", "")], "repo_id string, output string")
    assert rows(git.name_status(out)) == [("r", "a.ts", None, "modified"), ("r", "b c.ts", None, "added"), ("r", "new.ts", "old.ts", "renamed")]
    assert git.porcelain(out.where("repo_id <> 'r'")).count() == 0


def test_changes_count_a_path_once(spark, rows):
    raw = [("r", "b", "a", "renamed"), ("r", "a", None, "modified"), ("r", "c", None, "added"), ("r", "c", None, "modified")]
    got = context.change_set(spark.createDataFrame(raw, "repo_id string, path string, old_path string, change string"))
    assert rows(got) == [("r", "a", "removed"), ("r", "b", "added"), ("r", "c", "added")]


def test_long_chains_and_cycles(spark):
    n = 3000
    links = [("r", f"a{i}", f"a{i - 1}" if i else None) for i in range(n)] + [("r", f"b{i}", f"b{(i + 1) % n}") for i in range(n)] + [("r", f"c{i}", "b7") for i in range(300)]
    h = hierarchy.Hierarchy(spark.createDataFrame(links, "scope string, id string, parent string"), hot_rows=100)
    assert {r.id for r in h.cycles().collect()} == {f"b{i}" for i in range(n)} and len(h.peeled) == 1


def test_sections_and_names(spark, rows):
    d = spark.createDataFrame([(1, "src/a/b.ts\n# One\nsee src/a/c.ts and src/a/c.ts\n## Two\nnone"), (2, None), (3, "")], "doc_id bigint, text string")
    assert rows(sections.sections_mentioning(d, r"src/\S+\.ts")) == [(1, "One", "src/a/c.ts", 2), (1, None, "src/a/b.ts", 1)]
    names = spark.createDataFrame([("t", None), ("t", "a"), ("u", None), ("v", None), ("w", None)], "name string, schema string")
    defs = spark.createDataFrame([("a", "t", "current"), ("b", "t", "current"), ("a", "u", "current"), ("b", "u", "dropped"), ("a", "v", "dropped")], "schema string, name string, state string")
    assert rows(sections.bind_sql_names(names, defs)) == sorted([("t", None, "ambiguous", None), ("t", "a", "bound", 0.6), ("u", "a", "bound", 0.5), ("v", None, "dropped", None), ("w", None, "unknown", None)], key=repr)


def test_padding_and_pages(spark, rows):
    names = spark.createDataFrame([("r", "1", "walkTree"), ("r", "2", "walkTrees"), ("r", "3", "zzz"), ("r", "4", "")], "repo_id string, symbol_id string, name string")
    none = spark.createDataFrame([], "repo_id string, symbol_id string, how string, distance double")
    assert [r.symbol_id for r in search.padded(none, names, "walkTree", 2).orderBy("distance").collect()] == ["1", "2"]
    found = spark.createDataFrame([(p, i, 1, "x") for p in "ab" for i in range(3)], "path string, line int, n_hits int, first string")
    assert [(r.path, r.line, r.truncated) for r in search.after_path(found, "a", 2, 2).orderBy("path", "line").collect()] == [("a", 2, True), ("b", 0, True)]


def test_plan_of_a_ledger(spark, rows):
    s = spark.createDataFrame([("1", "applied"), ("2", "out_of_order"), ("3", "pending"), ("4", "renamed"), ("5", "pending")], "version string, status string")
    assert [(r.version, r.step, r.refusal) for r in tabular.ledger_plan(s).orderBy("step").collect()] == [("2", 1, "renamed"), ("3", 2, "renamed"), ("5", 3, "renamed")]
    assert {r.refusal for r in tabular.ledger_plan(s, "3").collect()} == {"out_of_order"}
    assert tabular.ledger_plan(s.limit(0)).count() == 0


def test_specifiers_of_nothing(spark):
    none = spark.createDataFrame([("r", "a.ts", None), ("r", "b.md", "import x from './a'")], "repo_id string, path string, content string")
    assert imports.specifiers(none).count() == 0
    assert imports.resolve_specifiers(imports.specifiers(none), none.select("repo_id", "path")).count() == 0


def test_literals_of_any_length(spark, rows):
    long = "ab\\\"" * 50_000
    t = [("r", "a", f'x = "{long}"; y = "{long[:8]}'), ("r", "b", 'x "a" y "b\\"c" z "d\n"e" "f\\\rg" "a"'), ("r", "c", None)]
    found = rows(files.literals(spark.createDataFrame(t, "repo_id string, path string, content string")))
    assert found == sorted([("r", "a", long, 1), ("r", "b", "a", 2), ("r", "b", 'b\\"c', 1), ("r", "b", "e", 1), ("r", "b", "f\\\rg", 1)], key=repr)


@pytest.fixture(scope="module")
def meant(spark):
    y = [("r", f"s{i}", f"f{i % 3}", "log", "function", i, None, None) for i in range(6)]
    y += [("r", "callee:odd", "f0", "odd", "function", 1, None, None), ("r", "O", "f0", "Own", "class", 1, None, None), ("r", "P", "f1", "size", "property", 2, None, "O"), ("r", "Q", "f2", "once", "function", 1, None, None), ("r", "N", None, "log", "function", 1, None, None)]
    e = [("r", "s0", "callee:log", "CALLS"), ("r", "s0", "callee:odd", "CALLS"), ("r", "s1", "property:Own.size", "PROPERTY_REF"), ("r", "s1", "property:X.size", "PROPERTY_WRITE"), ("r", "Q", "callee:once", "CALLS"), ("r", "Q", "callee:log", "TYPE_REF"), ("r", "N", "callee:log", "CALLS"), ("r", "O", "s0", "IMPORTS"), ("r", "z", "callee:log", "CALLS"), ("r", "s2", None, "CALLS"), ("r", "s1", "s0", "IMPORTS")]
    return spark.createDataFrame(y, SYMBOL), spark.createDataFrame([(i, *x, 0.5 + i / 100, None, None) for i, x in enumerate(e)], EDGE)


def test_pairs_come_once_and_keys_with_many_are_split(meant, rows, monkeypatch):
    y, e = meant
    logs = [f"s{i}" for i in range(6)] + ["N"]
    want = sorted([("r", s, i) for i in (0, 6, 8) for s in logs] + [("r", "callee:odd", 1), ("r", "P", 2), ("r", "P", 3), ("r", "Q", 4), ("r", "s0", 7), ("r", "s0", 10)], key=repr)
    assert rows(graph.token_pairs(y, e)) == want
    monkeypatch.setattr(graph, "PAIRS_A_TASK", 4)
    assert rows(graph.token_pairs(y, e)) == want
    assert rows(graph._hot_products(graph._meaning(e, "repo_id"), graph._meant(y))) == [("r", "=callee:log", 7)]


def test_pairs_are_not_shuffled_again(meant):
    plan = graph.token_pairs(*meant)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ShuffledHashJoin") < plan.index("Exchange") and "Aggregate" not in plan[: plan.index("ShuffledHashJoin")]


def test_callers_without_pairs_are_those_of_the_pairs(meant, rows):
    y, e = meant
    pairs = graph.impact_files(y, e)
    assert rows(pairs) == [("r", "f0", "f1", 0.6, None, 1), ("r", "f1", "f0", 0.5, None, 2), ("r", "f2", "f0", 0.5, None, 2)]
    assert rows(graph.caller_files(y, e)) == rows(pairs.select("repo_id", "caller_file").distinct()) == [("r", "f0"), ("r", "f1")]
    for changed in (["f0"], ["f1", "f2"], ["f3"]):
        met = pairs.where(F.col("target_file").isin(changed) & ~F.col("caller_file").isin(changed)).groupBy("repo_id", "caller_file").agg(F.max("confidence"))
        assert rows(graph.outside_callers(y, e, y.sparkSession.createDataFrame([("r", c) for c in changed], "repo_id string, path string"))) == rows(met)


def test_references_and_field_access_carry_the_edge(meant, rows):
    y, e = meant
    assert [r for r in rows(context.references(y, e)) if r[1] in ("P", "callee:odd")] == [("r", "P", 2, "PROPERTY_REF", "s1", "f1"), ("r", "P", 3, "PROPERTY_WRITE", "s1", "f1"), ("r", "callee:odd", 1, "CALLS", "s0", "f0")]
    joins = [x for x in context.references(y, e)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x]
    assert joins and not any("edge_id" in x.partition("Join ")[2] for x in joins)
