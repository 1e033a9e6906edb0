"""Operators whose queries have no SQL, on small fixtures."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import scalar as fn
from tarnwell.operators import resolve, search, tabular
from tarnwell.plans import logs as logs_plans
from tarnwell.plans import search as search_plans
from tarnwell.plans import tabular as tabular_plans
from tarnwell.sources import files as src
from tarnwell.streaming import changes

SYM = "repo_id string, symbol_id string, name string, kind string, file_path string, parent_symbol_id string, signature string"


@pytest.fixture(scope="module")
def symbols(spark):
    raw = [("r", "1", "walkTree", "function", "src/a.ts"), ("r", "2", "walktree", "function", "src/b.ts"), ("r", "3", "Cache", "class", "src/c.ts"), ("r", "4", "Cache", "class", "tests/c.ts"), ("r", "5", "drain_queue", "function", "src/d.py"), ("r", "6", "drain_queue", "function", "src/e.py"), ("q", "7", "onlyHere", "function", "src/f.ts")]
    return spark.createDataFrame([(*r, None, None) for r in raw], SYM)


def test_mentions_bind_by_tier(spark, symbols):
    docs = spark.createDataFrame([(1, "r", "`walkTree` and WALKTREE, `Cache`, drain_queue and onlyHere"), (2, "r", None), (3, "r", "")], "doc_id bigint, repo_id string, text string")
    found = resolve.mentions(docs)
    assert {r.mention for r in found.collect()} == {"walkTree", "Cache", "drain_queue", "onlyHere"}
    got = {r.mention: (r.status, r.symbol_id, r.n_candidates) for r in resolve.bind_mentions(found, symbols).collect()}
    assert got == {"walkTree": ("bound", "1", 1), "Cache": ("bound", "3", 1), "drain_queue": ("ambiguous", None, 2), "onlyHere": ("unbound", None, 0)}


def test_drift_equals_all_pairs(spark, symbols):
    names = ["walkTre", "walk_tree", "drainqueue", "drain_queues", "drain_quexe", "Cachet", "x", "unrelated"]
    got = {r.mention: (r.name, r.score) for r in resolve.drift(spark.createDataFrame([("r", n) for n in names], "repo_id string, mention string"), symbols).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    key = lambda n: n.replace("_", "").replace("-", "").lower()
    stem = lambda n: key(n)[:-2] if key(n).endswith("es") else key(n)[:-1] if key(n).endswith("s") else key(n)
    want = {}
    for n in names:
        pairs = [(-round(1 - distance(n.lower(), s.lower()) / max(len(n), len(s)), 6), s) for s in ("walkTree", "walktree", "Cache", "drain_queue") if n[0].lower() == s[0].lower() and key(n) != key(s) and stem(n) != stem(s)]
        pairs = [p for p in pairs if p[0] <= -0.75]
        if pairs and len(n) >= 4:
            want[n] = (min(pairs)[1], -min(pairs)[0])
    assert got == want


def test_covering_is_division(spark, rows):
    need = spark.createDataFrame([("I", "a"), ("I", "b"), ("J", "c"), ("I", "a")], "owner string, member string")
    have = spark.createDataFrame([("X", "a"), ("X", "b"), ("X", "z"), ("Y", "a"), ("Y", "c")], "taker string, member string")
    assert rows(resolve.covering(need, have)) == [("I", "X"), ("J", "Y")]


def test_endpoint_tiers(spark, rows):
    routes = spark.createDataFrame([("/a/{id}",), ("/a/list",)], "path string")
    calls = spark.createDataFrame([("/a/list",), ("/a/{x}",), ("/gw/a/{y}",), ("/g/w/a/list",), ("/b",)], "path string")
    assert rows(resolve.endpoint_match(calls, routes)) == [("/a/list", "/a/list", "exact"), ("/a/{x}", "/a/{id}", "wildcard"), ("/g/w/a/list", "/a/list", "gateway_prefix"), ("/gw/a/{y}", "/a/{id}", "gateway_prefix")]


def test_search_helpers(spark, rows, symbols):
    docs = spark.createDataFrame([(1, "the limit is ten kilobytes"), (2, "nobody was paged, rows lost"), (3, "hello"), (4, None)], "doc_id bigint, text string")
    assert rows(search.intent(docs, {"limit": ["limit", "kilobytes"], "outage": ["paged", "lost"]})) == [(1, "limit"), (2, "outage"), (3, "other")]
    assert rows(search.symbol_search(symbols, ["wal", "tr"]).select("symbol_id")) == [("1",)]
    heads = spark.createDataFrame([(1, "Open points"), (2, "Limits")], "doc_id bigint, heading string")
    assert search.nearest_headings(heads, "open point").first().doc_id == 1
    assert rows(search.search_lines(docs, "l", "doc_id", "text", 1).select("doc_id", "line")) == [(1, 1), (2, 1), (3, 1)]


def test_extractors(spark, rows):
    md = spark.createDataFrame([(1, "# A\n\n```py\n# no\nx\n```\n## B\n"), (2, None)], "doc_id bigint, text string")
    assert rows(src.markdown_sections(md, "doc_id", "text").select("level", "heading")) == [(1, "A"), (2, "B")]
    assert rows(src.code_blocks(md, "doc_id", "text").select("language", "n_lines")) == [("py", 2)]
    py = spark.createDataFrame([("r", "a.py", "import os\nclass A:\n  def f(self):\n    g()\n"), ("r", "b.py", "def ("), ("r", "c.py", None)], "repo_id string, path string, content string")
    assert {(r.kind, r.name, r.owner) for r in src.extract_python(py).collect()} == {("IMPORTS", "import:os", None), ("class", "A", None), ("method", "f", "A"), ("CALLS", "callee:g", "f")}
    f = spark.createDataFrame([("node_modules/a.js", 1), ("x/.env", 1), ("b.ts", 10**7), ("c.xyz", 1), ("d.ts", 1)], "path string, length int")
    assert rows(src.skip_tally(f).select("reason", "n")) == [("excluded", 1), ("secret", 1), ("too large", 1), ("unknown language", 1)]
    assert [r.b for r in spark.range(1).select(src.is_binary(F.lit(bytearray(b"a\x00b"))).alias("b")).collect()] == [True]


def test_changes(spark, rows):
    e = spark.createDataFrame([("r", "a", "changed", 1), ("r", "a", "deleted", 2), ("r", "b", "changed", 1), ("q", "c", "changed", 5)], "repo_id string, path string, event string, at int")
    assert rows(changes.coalesce_changes(e, 1)) == [("q", 1, 0, False), ("r", 1, 1, True)]
    a = spark.createDataFrame([("r", "a", "1"), ("r", "b", "1")], "repo_id string, path string, content_hash string")
    b = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3")], "repo_id string, path string, content_hash string")
    assert rows(changes.freshness(a, b)) == [("r", "a", "fresh"), ("r", "b", "stale"), ("r", "c", "missing")]


def test_tables(spark, rows):
    df = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    est = {r.column: (r.n_rows, r.null_frac, r.n_distinct) for r in tabular.profile_estimated(df).collect()}
    assert est == {"a": (3, 0.0, 2), "b": (3, 0.666667, 1)}
    s1, s2 = tabular.schema_rows({"t": df}), tabular.schema_rows({"t": df.drop("b").withColumn("a", F.lit("s"))})
    assert rows(tabular.schema_diff(s1, s2).select("name", "change")) == [("t.a", "changed"), ("t.b", "removed")]
    assert tabular.snapshot_id(s1).first() == tabular.snapshot_id(s1.orderBy(F.desc("name"))).first()
    assert rows(df.limit(1).select(fn.json_normalize({"b": F.col("b"), "a": F.col("a")}).alias("j"))) == [('{"a":1,"b":"x"}',)]


def test_bases_are_linearized_as_python_does(spark):
    rnd = random.Random(3)
    bases, made = {}, {"c0": type("c0", (), {})}
    for i in range(1, 60):
        own = [f"c{k}" for k in sorted(rnd.sample(range(i), min(i, rnd.choice([1, 1, 2, 3]))), reverse=True)]
        try:
            made[f"c{i}"] = type(f"c{i}", tuple(made[b] for b in own), {})
        except (TypeError, KeyError):
            continue
        bases[f"c{i}"] = own
    for i in range(1500):
        bases[f"d{i}"] = [f"d{i + 1}"]
    bases |= {"x": ["y", "z"], "y": ["x"], "w": ["x", "c1"], "s": ["s", "c0"], "p": ["c0", "q"], "q": ["c0"]}
    rows = [(k, "r", c, b, "EXTENDS") for k, (c, b) in enumerate((c, b) for c, own in bases.items() for b in own)]
    e = spark.createDataFrame(rows + [(9000 + r[0], *r[1:]) for r in rows[::-1]] + [(1, "r", "c1", "f", "CALLS")], "edge_id int, repo_id string, from_id string, to_id string, type string")
    got = {}
    for r in resolve.base_chain(e).orderBy("level").collect():
        got.setdefault(r.class_id, []).append(r.base_id)
    assert all(got[c] == [x.__name__ for x in t.__mro__[1:-1]] for c, t in made.items() if c in bases)
    assert len(got["d0"]) == 1500
    assert {c: got[c] for c in "xyws"} == {"x": ["y", "z"], "y": ["x", "z"], "w": ["x", "c1", "y", "z", "c0"], "s": ["c0"]} and got["p"] == ["c0", "q"]
    assert {(r.class_id, r.base_id, r.position) for r in resolve.class_bases(e).collect()} == {(c, b, k) for c, own in bases.items() for k, b in enumerate(own, 1)}


def test_publish_consume_is_brute_force(spark, rows):
    raw = [("PUBLISHES", "c1", "a"), ("PUBLISHES", "c1", "b"), ("PUBLISHES", "c2", "a"), ("CONSUMES", "c1", "a"), ("CONSUMES", "c1", "d"), ("CONSUMES", "c1", "d"), ("CONSUMES", "c3", "d"), ("CALLS", "c2", "d")]
    want = lambda es: sorted({(c, a, b) for t, c, a in es if t == "PUBLISHES" for u, k, b in es if u == "CONSUMES" and k == c and a != b})
    assert rows(resolve.publish_consume(spark.createDataFrame(raw, "type string, to_id string, from_id string"))) == want(raw)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_publish_consume_query_has_both_sides(spark, rows):
    d = "/root/testdata/sf0.001"
    es = [("CONSUMES" if r.edge_id % 4 else "PUBLISHES", r.to_id, r.from_id) for r in spark.read.parquet(f"{d}/edges.parquet").where("type = 'DEPENDS_ON'").collect()]
    want = sorted({(c, a, b) for t, c, a in es if t == "PUBLISHES" for u, k, b in es if u == "CONSUMES" and k == c and a != b})
    assert want and rows(search_plans.QUERIES["r_publish_consume"](spark, d)) == want


def test_python_imports_keep_every_name(spark):
    text = "import a, b.c as d\nfrom . import x, y\nfrom ..p.q import z as w\nfrom m import n, o\nfrom m import *\n"
    got = src.extract_python(spark.createDataFrame([("r", "a.py", text)], "repo_id string, path string, content string")).where("kind = 'IMPORTS'")
    assert sorted(r.name[7:] for r in got.collect()) == ["..p.q.z", ".x", ".y", "a", "b.c", "m.*", "m.n", "m.o"]


def test_fanout_takes_every_environment(spark, rows):
    e = spark.createDataFrame([("dev", "up"), ("dr", "up"), ("dr", "up"), ("staging", "down"), (None, "up")], "environment string, direction string")
    assert sorted((r.direction, r.n, r._catalog or "") for r in tabular_plans._fanout(e).collect()) == [("down", 1, "staging"), ("up", 1, ""), ("up", 1, "dev"), ("up", 2, "dr")]
    assert tabular_plans._fanout(e.limit(0)).count() == 0


def test_shape_profile_takes_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "x" * 100), (2, "y" * 50), (3, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.message, r.exception) for r in logs_plans.QUERIES["prj_shape_profile"](spark, str(tmp_path)).collect()}
    assert got == {1: ("x" * 30 + "…[+70 chars]", "x" * 60 + "…[+40 chars]"), 2: (None, "y" * 50), 3: (None, None)}
