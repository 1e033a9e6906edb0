"""Problems 1, 4 and 5 against brute force on small tables with nulls, ties, repeated rows and clashing columns."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from tarnwell.operators import hierarchy, hotkeys, references, skew

EDGE = "edge_id bigint, repo_id string, from_id string, to_id string, type string, reason string, recorded_at timestamp, n bigint, scope string, live int, k0 string"
SYMBOL = "repo_id string, symbol_id string, parent_symbol_id string, recorded_at timestamp, deleted_at timestamp, id string, parent string, n int"
T0 = datetime(2026, 1, 1)


def _edges(spark, raw):
    return spark.createDataFrame([(i, *r, 7, "x", 1, "z") for i, r in enumerate(raw)], EDGE)


def _symbols(spark, raw):
    return spark.createDataFrame([(*r, "i", "p", 3) for r in raw], SYMBOL)


@pytest.mark.parametrize("fan_in", [2, 16])
def test_tree_aggregate_equals_brute_force(spark, rows, fan_in):
    rnd = random.Random(1)
    raw = [(rnd.choice(["a", "b", None]), rnd.choice([None, *map(str, range(30))]), rnd.choice(["hot"] * 9 + ["x", None]), rnd.choice(["T", "U", None]), None, None) for _ in range(3000)]
    got = rows(hotkeys.hot_key_profile(_edges(spark, raw), fan_in))
    by = defaultdict(list)
    for r in raw:
        by[r[2], r[3]].append(r)
    want = [(*k, len(v), len({x[0] for x in v} - {None}), len({x[1] for x in v} - {None})) for k, v in by.items()]
    assert got == sorted(want, key=repr)
    heavy = {k for k, v in by.items() if len(v) >= 30}
    assert {(r[0], r[1]) for r in hotkeys.heavy_keys(_edges(spark, raw), 0.01, fan_in).collect()} == heavy


def test_tree_aggregate_of_nothing(spark):
    assert hotkeys.hot_key_profile(_edges(spark, [])).collect() == []
    assert hotkeys.heavy_keys(_edges(spark, [])).collect() == []


def test_salted_join_equals_plain_join(spark, rows):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", None) for i in range(900)] + [(-1, None, None)], "i int, k string, parts int").drop("parts")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), (None, 4)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(skew.salted_join(left, right, ["k"], how, hot_rows=50).select("i")) == rows(left.join(right, "k", how).select("i"))


def test_hot_keys_are_bounded(spark):
    counts = spark.createDataFrame([(f"k{i}", 10) for i in range(100)], "k string, n bigint")
    assert skew.hot_keys(counts, ["k"], hot_rows=1).count() == 100
    assert skew.hot_keys(counts.limit(0), ["k"], hot_rows=1).count() == 0


@pytest.mark.parametrize("hot_rows", [3, 10**6])
def test_references_equal_brute_force(spark, hot_rows):
    rnd = random.Random(2)
    at = lambda: rnd.choice([None, *(T0 + timedelta(days=k) for k in range(6))])
    symbols = [(rnd.choice(["a", "b"]), f"s{rnd.randrange(12)}", None, T0 + timedelta(hours=i), rnd.choice([None, None, T0])) for i in range(40)]
    symbols += [(None, "s1", None, T0, None), ("a", None, None, T0, None), symbols[0]]
    edges = [(rnd.choice(["a", "b", None]), "f", rnd.choice([None, "callee:x", *(f"s{k}" for k in range(14))]), "T", rnd.choice([None, "cross-repo bridge", "x"]), at()) for _ in range(300)]
    edges += [edges[0]] * 20
    cur = {}
    for r in symbols:
        if r[0] and r[1] and (r[:2] not in cur or cur[r[:2]][0] < r[3]):
            cur[r[:2]] = (r[3], r[4] is None)
    first = {k: min(r[3] for r in symbols if r[:2] == k) for k in cur}
    want = Counter()
    for i, (repo, _, to, _, reason, when) in enumerate(edges):
        if to is None or ":" in to:
            continue
        own = [k for k in cur if k[1] == to and ("cross-repo" in (reason or "") or k[0] == repo)]
        live = [k for k in own if cur[k][1]]
        state = "never_seen" if not own else "deleted" if not live else "late" if (when or datetime(1, 1, 1)) < min(first[k] for k in live) else None
        if state:
            want[i, state] += 1
    got = references.classify_references(_edges(spark, edges), _symbols(spark, symbols), hot_rows)
    assert Counter((r.edge_id, r.target_state) for r in got.collect()) == want


def test_references_of_empty_tables(spark):
    e, s = _edges(spark, []), _symbols(spark, [])
    assert references.orphan_edges(e, s).count() == 0
    assert references.orphans_by_period(e, s).count() == 0
    assert references.orphan_edges(_edges(spark, [("a", "f", "s", "T", None, None)]), s).count() == 1


def _hierarchy_by_hand(parents):
    out = {}
    for n in parents:
        up, at = [], parents[n]
        while at is not None and at in parents and at not in up and at != n:
            up.append(at)
            at = parents[at]
        out[n] = ("cycle", None) if at == n else ("below_cycle", None) if at in up and at is not None else ("tree", up)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_hierarchy_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    parents = {f"n{i}": None if rnd.random() < 0.2 else f"n{rnd.randrange(60)}" if rnd.random() < 0.3 else f"n{max(0, i - 1)}" for i in range(60)}
    parents |= {"self": "self", "c1": "c2", "c2": "c3", "c3": "c1", "tail": "c2", "lost": "gone", **{f"kid{i}": "n0" for i in range(40)}}
    raw = [("r", n, p, T0, None) for n, p in parents.items()] + [("r", "gone", None, T0, T0), ("q", "n0", "n5", T0, None), ("r", "n3", "self", T0 - timedelta(days=1), None)]
    raw += raw[:5]
    want = _hierarchy_by_hand(parents | {"lost": None})
    table = _symbols(spark, raw)
    built = hierarchy.Hierarchy(hierarchy.live_links(table))
    got = {r.symbol_id: r for r in hierarchy.hierarchy(table, built).where("repo_id = 'r'").collect()}
    assert got.keys() == want.keys()
    below = Counter(a for s, up in want.values() if up for a in up)
    for n, (state, up) in want.items():
        r = got[n]
        assert r.state == state
        assert r.path == (None if up is None else "/".join([*reversed(up), n]))
        assert r.depth == (None if up is None else len(up))
        if state == "tree":
            assert r.n_descendants == below[n]
    assert {r.id for r in built.cycles().where("scope = 'r'").collect()} == {n for n, (s, _) in want.items() if s == "cycle"}
    pairs = {(r.symbol_id, r.descendant_id, r.distance) for r in hierarchy.descendants(table, built).where("repo_id = 'r'").collect()}
    assert pairs == {(a, n, k + 1) for n, (s, up) in want.items() if up for k, a in enumerate(up)}


def test_hierarchy_splits_hot_parents(spark):
    raw = [("r", "root", None, T0, None), ("r", "mid", "root", T0, None)] + [("r", f"k{i}", "mid", T0, None) for i in range(50)]
    h = hierarchy.Hierarchy(hierarchy.live_links(_symbols(spark, raw)), hot_rows=10)
    assert {(r.id, len(r.up)) for r in h.nodes().collect()} == {("root", 0), ("mid", 1), *((f"k{i}", 2) for i in range(50))}


def test_hierarchy_of_nothing(spark):
    assert hierarchy.hierarchy(_symbols(spark, [])).count() == 0
    assert hierarchy.closed_chains(_symbols(spark, [])).count() == 0
