"""Property-graph operators over symbols (nodes) and edges whose targets are symbol ids or tokens prefix:name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import is_test_path
from ..session import Scratch
from .skew import hot_keys, salted_join

# Edge types that a walk along calls follows.
CALL_TYPES = ["CALLS", "PUBLISHES", "USES_COMPONENT", "USES_CSS_VAR", "USES_CSS_CLASS", "SQL_USES", "SQL_REFERENCES", "SQL_GRANT", "SQL_QUERY"]
DEPENDENCY_TYPES = ["IMPORTS", "DEPENDS_ON"]
#: A key with more pairs of an edge and a symbol than this is spread over several tasks.
PAIRS_A_TASK = 1_000_000
#: Token prefix of a name by the type of the edge that looks for it.
NAME_TOKENS = {"CALLS": "callee", "TYPE_REF": "type", "PROPERTY_REF": "property", "PROPERTY_WRITE": "property"}
TRIVIAL_NAMES = ["constructor", "toString", "main", "index", "get", "set"]


def is_token(c: Column) -> Column:
    return c.contains(":")


def endpoints(edges: DataFrame, symbols: DataFrame, how: str = "left") -> DataFrame:
    """edges with source and target symbols: source_*, target_* of name, file, kind; outer joins keep open ends.

    A target that holds many edges is split by a salt; sources are as many as symbols and are not.
    """

    def side(p: str, key: str) -> DataFrame:
        named = [F.col(c).alias(f"{p}_{n}") for c, n in (("name", "name"), ("file_path", "file"), ("kind", "kind"))]
        return symbols.select("repo_id", F.col("symbol_id").alias(key), *named)

    met = edges.join(side("source", "from_id"), ["repo_id", "from_id"], how)
    return salted_join(met, side("target", "to_id"), ["repo_id", "to_id"], how, hot=hot_targets(edges), spread=F.struct("from_id", "edge_id") if "edge_id" in edges.columns else F.col("from_id"))


def hot_targets(edges: DataFrame) -> DataFrame:
    """(repo_id, to_id, parts) of the targets that hold many of the edges."""
    return hot_keys(edges.groupBy("repo_id", "to_id").agg(F.count(F.lit(1)).alias("n")), ["repo_id", "to_id"])


def without_tests(df: DataFrame, path: str) -> DataFrame:
    """Rows whose path is no test file; a NULL path stays."""
    return df.where(F.col(path).isNull() | ~is_test_path(F.col(path)))


def _meant(symbols: DataFrame) -> DataFrame:
    """(repo_id, symbol_id, file_path, way, key, own): symbols under every key that can mean them.

    way: i, the id, for any edge; c, t and p, tokens of the name for calls, types and properties, left out where the id
    is the same; l, for properties the text after the last dot, with the token that names the owner, too, as own.
    """
    parent = symbols.select("repo_id", F.col("symbol_id").alias("parent_symbol_id"), F.col("name").alias("owner"))
    s = symbols.join(parent, ["repo_id", "parent_symbol_id"], "left")
    name, own = F.col("name"), F.concat(F.lit("property:"), F.coalesce("owner", F.lit("")), F.lit("."), F.col("name"))
    under = lambda way, key, own=F.lit(None).cast("string"): F.struct(F.lit(way).alias("way"), key.alias("key"), own.alias("own"))
    token = lambda way, t: F.when(~t.eqNullSafe(F.col("symbol_id")), under(way, F.concat(F.lit("="), t)))
    keys = F.array(
        under("i", F.concat(F.lit("="), "symbol_id")), token("c", F.concat(F.lit("callee:"), name)), token("t", F.concat(F.lit("type:"), name)), token("p", F.concat(F.lit("property:"), name)),
        token("p", own), F.when(F.col("kind") == "property", under("l", F.concat(F.lit("."), name), own)),
    )
    return s.select("repo_id", "symbol_id", "file_path", F.inline(F.array_compact(keys))).where("key is not null")


def _meaning(edges: DataFrame, *columns: str) -> DataFrame:
    """(columns, key, sort, dotted): edges under the keys of _meant(); sort is the way of their type, dotted the target of way l."""
    to, kind = F.col("to_id"), F.col("type")
    of_property = kind.isin("PROPERTY_REF", "PROPERTY_WRITE")
    sort = F.when(kind == "CALLS", "c").when(kind == "TYPE_REF", "t").when(of_property, "p")
    under = lambda key, sort, dotted: F.struct(key.alias("key"), sort.alias("sort"), dotted.alias("dotted"))
    whole = F.when(to.isNotNull(), under(F.concat(F.lit("="), to), sort, F.lit(None).cast("string")))
    last = F.when(of_property & to.startswith("property:") & to.contains("."), under(F.concat(F.lit("."), F.substring_index(to, ".", -1)), F.lit("l"), to))
    return edges.select(*columns, F.inline(F.array_compact(F.array(whole, last))))


def _hot_products(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, key, parts) of the keys with many pairs of _meaning() and _meant()."""
    n = lambda df, c: df.groupBy("repo_id", "key").agg(F.count(F.lit(1)).alias(c))
    return hot_keys(n(edges, "a").join(n(symbols, "b"), ["repo_id", "key"]).select("repo_id", "key", (F.col("a") * F.col("b")).alias("n")), ["repo_id", "key"], hot_rows=PAIRS_A_TASK)


def token_pairs(symbols: DataFrame, edges: DataFrame, *more: str) -> DataFrame:
    """(repo_id, symbol_id, edge_id, more): edges that mean a symbol by its id or by a token of its name; more: their columns.

    The ways: id; callee:, type: and property: name; property:Owner.name; and for properties the text after the last
    dot. Each symbol is put under every key that can mean it, each edge under its target and its last part, so that one
    equi-join over one pass of the edges does for all; a key with many pairs, which grow as the square of a repository,
    is split by a salt. A pair comes once, as its join row tells whether another key gives it; edge_id is a key of edges.
    """
    s = _meant(symbols).select("repo_id", "symbol_id", "key", "way", "own")
    e = _meaning(edges, "repo_id", "edge_id", *more)
    x = salted_join(e, s, ["key", "repo_id"], "inner", hot=_hot_products(e, s), spread=F.col("edge_id"), hint="shuffle_hash").where("way = 'i' or way = sort")
    return x.where("dotted is null or not (dotted <=> symbol_id or dotted <=> own)").select("repo_id", "symbol_id", "edge_id", *more)


def _met(edges: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """_meaning() of edges, with these columns, joined with keys (repo_id, key, way, more), few rows a key."""
    return _meaning(edges, "repo_id", *columns).drop("dotted").join(keys.hint("shuffle_hash"), ["key", "repo_id"]).where("way = 'i' or way = sort")


def _with_caller(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """rows with the caller_file of their from_id, where there is one."""
    c = symbols.where("file_path is not null").select("repo_id", F.col("symbol_id").alias("from_id"), F.col("file_path").alias("caller_file"))
    return rows.join(c.hint("shuffle_hash"), ["from_id", "repo_id"])


def caller_files(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, caller_file): the caller files of impact_files(), without its pairs: a key that means several files means
    another than the caller's, whichever that is; of other keys the file is carried along."""
    k = _meant(symbols).groupBy("repo_id", "key", "way").agg(F.min("file_path").alias("a"), F.max("file_path").alias("b"))
    k = k.where("a is not null").select("repo_id", "key", "way", F.when(F.col("a") == F.col("b"), F.col("a")).alias("only"))
    x = _with_caller(_met(edges, k, "from_id").select("repo_id", "from_id", "only"), symbols)
    return x.where("only is null or only <> caller_file").select("repo_id", "caller_file").distinct()


def outside_callers(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, caller_file, confidence): files that need one of files (repo_id, path) without being one themselves, with
    the greatest confidence of impact_files(), without its pairs."""
    k = _meant(symbols).join(files.select("repo_id", F.col("path").alias("file_path")), ["repo_id", "file_path"], "left_semi").select("repo_id", "key", "way").distinct()
    x = _with_caller(_met(edges, k, "from_id", "confidence").select("repo_id", "from_id", "confidence"), symbols)
    x = x.groupBy("repo_id", "caller_file").agg(F.max("confidence").alias("confidence"))
    return x.join(files.select("repo_id", F.col("path").alias("caller_file")), ["repo_id", "caller_file"], "left_anti")


def enclosing(probes: DataFrame, symbols: DataFrame) -> DataFrame:
    """probes (repo_id, file_path, line, probe) with the symbol_id of the nearest declaration at or above the line.

    As-of join by one pass in order of line within a file: probes and declarations together, the last one seen.
    """
    s = symbols.select("repo_id", "file_path", F.col("line").alias("line"), F.lit(None).cast("bigint").alias("probe"), F.struct("line", "symbol_id").alias("d"))
    p = probes.select("repo_id", "file_path", "line", F.col("probe").cast("bigint").alias("probe"), F.lit(None).cast(s.schema["d"].dataType).alias("d"))
    w = Window.partitionBy("repo_id", "file_path").orderBy("line").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = s.unionByName(p).withColumn("hit", F.max("d").over(w))
    return both.where("probe is not null").select("repo_id", "file_path", "line", "probe", F.col("hit.symbol_id").alias("symbol_id"))


def reach(start: DataFrame, edges: DataFrame, depth: int, backward: bool = False) -> DataFrame:
    """(repo_id, id, distance) of all nodes within depth steps of start (repo_id, id), breadth first.

    edges: (repo_id, from_id, to_id). Each level joins the frontier only and drops what was seen; nodes with
    many neighbours are split by a salt; levels are written to the shared folder.
    """
    scratch = Scratch(start.sparkSession, "reach")
    a, b = ("to_id", "from_id") if backward else ("from_id", "to_id")
    step = scratch.save(edges.select("repo_id", F.col(a).alias("id"), F.col(b).alias("next")).distinct(), "step")
    hot = scratch.save(hot_keys(step.groupBy("repo_id", "id").agg(F.count(F.lit(1)).alias("n")), ["repo_id", "id"]), "hot")
    seen = frontier = scratch.save(start.select("repo_id", "id").distinct().withColumn("distance", F.lit(0)), "level0")
    for k in range(1, depth + 1):
        found = salted_join(step, frontier, ["repo_id", "id"], "inner", hot=hot, spread=F.col("next")).select("repo_id", F.col("next").alias("id")).distinct()
        frontier = scratch.save(found.join(seen.select("repo_id", "id"), ["repo_id", "id"], "left_anti").withColumn("distance", F.lit(k)), f"level{k}")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def cycles(edges: DataFrame, longest: int = 4) -> DataFrame:
    """(repo_id, length, cycle): simple cycles of 2 to longest nodes of (repo_id, from_id, to_id), ids joined by >.

    Paths start at their least node, so each rotation is met once; a cycle and its reverse count as one. Loops to
    oneself are no cycles. Nodes that no cycle can hold (no way in or no way out) are dropped first.
    """
    scratch = Scratch(edges.sparkSession, "cycles")
    e = edges.where("from_id <> to_id").select("repo_id", "from_id", "to_id").distinct()
    for _ in range(3):
        e = e.join(e.select("repo_id", F.col("from_id").alias("to_id")).distinct(), ["repo_id", "to_id"], "left_semi").join(e.select("repo_id", F.col("to_id").alias("from_id")).distinct(), ["repo_id", "from_id"], "left_semi").select("repo_id", "from_id", "to_id")
    e = scratch.save(e, "edges")
    hop = e.select("repo_id", F.col("from_id").alias("end"), F.col("to_id").alias("next"))
    paths = e.where("from_id < to_id").select("repo_id", F.col("from_id").alias("start"), F.col("to_id").alias("end"), F.array("from_id", "to_id").alias("p"))
    found = []
    for n in range(2, longest + 1):
        wider = paths.join(hop, ["repo_id", "end"])
        found.append(wider.where("next = start").select("repo_id", F.lit(n).alias("length"), "p"))
        if n < longest:
            paths = scratch.save(wider.where((F.col("next") > F.col("start")) & ~F.array_contains("p", F.col("next"))).select("repo_id", "start", F.col("next").alias("end"), F.concat("p", F.array("next")).alias("p")), f"paths{n}")
    both = reduce(DataFrame.unionByName, found)
    back = F.concat(F.slice("p", 1, 1), F.reverse(F.slice("p", 2, longest)))
    return both.select("repo_id", "length", F.least(F.array_join("p", ">"), F.array_join(back, ">")).alias("cycle")).distinct()


def uncalled(symbols: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """(repo_id, symbol_id, name, file_path): symbols of these kinds that no call, type reference, import or use means,
    by id or by token. Test files, private names and entry names are left out."""
    used = edges.where(F.col("type").isin("CALLS", "TYPE_REF", "IMPORTS", "PUBLISHES", "USES_COMPONENT")).select("repo_id", "to_id").distinct()
    s = without_tests(symbols.where(F.col("kind").isin(*kinds)), "file_path")
    s = s.where(~F.col("name").startswith("_") & ~F.coalesce(F.col("signature").startswith("private "), F.lit(False)) & ~F.col("name").isin(*TRIVIAL_NAMES))
    ways = F.array(F.col("symbol_id"), *[F.concat(F.lit(p), F.col("name")) for p in ("callee:", "type:", "import:", "component:")])
    met = s.select("repo_id", "symbol_id", F.explode(ways).alias("to_id")).join(used, ["repo_id", "to_id"], "left_semi")
    return s.join(met.select("repo_id", "symbol_id").distinct(), ["repo_id", "symbol_id"], "left_anti").select("repo_id", "symbol_id", "name", "file_path")


# Fixed value: files that start a program, by name.
BOOTSTRAP = r"(?i)(^|/)(main|index|app|program|startup)\.[a-z]+$"


def entry_points(symbols: DataFrame, edges: DataFrame, kinds: list[str], handlers: DataFrame | None = None, most: int = 20) -> DataFrame:
    """(repo_id, symbol_id, how): where a repository may be entered, at most that many of it, the surest first.

    handler: the handlers of routes (repo_id, symbol_id) given; bootstrap: symbols of these kinds in files that start a
    program; uncalled: those of uncalled(). A symbol counts once; ties by file and id.
    """
    own = symbols.where(F.col("kind").isin(*kinds)).select("repo_id", "symbol_id", "file_path")
    ways = [own.where(F.col("file_path").rlike(BOOTSTRAP)).withColumn("rank", F.lit(1)), uncalled(symbols, edges, kinds).select("repo_id", "symbol_id", "file_path").withColumn("rank", F.lit(2))]
    if handlers is not None:
        ways.append(own.join(handlers.select("repo_id", "symbol_id").distinct(), ["repo_id", "symbol_id"]).withColumn("rank", F.lit(0)))
    one = reduce(DataFrame.unionByName, ways).groupBy("repo_id", "symbol_id", "file_path").agg(F.min("rank").alias("rank"))
    rn = F.row_number().over(Window.partitionBy("repo_id").orderBy("rank", "file_path", "symbol_id"))
    how = F.element_at(F.array(*map(F.lit, ("handler", "bootstrap", "uncalled"))), F.col("rank") + 1)
    return one.withColumn("rn", rn).where(F.col("rn") <= most).select("repo_id", "symbol_id", how.alias("how"))


def interface_siblings(symbols: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """(repo_id, symbol_id, sibling_id): methods and the methods of the same name in implementors or interfaces."""
    impl = edges.where("type = 'IMPLEMENTS'").select("repo_id", F.col("from_id").alias("cls"), F.col("to_id").alias("iface")).distinct()
    m = symbols.where("kind = 'method'").select("repo_id", "symbol_id", "name", F.col("parent_symbol_id").alias("owner"), "file_path")
    a = m.select("repo_id", F.col("symbol_id").alias("a"), "name", F.col("owner").alias("cls"))
    b = m.select("repo_id", F.col("symbol_id").alias("b"), "name", F.col("owner").alias("iface"))
    pairs = impl.join(a, ["repo_id", "cls"]).join(b, ["repo_id", "name", "iface"]).select("repo_id", "a", "b")
    both = pairs.select("repo_id", F.col("a").alias("symbol_id"), F.col("b").alias("sibling_id")).union(pairs.select("repo_id", "b", "a")).distinct()
    rn = F.row_number().over(Window.partitionBy("repo_id", "symbol_id").orderBy("sibling_id"))
    return both.withColumn("rn", rn).where(F.col("rn") <= most).drop("rn")


def impact_files(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, target_file, caller_file, confidence, reason, n_symbols) of token_pairs(): who else needs a file.

    The edges of a file that mean the same key are one row, the best of them, before they meet the key's symbols.
    """
    t = _meant(symbols).where("file_path is not null").select("repo_id", "symbol_id", F.col("file_path").alias("target_file"), "key", "way")
    best = F.max(F.struct("confidence", (-F.col("edge_id")).alias("first"), "reason"))  # of equal ones the first
    e = _meaning(_with_caller(edges, symbols), "repo_id", "caller_file", "edge_id", "confidence", "reason").groupBy("repo_id", "key", "sort", "caller_file").agg(best.alias("x"))
    e = Scratch(edges.sparkSession, "impact").save(e, "callers")
    x = salted_join(e, t, ["key", "repo_id"], "inner", hot=_hot_products(e, t), spread=F.col("caller_file"), hint="shuffle_hash").where("(way = 'i' or way = sort) and target_file <> caller_file")
    r = x.groupBy("repo_id", "target_file", "caller_file").agg(F.max("x").alias("x"), F.countDistinct("symbol_id").alias("n_symbols"))
    return r.select("repo_id", "target_file", "caller_file", "x.confidence", "x.reason", "n_symbols")


def reliability(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, median, low, unresolved, warning): how far edges can be trusted; 0.8 is left out as a default.

    median is 1 without edges; low are those under 0.75, unresolved the part whose target is a token.
    """
    own = edges.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.percentile(F.when(F.col("confidence") != 0.8, F.col("confidence")), F.lit(0.5)), F.lit(1.0)).alias("median"),
        F.sum(((F.col("confidence") < 0.75) & (F.col("confidence") != 0.8)).cast("bigint")).alias("low"), F.avg(is_token(F.col("to_id")).cast("int")).alias("unresolved"),
    )
    warning = F.when(F.col("unresolved") >= 0.3, "many unresolved").when(F.col("unresolved") >= 0.15, "some unresolved").when((F.col("median") < 0.75) & (F.col("low") > 5), "low confidence").when(F.col("unresolved") >= 0.05, "few unresolved")
    return own.select(*keys, "n", F.round("median", 6).alias("median"), "low", F.round("unresolved", 6).alias("unresolved"), warning.alias("warning"))


def dedupe_resolved(edges: DataFrame) -> DataFrame:
    """Of equal resolved edges the one inserted last; edges to tokens all stay."""
    keys = ["repo_id", "from_id", "to_id", "type", "assigned_expression"]
    last = edges.where(~is_token(F.col("to_id"))).groupBy(*keys).agg(F.max("edge_id").alias("edge_id"))
    return last.select("edge_id").unionAll(edges.where(is_token(F.col("to_id"))).select("edge_id"))


def cap_per_group(df: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """The first rows of each key in that order; most <= 0 keeps all."""
    return df if most <= 0 else df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("rn") <= most).drop("rn")
