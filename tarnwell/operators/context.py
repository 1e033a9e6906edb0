"""What surrounds a symbol, a file or a change in the graph: references, contexts, seeds, routes, dispatch, bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import CALL_TYPES, DEPENDENCY_TYPES, endpoints, hot_targets, interface_siblings, is_token, outside_callers, token_pairs
from .resolve import kind_rank
from .skew import salted_join

#: Methods that a call through a contract is spread to at most; a parameter of the dispatch operators.
FAN_OUT = 10
DISPATCH_CONFIDENCE = 0.7


def _first(df: DataFrame, keys: list[str], *order: Column | str, most: int = 1) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= most).drop("__rn")


def references(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, symbol_id, edge_id, type, from_id, source_file): every edge that means a symbol, by id or by token;
    source_file is NULL if the source is no symbol."""
    src = symbols.select("repo_id", F.col("symbol_id").alias("from_id"), F.col("file_path").alias("source_file"))
    e = edges.select("repo_id", "edge_id", "to_id", "type", "from_id").join(src.hint("shuffle_hash"), ["from_id", "repo_id"], "left")
    return token_pairs(symbols, e, "type", "from_id", "source_file")


def edge_priority(kind: Column) -> Column:
    """Calls first, then dependencies, then types, then the rest."""
    return F.when(kind.isin(*CALL_TYPES), 0).when(kind.isin(*DEPENDENCY_TYPES), 1).when(kind == "TYPE_REF", 2).otherwise(3)


def file_context(symbols: DataFrame, edges: DataFrame, batches: DataFrame, budget: int) -> DataFrame:
    """(repo_id, batch, edge_id, way, position, truncated): the edges of the files of each batch (repo_id, batch, file_path).

    way: out, in, or inner if both ends are in the batch; each edge once a batch. Edges come by priority, then in order
    of insertion; of more than budget, which then is truncated, the first are kept.
    """
    ends = endpoints(edges.select("repo_id", "edge_id", "from_id", "to_id", "type"), symbols)
    side = lambda c, out: ends.where(F.col(c).isNotNull()).select("repo_id", "edge_id", "type", F.col(c).alias("file_path"), F.lit(out).alias("out"))
    met = salted_join(side("source_file", 1).unionByName(side("target_file", 0)), batches, ["repo_id", "file_path"], spread=F.col("edge_id"))
    one = met.groupBy("repo_id", "batch", "edge_id").agg(F.min("type").alias("type"), F.min("out").alias("a"), F.max("out").alias("b"))
    order = Window.partitionBy("repo_id", "batch").orderBy(edge_priority(F.col("type")), "edge_id")
    way = F.when(F.col("a") < F.col("b"), "inner").when(F.col("a") == 1, "out").otherwise("in")
    ranked = one.select("repo_id", "batch", "edge_id", way.alias("way"), F.row_number().over(order).cast("bigint").alias("position")).where(F.col("position") <= budget + 1)
    truncated = F.max("position").over(Window.partitionBy("repo_id", "batch")) > budget
    return ranked.withColumn("truncated", truncated).where(F.col("position") <= budget)


def impact_seed(symbols: DataFrame, edges: DataFrame, most: int = 60) -> DataFrame:
    """(repo_id, file_path, symbol_id, how): the symbols of each file (own), and the siblings of its first seeds (sibling).

    Seeds: types first, then by line and id; modules are none, and of a file at most that many ask for siblings.
    """
    own = symbols.where("kind <> 'module'").select("repo_id", "file_path", "symbol_id", "kind", "line")
    types = F.when(F.col("kind").isin("class", "interface", "struct", "record", "type"), 0).otherwise(1)
    asking = _first(own, ["repo_id", "file_path"], types, "line", "symbol_id", most=most)
    more = asking.join(interface_siblings(symbols, edges), ["repo_id", "symbol_id"]).select("repo_id", "file_path", F.col("sibling_id").alias("symbol_id")).distinct()
    seeds = own.select("repo_id", "file_path", "symbol_id")
    return seeds.withColumn("how", F.lit("own")).unionByName(more.join(seeds, ["repo_id", "file_path", "symbol_id"], "left_anti").withColumn("how", F.lit("sibling")))


def change_set(changes: DataFrame) -> DataFrame:
    """(repo_id, path, change) of (repo_id, path, old_path, change): a rename is a removal and an addition; a path counts
    once, removed before added before modified."""
    gone = changes.where("change = 'renamed' and old_path is not null").select("repo_id", F.col("old_path").alias("path"), F.lit("removed").alias("change"))
    now = changes.select("repo_id", "path", F.when(F.col("change") == "renamed", "added").otherwise(F.col("change")).alias("change"))
    rank = F.when(F.col("change") == "removed", 0).when(F.col("change") == "added", 1).otherwise(2)
    best = now.unionByName(gone).groupBy("repo_id", "path").agg(F.min(F.struct(rank.alias("rank"), "change")).alias("x"))
    return best.select("repo_id", "path", "x.change")


def change_impact(changes: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, n_changed, n_affected, confidence, level): files that need a changed file as in impact_files(), the changed
    ones left out, with the greatest confidence; level by the number of affected files: low to 5, medium to 20, then high."""
    c = change_set(changes)
    per = outside_callers(symbols, edges, c).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_affected"), F.max("confidence").alias("confidence"))
    r = c.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_changed")).join(per, "repo_id", "left")
    n = F.coalesce("n_affected", F.lit(0))
    return r.select("repo_id", "n_changed", n.alias("n_affected"), "confidence", F.when(n > 20, "high").when(n > 5, "medium").otherwise("low").alias("level"))


def shared_depth(a: Column, b: Column) -> Column:
    """How many leading folders two paths have in common."""
    x, y = F.split(a, "/"), F.split(b, "/")
    n = F.least(F.size(x), F.size(y)) - 1
    return F.when(n < 1, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.slice(x, 1, k) == F.slice(y, 1, k))))


def route_handlers(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, route_id, handler_id): the method that a route (repo_id, route_id, controller, handler, file_path) means.

    Methods of that name in a class of that name; of several the one that shares most leading folders with the route's
    file. Of several that share equally many the route is ambiguous if they share none, else the least id wins.
    """
    owner = symbols.where("kind in ('class', 'interface', 'record', 'struct')").select("repo_id", F.col("symbol_id").alias("parent_symbol_id"), F.col("name").alias("controller"))
    m = symbols.where("kind in ('method', 'function')").join(owner, ["repo_id", "parent_symbol_id"])
    m = m.select("repo_id", "controller", F.col("name").alias("handler"), "symbol_id", F.col("file_path").alias("handler_file"))
    x = routes.join(m, ["repo_id", "controller", "handler"]).withColumn("depth", shared_depth(F.col("file_path"), F.col("handler_file")))
    best = x.groupBy("repo_id", "route_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("depth")).alias("d"), "symbol_id")).alias("b"))
    return best.where("n = 1 or b.d < 0").select("repo_id", "route_id", F.col("b.symbol_id").alias("handler_id"))


def route_map(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, route_id, verb, path, handler_id, handler_name): every route, with its handler if one can be told; the
    name is the route's own, else the symbol's."""
    names = symbols.select("repo_id", F.col("symbol_id").alias("handler_id"), F.col("name").alias("found"))
    r = routes.join(route_handlers(routes, symbols), ["repo_id", "route_id"], "left").join(names, ["repo_id", "handler_id"], "left")
    return r.select("repo_id", "route_id", "verb", "path", "handler_id", F.coalesce("handler", "found").alias("handler_name"))


def dispatch(edges: DataFrame, symbols: DataFrame, contract: str, most: int = FAN_OUT) -> DataFrame:
    """(repo_id, from_id, to_id, confidence): calls of a contract's method, sent on to the same-named methods of those who
    fulfil it: contract is IMPLEMENTS (interfaces) or EXTENDS (bases).

    At most that many methods a called one, by id; a call that is an edge already is not added.
    """
    link = edges.where((F.col("type") == contract) & ~is_token(F.col("to_id"))).select("repo_id", F.col("from_id").alias("taker"), F.col("to_id").alias("giver")).distinct()
    m = symbols.where("kind = 'method' and parent_symbol_id is not null").select("repo_id", "symbol_id", "name", "parent_symbol_id")
    given = m.select("repo_id", "name", F.col("symbol_id").alias("called"), F.col("parent_symbol_id").alias("giver"))
    taken = m.select("repo_id", "name", F.col("symbol_id").alias("to_id"), F.col("parent_symbol_id").alias("taker"))
    plan = _first(link.join(given, ["repo_id", "giver"]).join(taken, ["repo_id", "taker", "name"]).select("repo_id", "called", "to_id").distinct(), ["repo_id", "called"], "to_id", most=most)
    calls = edges.where("type = 'CALLS'").select("repo_id", "from_id", "to_id").distinct()
    added = salted_join(calls.withColumnRenamed("to_id", "called"), plan, ["repo_id", "called"], spread=F.col("from_id")).select("repo_id", "from_id", "to_id").distinct()
    return added.join(calls, ["repo_id", "from_id", "to_id"], "left_anti").withColumn("confidence", F.lit(DISPATCH_CONFIDENCE))


def typed_dispatch(edges: DataFrame, symbols: DataFrame, most: int = FAN_OUT) -> DataFrame:
    """(repo_id, interface_id, implementor_id, n_calls): for each interface whose methods are called, the classes that
    calls go to, at most that many, by id."""
    m = symbols.where("kind = 'method'").select("repo_id", F.col("symbol_id").alias("to_id"), F.col("parent_symbol_id").alias("interface_id"))
    i = symbols.where("kind = 'interface'").select("repo_id", F.col("symbol_id").alias("interface_id"))
    called = salted_join(edges.where("type = 'CALLS'").select("repo_id", "edge_id", "to_id"), m.join(i, ["repo_id", "interface_id"]), ["repo_id", "to_id"], spread=F.col("edge_id"))
    n = called.groupBy("repo_id", "interface_id").agg(F.count(F.lit(1)).alias("n_calls"))
    link = edges.where((F.col("type") == "IMPLEMENTS") & ~is_token(F.col("to_id"))).select("repo_id", F.col("to_id").alias("interface_id"), F.col("from_id").alias("implementor_id")).distinct()
    return _first(n.join(link, ["repo_id", "interface_id"]), ["repo_id", "interface_id"], "implementor_id", most=most)


def fixture_reach(edges: DataFrame, symbols: DataFrame, is_test) -> DataFrame:
    """(repo_id, source_id, test_id): tests that call a helper that calls a source; only the tests lie in test files."""
    y = symbols.select("repo_id", "symbol_id", is_test(F.col("file_path")).alias("test"))
    calls = edges.where((F.col("type") == "CALLS") & ~is_token(F.col("to_id"))).select("repo_id", "from_id", "to_id").distinct()
    tested = calls.join(y.where("test").select("repo_id", F.col("symbol_id").alias("from_id")), ["repo_id", "from_id"], "left_semi")
    plain = y.where("not test").select("repo_id", F.col("symbol_id").alias("to_id"))
    second = salted_join(calls, plain, ["repo_id", "to_id"], "left_semi", spread=F.col("from_id"))
    helpers = tested.select("repo_id", F.col("from_id").alias("test_id"), F.col("to_id").alias("from_id"))
    return salted_join(helpers, second, ["repo_id", "from_id"], spread=F.col("test_id")).select("repo_id", F.col("to_id").alias("source_id"), "test_id").distinct()


def importing_files(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, file_path, importer): files that import a file by its module symbol, itself left out."""
    module = symbols.where("kind = 'module'").select("repo_id", F.col("symbol_id").alias("to_id"), "file_path")
    src = symbols.select("repo_id", F.col("symbol_id").alias("from_id"), F.col("file_path").alias("importer"))
    e = edges.where("type = 'IMPORTS'").select("repo_id", "from_id", "to_id")
    met = salted_join(e, module, ["repo_id", "to_id"], hot=hot_targets(e), spread=F.col("from_id")).join(src, ["repo_id", "from_id"])
    return met.where("importer <> file_path").select("repo_id", "file_path", "importer").distinct()


def ids_at_risk(rows: DataFrame, group: list[str], key: str, old: str, new: str) -> DataFrame:
    """(group, key): rows that change places with another one of their group when the order goes from old to new.

    A row keeps its place towards all others if none before it in the old order comes after it in the new one, and none
    after it comes before it; so the greatest new rank so far and the least one to come decide, in place of all pairs.
    """
    r = rows.select(*group, key, F.row_number().over(Window.partitionBy(*group).orderBy(old, key)).alias("a"), F.row_number().over(Window.partitionBy(*group).orderBy(new, key)).alias("b"))
    w = Window.partitionBy(*group).orderBy("a")
    r = r.withColumn("before", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.min("b").over(w.rowsBetween(1, Window.unboundedFollowing)))
    return r.where("before > b or after < b").select(*group, key)


def provider_symbols(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, type, provider_repo, symbol_id): for types that a repository uses and lacks, the symbol of that name in
    another repository, the first by repository, file and id."""
    own = symbols.where("kind in ('class', 'interface', 'struct', 'record', 'type')").select("repo_id", "name", "file_path", "symbol_id")
    used = edges.where(F.col("to_id").startswith("type:")).select("repo_id", F.regexp_replace("to_id", "^type:", "").alias("type")).distinct()
    lacking = used.join(own.select("repo_id", F.col("name").alias("type")), ["repo_id", "type"], "left_anti")
    offers = own.groupBy(F.col("name").alias("type")).agg(F.min(F.struct("repo_id", "file_path", "symbol_id")).alias("p"))
    return lacking.join(offers, "type").select("repo_id", "type", F.col("p.repo_id").alias("provider_repo"), F.col("p.symbol_id").alias("symbol_id"))


def package_providers(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(package, provider_repo, consumer_repo): packages that a repository depends on and another one declares a symbol
    for; a repository is no consumer of its own package."""
    used = edges.where(F.col("to_id").rlike("^(npm|nuget):")).select(F.regexp_replace("to_id", "^(npm|nuget):", "").alias("package"), F.col("repo_id").alias("consumer_repo")).distinct()
    made = symbols.select(F.col("name").alias("package"), F.col("repo_id").alias("provider_repo")).distinct()
    return used.join(made, "package").where("provider_repo <> consumer_repo").select("package", "provider_repo", "consumer_repo")


def package_exists(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """(package, found) of (package): whether any repository depends on it."""
    known = edges.where(F.col("to_id").rlike("^(npm|nuget):")).select(F.regexp_replace("to_id", "^(npm|nuget):", "").alias("package"), F.lit(True).alias("found")).distinct()
    return asked.select("package").distinct().join(known, "package", "left").select("package", F.coalesce("found", F.lit(False)).alias("found"))


def package_similar(asked: DataFrame, edges: DataFrame, length: int = 6, most: int = 10) -> DataFrame:
    """(package, similar): known packages with the same beginning, without case; the first by name, at most that many."""
    known = edges.where(F.col("to_id").rlike("^(npm|nuget):")).select(F.regexp_replace("to_id", "^(npm|nuget):", "").alias("similar")).distinct()
    start = lambda c: F.lower(F.substring(c, 1, length))
    x = asked.select("package").distinct().withColumn("k", start("package")).join(known.withColumn("k", start("similar")), "k").where("package <> similar")
    return _first(x.select("package", "similar"), ["package"], "similar", most=most)


def package_bridge(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, attempted, resolved): distinct (source, package) pairs of a repository, and those that another one provides."""
    tried = edges.where(F.col("to_id").rlike("^(npm|nuget):")).select("repo_id", "from_id", F.regexp_replace("to_id", "^(npm|nuget):", "").alias("package")).distinct()
    made = package_providers(edges, symbols).select(F.col("consumer_repo").alias("repo_id"), "package", F.lit(1).alias("met")).distinct()
    return tried.join(made, ["repo_id", "package"], "left").groupBy("repo_id").agg(F.count(F.lit(1)).alias("attempted"), F.count("met").alias("resolved"))


def feature_bundle(seeds: DataFrame, symbols: DataFrame, suffixes: list[str], prefixes: list[str], roles: list[str], most: int = 50) -> DataFrame:
    """(repo_id, seed, entity, role, symbol_id): symbols named after the same thing as a seed (repo_id, seed).

    One known suffix, the longest first, and one prefix are taken off the seed; roles are patterns with {E} for what is
    left. At most that many symbols a seed, by role, file and id.
    """
    cut = F.regexp_replace("seed", "(?:" + "|".join(sorted(suffixes, key=lambda x: (-len(x), x))) + ")$", "")
    entity = F.regexp_replace(cut, "^(?:" + "|".join(prefixes) + ")(?=[A-Z])", "")
    s = seeds.select("repo_id", "seed").distinct().withColumn("entity", entity).where("entity <> '' and entity <> seed")
    s = s.withColumn("role", F.explode(F.array(*map(F.lit, roles)))).withColumn("name", F.replace("role", F.lit("{E}"), F.col("entity")))
    x = s.join(symbols.select("repo_id", "name", "symbol_id", "file_path"), ["repo_id", "name"])
    return _first(x, ["repo_id", "seed"], "role", "file_path", "symbol_id", most=most).select("repo_id", "seed", "entity", "role", "symbol_id")


def context_pack(symbols: DataFrame, edges: DataFrame, name: str, most: int = 20) -> DataFrame:
    """(repo_id, role, symbol_id): for the best symbol of a name in each repository (symbol) its callers, those of its
    siblings included (caller), what it calls (callee) and who imports it (importer); at most that many a role, by id.

    The best: equal name before equal but for case, then kind, file and id.
    """
    s = symbols.where(F.lower("name") == name.lower())
    best = _first(s, ["repo_id"], F.when(F.col("name") == name, 0).otherwise(1), kind_rank(F.col("kind")), "file_path", "symbol_id").select("repo_id", "symbol_id")
    meant = best.unionByName(best.join(interface_siblings(symbols, edges), ["repo_id", "symbol_id"]).select("repo_id", F.col("sibling_id").alias("symbol_id"))).distinct()
    e = edges.where(~is_token(F.col("to_id"))).select("repo_id", "from_id", "to_id", "type")
    into = lambda whom, types: e.where(F.col("type").isin(*types)).join(F.broadcast(whom.select("repo_id", F.col("symbol_id").alias("to_id"))), ["repo_id", "to_id"]).select("repo_id", F.col("from_id").alias("symbol_id"))
    out = e.where(F.col("type").isin(*CALL_TYPES)).join(best.select("repo_id", F.col("symbol_id").alias("from_id")), ["repo_id", "from_id"]).select("repo_id", F.col("to_id").alias("symbol_id"))
    rows = into(meant, CALL_TYPES).withColumn("role", F.lit("caller")).unionByName(out.withColumn("role", F.lit("callee"))).unionByName(into(best, DEPENDENCY_TYPES).withColumn("role", F.lit("importer"))).distinct()
    return best.withColumn("role", F.lit("symbol")).unionByName(_first(rows, ["repo_id", "role"], "symbol_id", most=most)).select("repo_id", "role", "symbol_id")


def superseded(objects: DataFrame) -> DataFrame:
    """(key, definition, current) of (key, seq, action, definition): definitions that a later one of their key replaces,
    with the one that holds now; NULL if the last action drops it."""
    w = Window.partitionBy("key").orderBy(F.desc("seq"), F.desc("definition"))
    r = objects.select("key", "definition", "action", F.row_number().over(w).alias("rn"), F.first("definition").over(w).alias("last"), F.first("action").over(w).alias("how"))
    return r.where("action <> 'drop' and (rn > 1)").where("not (how <> 'drop' and definition = last)").select("key", "definition", F.when(F.col("how") != "drop", F.col("last")).alias("current")).distinct()


# Quoted words, and what stands before one that is compared or looked for, and before one that is assigned or returned.
QUOTED = r"['\"]([A-Za-z][\w.-]*)['\"]"
CONSUMED = r"(?:[=!]==?|\bcase|\bin|\bincludes\(|\bfrom|\brequire\()\s*\(?" + QUOTED
PRODUCED = r"(?:[^=!<>]=|\breturn|:|=>)\s*" + QUOTED


def literal_roles(texts: DataFrame) -> DataFrame:
    """(value, repo_id, producer, consumer, unknown) of (repo_id, content): how each quoted word is used.

    A place that compares, switches on, imports or looks for the value consumes it; one that assigns or returns it
    produces it; any other use is unknown. Each occurrence counts.
    """
    found = lambda pattern: F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), found(p).alias("values")) for k, p in (("a", QUOTED), ("c", CONSUMED), ("p", PRODUCED))])
    v = texts.where("content is not null").select("repo_id", F.inline(kinds)).select("repo_id", "kind", F.explode("values").alias("value"))
    n = v.groupBy("value", "repo_id").agg(F.count_if(F.expr("kind = 'p'")).alias("producer"), F.count_if(F.expr("kind = 'c'")).alias("consumer"), F.count_if(F.expr("kind = 'a'")).alias("n"))
    return n.select("value", "repo_id", "producer", "consumer", F.greatest(F.col("n") - F.col("producer") - F.col("consumer"), F.lit(0)).alias("unknown"))


def value_contracts(roles: DataFrame) -> DataFrame:
    """(value, producers, consumers, repos): values of literal_roles() that one repository produces and another consumes."""
    r = roles.groupBy("value").agg(F.count_if(F.expr("producer > 0")).alias("producers"), F.count_if(F.expr("consumer > 0")).alias("consumers"), F.count(F.lit(1)).alias("repos"))
    return r.where("producers > 0 and consumers > 0 and repos > 1")


def unify_via(edges: DataFrame) -> DataFrame:
    """(repo_id, from_id, to_id, reason): of the markers of a call's way (reason) between the same ends the least."""
    return edges.where((F.col("type") == "CALLS") & ~is_token(F.col("to_id"))).groupBy("repo_id", "from_id", "to_id").agg(F.min("reason").alias("reason"))


def suppress_bare(edges: DataFrame, symbols: DataFrame, bare: str, qualified: str) -> DataFrame:
    """(edge_id, to_id, confidence): calls found by the bare name (reason bare) in another file, put back to their token at
    0.1 where a qualified call (reason qualified) of the same caller and name goes to another target."""
    y = symbols.select("repo_id", "symbol_id", "name", "file_path")
    ends = endpoints(edges.where("type = 'CALLS'").where(F.col("reason").isin(bare, qualified)).select("repo_id", "edge_id", "from_id", "to_id", "reason"), y.withColumn("kind", F.lit("")), "inner")
    loose = ends.where((F.col("reason") == bare) & (F.col("source_file") != F.col("target_file"))).select("repo_id", "from_id", "target_name", "edge_id", "to_id")
    sure = ends.where(F.col("reason") == qualified).groupBy("repo_id", "from_id", "target_name").agg(F.min("to_id").alias("a"), F.max("to_id").alias("b"))
    x = loose.join(sure, ["repo_id", "from_id", "target_name"]).where("a <> to_id or b <> to_id")
    return x.select("edge_id", F.concat(F.lit("callee:"), "target_name").alias("to_id"), F.lit(0.1).alias("confidence"))
