"""Resolution of edge tokens and of names in documents to symbols."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import convention_key, convention_stem, is_test_path, similarity
from .graph import hot_targets, is_token
from .skew import salted_join

# Rank of symbol kinds as targets of a call, the best first; others come last.
KIND_RANK = {"method": 0, "function": 1, "constructor": 2, "class": 3, "interface": 4, "struct": 5, "record": 6, "property": 7, "variable": 8}
#: Confidence by how the target was found.
CONFIDENCE = {"same file": 0.9, "imported": 0.8, "name": 0.6, "external": 0.1}


def kind_rank(kind: Column) -> Column:
    c = F.lit(999)
    for k, r in KIND_RANK.items():
        c = F.when(kind == k, r).otherwise(c)
    return c


def imported_files(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, source_file, target_file) of resolved imports."""
    a = symbols.select("repo_id", F.col("symbol_id").alias("from_id"), F.col("file_path").alias("source_file"))
    b = symbols.select("repo_id", F.col("symbol_id").alias("to_id"), F.col("file_path").alias("target_file"))
    e = edges.where((F.col("type") == "IMPORTS") & ~is_token(F.col("to_id")))
    met = salted_join(e.join(a, ["repo_id", "from_id"]), b, ["repo_id", "to_id"], hot=hot_targets(e), spread=F.col("from_id"))
    return met.select("repo_id", "source_file", "target_file").distinct()


def best_candidate(edges: DataFrame, symbols: DataFrame, prefix: str, kinds: list[str]) -> DataFrame:
    """(edge_id, symbol_id, how): for edges to prefix:name the symbol of that name and kind that fits best.

    Score: same file 0, imported file 25, else 100, plus the rank of the kind; ties by path and id. Of each name the
    best symbol of a repository and of each file are found once; a (file, name) that is asked for then meets three of
    them at most a file it imports, and never all symbols of a common name.
    """
    asks = edges.where(F.col("to_id").startswith(prefix + ":")).select("repo_id", "edge_id", "from_id", F.substring_index(F.regexp_replace("to_id", f"^{prefix}:", ""), ".", -1).alias("name"))
    src = symbols.select("repo_id", F.col("symbol_id").alias("from_id"), F.col("file_path").alias("source_file"))
    asks = asks.join(src, ["repo_id", "from_id"])
    pool = symbols.where(F.col("kind").isin(*kinds)).select("repo_id", "name", F.struct(kind_rank(F.col("kind")).alias("rank"), "file_path", "symbol_id").alias("best"))
    in_file = pool.groupBy("repo_id", "name", "best.file_path").agg(F.min("best").alias("best"))
    anywhere = in_file.groupBy("repo_id", "name").agg(F.min("best").alias("best"))
    keys = ["repo_id", "source_file", "name"]
    wanted = asks.select(*keys).distinct()
    way = lambda points, how: F.struct((F.col("best.rank") + points).alias("score"), F.col("best.file_path").alias("file_path"), F.col("best.symbol_id").alias("symbol_id"), F.lit(how).alias("how"))
    imports = imported_files(edges, symbols).select("repo_id", "source_file", F.col("target_file").alias("file_path"))
    own = wanted.withColumn("file_path", F.col("source_file")).join(in_file, ["repo_id", "name", "file_path"]).select(*keys, way(0, "same file").alias("w"))
    near = wanted.join(imports, ["repo_id", "source_file"]).where("file_path <> source_file").join(in_file, ["repo_id", "name", "file_path"]).select(*keys, way(25, "imported").alias("w"))
    far = salted_join(wanted, anywhere, ["repo_id", "name"], spread=F.col("source_file")).select(*keys, way(100, "name").alias("w"))
    best = own.unionByName(near).unionByName(far).groupBy(*keys).agg(F.min("w").alias("b"))
    return salted_join(asks, best, keys, spread=F.col("edge_id")).select("edge_id", F.col("b.symbol_id").alias("symbol_id"), F.col("b.how").alias("how"))


def resolve(edges: DataFrame, symbols: DataFrame, prefix: str, kinds: list[str], external: list[str]) -> DataFrame:
    """(edge_id, to_id, confidence, reason) of all edges to prefix:name after resolution; what stays open keeps its token."""
    found = best_candidate(edges, symbols, prefix, kinds)
    conf = F.lit(None).cast("double")
    for how, c in CONFIDENCE.items():
        conf = F.coalesce(conf, F.when(F.col("how") == how, c))
    name = F.regexp_replace("to_id", f"^{prefix}:", "")
    outside = F.substring_index(name, ".", 1).isin(*external) if external else F.lit(False)
    e = edges.where(F.col("to_id").startswith(prefix + ":")).select("edge_id", "to_id", "confidence").join(found, "edge_id", "left")
    how = F.coalesce("how", F.when(outside, "external"))
    return e.withColumn("how", how).select("edge_id", F.coalesce("symbol_id", "to_id").alias("to_id"), F.coalesce(conf, "confidence").alias("confidence"), F.coalesce("how", F.lit("unresolved")).alias("reason"))


def cross_repo(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(edge_id, to_repo): unlinked resolved edges whose id lives in other repositories; of several the one with most symbols."""
    size = symbols.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    homes = symbols.select(F.col("symbol_id").alias("to_id"), "repo_id").distinct().join(size, "repo_id").select("to_id", F.col("repo_id").alias("to_repo"), "n")
    best = homes.groupBy("to_id").agg(F.max(F.struct("n", "to_repo")).alias("b"))
    claims = edges.where(~is_token(F.col("to_id"))).select("repo_id", "edge_id", "to_id")
    open_ = salted_join(claims, symbols.select("repo_id", F.col("symbol_id").alias("to_id")), ["repo_id", "to_id"], "left_anti", spread=F.col("edge_id"))
    return salted_join(open_, best, ["to_id"], spread=F.col("edge_id")).select("edge_id", F.col("b.to_repo").alias("to_repo"))


def mentions(documents: DataFrame) -> DataFrame:
    """(doc_id, repo_id, mention): identifiers in inline code, and camel or snake names, each once a document."""
    found = F.array_union(F.transform(F.regexp_extract_all("text", F.lit(r"`([A-Za-z_][\w.]{2,})`"), 1), lambda x: x), F.regexp_extract_all("text", F.lit(r"\b([a-z]+(?:[A-Z][a-z]+)+|[A-Z][a-z]+(?:[A-Z][a-z]+)+|[a-z]+(?:_[a-z]+)+)\b"), 1))
    return documents.where("text is not null").select("doc_id", "repo_id", F.explode(F.array_distinct(found)).alias("mention"))


def bind_mentions(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """(doc_id, mention, status, symbol_id, n_candidates): exact name, else without case; production code before tests;
    the best kind; one candidate binds, several are ambiguous, none is unbound."""
    s = symbols.select("repo_id", "name", "symbol_id", is_test_path(F.col("file_path")).cast("int").alias("test"), kind_rank(F.col("kind")).alias("rank"))
    keys = found.select("repo_id", "mention").distinct()
    exact = keys.join(s.withColumnRenamed("name", "mention"), ["repo_id", "mention"]).withColumn("tier", F.lit(0))
    lower = keys.withColumn("k", F.lower("mention")).join(s.withColumn("k", F.lower("name")).drop("name"), ["repo_id", "k"]).drop("k").withColumn("tier", F.lit(1))
    x = exact.unionByName(lower).withColumn("grade", F.struct("tier", "test", "rank"))
    best = x.withColumn("top", F.min("grade").over(Window.partitionBy("repo_id", "mention"))).where("grade = top").groupBy("repo_id", "mention").agg(F.countDistinct("symbol_id").alias("n_candidates"), F.min("symbol_id").alias("first"))
    r = found.join(best, ["repo_id", "mention"], "left")
    n = F.coalesce("n_candidates", F.lit(0))
    return r.select("doc_id", "mention", F.when(n == 0, "unbound").when(n == 1, "bound").otherwise("ambiguous").alias("status"), F.when(n == 1, F.col("first")).alias("symbol_id"), n.alias("n_candidates"))


def drift(names: DataFrame, symbols: DataFrame, least: float = 0.75) -> DataFrame:
    """(repo_id, mention, name, score): unbound names that look like a misspelt symbol of the same repository.

    Blocked by the first character and by the lengths that can reach least, as an edit distance is at least the
    difference in length; no two names of other blocks are compared. Names that are one identifier under another
    convention or number are no drift. The best symbol by score, ties by name.
    """
    block = lambda c: F.lower(F.substring(c, 1, 1))
    reach = F.sequence(F.ceil(F.length("mention") * least).cast("int"), F.floor(F.length("mention") / least).cast("int"))
    n = names.where(F.length("mention") >= 4).select("repo_id", "mention", block(F.col("mention")).alias("b"), F.explode(reach).alias("len")).distinct()
    s = symbols.where("kind <> 'module'").select("repo_id", "name", block(F.col("name")).alias("b"), F.length("name").alias("len")).distinct()
    x = n.join(s, ["repo_id", "b", "len"]).where((convention_key(F.col("mention")) != convention_key(F.col("name"))) & (convention_stem(F.col("mention")) != convention_stem(F.col("name"))))
    x = x.withColumn("score", F.round(similarity(F.col("mention"), F.col("name")), 6)).where(F.col("score") >= least)
    best = x.groupBy("repo_id", "mention").agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("m"))
    return best.select("repo_id", "mention", "m.name", (-F.col("m.s")).alias("score"))


def covering(required: DataFrame, offered: DataFrame) -> DataFrame:
    """(owner, taker): takers whose members cover all members of an owner; owners (owner, member), takers (taker, member).

    Relational division: count the common members and compare with the number required. Owners without members match none.
    """
    need = required.distinct().groupBy("owner").agg(F.count(F.lit(1)).alias("need"))
    got = required.distinct().join(offered.distinct(), "member").groupBy("owner", "taker").agg(F.count(F.lit(1)).alias("got"))
    return got.join(need, "owner").where("got = need and owner <> taker").select("owner", "taker")


def endpoint_key(path: Column) -> Column:
    """A route with its parameters made equal, for matching templates with calls."""
    return F.regexp_replace(F.lower(path), r"\{[^}]*\}", "{}")


def endpoint_match(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(call, route, tier): exact, else equal but for parameter names, else without one or two leading literal segments."""
    r = routes.select(F.col("path").alias("route"), endpoint_key(F.col("path")).alias("key")).distinct()
    c = calls.select(F.col("path").alias("call")).distinct()
    cut = lambda n: F.regexp_replace("call", rf"^(/[^/{{}}]+){{{n}}}(?=/)", "")
    tiers = [(0, "exact", F.col("call"), "route"), (1, "wildcard", endpoint_key(F.col("call")), "key"), (2, "gateway_prefix", endpoint_key(cut(1)), "key"), (3, "gateway_prefix", endpoint_key(cut(2)), "key")]
    found = None
    for rank, name, key, on in tiers:
        x = c.withColumn(on, key).join(r, on).select("call", "route", F.lit(rank).alias("rank"), F.lit(name).alias("tier"))
        found = x if found is None else found.unionByName(x)
    best = found.groupBy("call").agg(F.min(F.struct("rank", "route", "tier")).alias("b"))
    return best.select("call", "b.route", "b.tier")


def packages(edges: DataFrame, symbols: DataFrame, kinds: tuple[str, ...] = ("module", "class", "interface", "type")) -> DataFrame:
    """(edge_id, symbol_id): npm: and nuget: tokens to the module or the exported type of that name, the first by repository
    and id."""
    m = symbols.where(F.col("kind").isin(*kinds)).groupBy("name").agg(F.min(F.struct("repo_id", "symbol_id")).alias("m"))
    e = edges.where(F.col("to_id").rlike("^(npm|nuget):")).select("edge_id", F.regexp_replace("to_id", "^(npm|nuget):", "").alias("name"))
    return e.join(m, "name").select("edge_id", F.col("m.symbol_id").alias("symbol_id"))


def publish_consume(edges: DataFrame) -> DataFrame:
    """(contract, producer, consumer): who publishes and who consumes a contract: token, not to itself."""
    side = lambda kind, name: edges.where(F.col("type") == kind).select(F.col("to_id").alias("contract"), F.col("from_id").alias(name)).distinct()
    return side("PUBLISHES", "producer").join(side("CONSUMES", "consumer"), "contract").where("producer <> consumer")


def class_bases(edges: DataFrame) -> DataFrame:
    """(repo_id, class_id, base_id, position): every base of each class once, in the order of its edges, from 1."""
    one = edges.where(F.col("type") == "EXTENDS").groupBy("repo_id", F.col("from_id").alias("class_id"), F.col("to_id").alias("base_id")).agg(F.min("edge_id").alias("edge_id"))
    return one.select("repo_id", "class_id", "base_id", F.row_number().over(Window.partitionBy("repo_id", "class_id").orderBy("edge_id", "base_id")).alias("position"))


def merge_bases(bases: list[str], lines: list[list[str]]) -> list[str] | None:
    """The C3 merge of the linearizations of bases, and of bases; None if there is none."""
    seqs = [deque(x) for x in [*lines, bases] if x]
    tails = Counter(y for s in seqs for y in islice(s, 1, None))
    out = []
    while seqs:
        head = next((s[0] for s in seqs if not tails[s[0]]), None)
        if head is None:
            return None
        out.append(head)
        for s in seqs:
            if s[0] == head:
                s.popleft()
                if s:
                    tails[s[0]] -= 1
        seqs = [s for s in seqs if s]
    return out


def linearize(bases: dict[str, list[str]]) -> Iterator[tuple[str, list[str]]]:
    """Each class with all its ancestors by C3; breadth first where C3 fails or a cycle is reached."""
    lines: dict[str, list[str] | None] = {}
    for start in bases:
        todo, open_ = [start], set()
        while todo:
            c = todo[-1]
            if c in lines:
                todo.pop()
                continue
            missing = [b for b in bases.get(c, []) if b not in lines]
            if c not in open_ and missing and c not in missing:
                open_.add(c)
                todo += [b for b in reversed(missing) if b not in open_]
                if todo[-1] != c:
                    continue
            todo.pop()
            own = bases.get(c, [])
            above = [lines.get(b) for b in own]
            merged = None if any(x is None for x in above) or c in own else merge_bases(own, above)
            lines[c] = None if merged is None else [c, *merged]
        if (line := lines[start]) is None:
            seen, queue = {start: None}, deque([start])
            while queue:
                for b in bases.get(queue.popleft(), []):
                    if b not in seen:
                        seen[b] = None
                        queue.append(b)
            line = list(seen)
        yield start, line[1:]


def base_chain(edges: DataFrame) -> DataFrame:
    """(repo_id, class_id, base_id, level): all ancestors of each class in Python's method resolution order, from 1.

    A repository's class hierarchy is linearized in one task.
    """

    def lines(b: pd.DataFrame) -> pd.DataFrame:
        bases: dict[str, list[str]] = {}
        for c, x in b.sort_values("position")[["class_id", "base_id"]].itertuples(index=False):
            bases.setdefault(c, []).append(x)
        out = [(c, x, k) for c, line in linearize(bases) for k, x in enumerate(line, 1)]
        return pd.DataFrame(out, columns=["class_id", "base_id", "level"]).assign(repo_id=b["repo_id"].iloc[0])[["repo_id", "class_id", "base_id", "level"]]

    one = class_bases(edges).where("repo_id is not null and class_id is not null and base_id is not null")
    return one.groupBy("repo_id").applyInPandas(lines, "repo_id string, class_id string, base_id string, level int")


def components(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(edge_id, symbol_id): component: tokens to a component of that name in a file that the source imports."""
    src = symbols.select("repo_id", F.col("symbol_id").alias("from_id"), F.col("file_path").alias("source_file"))
    e = edges.where(F.col("to_id").startswith("component:")).select("repo_id", "edge_id", "from_id", F.regexp_replace("to_id", "^component:", "").alias("name")).join(src, ["repo_id", "from_id"])
    c = symbols.where("kind in ('component', 'class')").select("repo_id", "name", "symbol_id", F.col("file_path").alias("target_file"))
    x = e.join(c, ["repo_id", "name"]).join(imported_files(edges, symbols), ["repo_id", "source_file", "target_file"], "left_semi")
    return x.groupBy("edge_id").agg(F.min("symbol_id").alias("symbol_id"))


def sql_definitions(objects: DataFrame) -> DataFrame:
    """(key, definition, state) of (key, seq, action, definition): the last action of a name decides whether it is current
    or dropped; ties by definition."""
    last = objects.groupBy("key").agg(F.max(F.struct("seq", "action", "definition")).alias("x"))
    return last.select("key", F.col("x.definition").alias("definition"), F.when(F.col("x.action") == "drop", "dropped").otherwise("current").alias("state"))
