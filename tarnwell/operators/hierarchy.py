"""Problem 5: parent-child links to full hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .references import current_symbols
from .skew import HOT_ROWS, hot_keys, salted_join

KEY = ["scope", "id"]


def live_links(symbols: DataFrame) -> DataFrame:
    """(scope, id, parent): live symbols and what they name as parent, be it live or not."""
    return current_symbols(symbols).where("live").select(F.col("repo_id").alias("scope"), F.col("symbol_id").alias("id"), F.col("parent_symbol_id").alias("parent"))


class Hierarchy:
    """Paths, depths, roots, descendants and closed chains of (scope, id, parent), one row per node.

    Bottom-up leaf peeling. A round removes the nodes without remaining children, together with every node above
    them that has no other child left, as peeling node by node would get there next; how far such a line of only
    children goes is found by pointers from child to child that get three times as long in each step. Removed nodes send the sizes of their subtrees
    to their parents, summed within each split first. A round leaves at most half as many leaves as it found, so
    rounds grow with the logarithm of the table and not with the height of its trees. What no round can remove are
    the closed chains. A node costs a few numbers a round; lists are made only in the walk down, where the rounds
    are taken in reverse and each line gets its paths from that of its parent. Nodes that only hang below a closed
    chain have no root and no path. All rounds write to the shared folder; joins to parents with many children are
    salted. Lists are as long as paths, never as the number of children: descendants are kept in long form.

    Defined cases: a parent that is no node, or NULL, makes a root; no nodes, no rows; a node that is its own parent
    is a closed chain of one.
    """

    def __init__(self, links: DataFrame, hot_rows: int = HOT_ROWS):
        self.spark, self.hot_rows, self._nodes = links.sparkSession, hot_rows, None
        self.scratch = Scratch(self.spark, "hierarchy")
        self.peeled: list[DataFrame] = []
        links = self.scratch.save(links.select(*KEY, "parent"), "links")
        self.rest = self._counted(links.withColumn("below", F.lit(0).cast("bigint")), None)
        while self.rest.where("kids = 0").limit(1).count():
            self._peel()

    def _counted(self, left: DataFrame, sizes: DataFrame | None) -> DataFrame:
        """(scope, id, parent, below, kids, child): what is left, with the number of its children and one of them."""
        kids = left.where(F.col("parent").isNotNull()).groupBy("scope", F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"), F.min("id").alias("child"))
        met = left.join(kids, KEY, "left")
        if sizes is not None:
            met = met.join(sizes, KEY, "left").withColumn("below", F.col("below") + F.coalesce("more", F.lit(0)))
        return self.scratch.save(met.select(*KEY, "parent", "below", F.coalesce("kids", F.lit(0)).alias("kids"), "child"), f"left{len(self.peeled)}")

    def _peel(self) -> None:
        """One round: moves what can be removed from rest to peeled."""
        left, base = self.rest, [*KEY, "parent", "below"]
        lines = self._lines(left.where("kids = 1"), left, len(self.peeled))
        leaves = left.where("kids = 0").select(*KEY, "parent", F.col("below").alias("n"), F.col("id").alias("leaf"), F.lit(0).cast("bigint").alias("height"))
        gone = leaves.unionByName(lines.where("met = 0").select(*leaves.columns))
        sizes = gone.where(F.col("parent").isNotNull()).groupBy("scope", F.col("parent").alias("id")).agg(F.sum(F.col("n") + 1).alias("more"))
        self.peeled.append(gone)
        self.rest = self._counted(left.where("kids > 1").select(*base).unionByName(lines.where("met is null or met > 1").select(*base)), sizes)

    def _lines(self, inner: DataFrame, counted: DataFrame, k: int) -> DataFrame:
        """inner, the nodes with one child, with the first node below that has none or several: its id (leaf), the number of
        its children (met, NULL if there is none), the steps to it (height), and the nodes below them all (n)."""
        child = counted.select("scope", F.col("id").alias("leaf"), F.col("below").alias("b"), F.col("kids").alias("m"))
        now = inner.select(*KEY, "parent", "below", F.col("child").alias("leaf")).join(child, ["scope", "leaf"])
        now = now.select(*KEY, "parent", "below", "leaf", F.lit(1).cast("bigint").alias("height"), (F.col("below") + F.col("b") + 1).alias("n"), F.when(F.col("m") != 1, F.col("m")).alias("met"))
        now, open_before = self.scratch.save(now, f"line{k}_0"), None
        for step in range(1, 200):
            still = now.where("met is null").count()
            if not still or still == open_before:  # in each step some node of any line with an end learns of it
                break
            ahead = now.select("scope", F.col("id").alias("leaf"), F.col("leaf").alias("then"), F.col("height").alias("h"), (F.col("n") - F.col("below")).alias("b"), F.col("met").alias("m"))
            going = now.where("met is null")
            for how in ("inner", "left"):  # what has met its end after the first leap finds nothing in the second
                going = going.join(ahead, ["scope", "leaf"], how).select(
                    *KEY, "parent", "below", F.coalesce("then", "leaf").alias("leaf"), (F.col("height") + F.coalesce("h", F.lit(0))).alias("height"),
                    (F.col("n") + F.coalesce("b", F.lit(0))).alias("n"), F.coalesce("met", "m").alias("met"),
                )
            now, open_before = self.scratch.save(now.where("met is not null").unionByName(going), f"line{k}_{step}"), still
            self.scratch.drop(f"line{k}_{step - 1}")
        return now

    def cycles(self) -> DataFrame:
        """(scope, id) on closed chains: what no peeling can remove."""
        return self.rest.select(*KEY)

    def nodes(self) -> DataFrame:
        """(scope, id, up, n_descendants, state) of all nodes; up: ancestors, nearest first, NULL unless state is tree."""
        if self._nodes is None:
            self._nodes = self._walk_down()
        return self._nodes

    def _walk_down(self) -> DataFrame:
        done = self.rest.select(*KEY, F.lit(None).cast("array<string>").alias("up"), F.lit(None).cast("bigint").alias("n_descendants"), F.lit("cycle").alias("state"))
        for k, nodes in reversed(list(enumerate(self.peeled))):
            down = F.transform(F.sort_array(F.collect_list(F.struct(-F.col("height"), "id", "n"))), lambda x: F.struct(x["id"].alias("id"), x["n"].alias("n")))
            lines = nodes.groupBy("scope", "leaf").agg(down.alias("line"), F.max_by("parent", "height").alias("above"))
            known = done.select("scope", F.col("id").alias("above"), "up", "state")
            met = salted_join(lines, known, ["scope", "above"], "left", spread=F.col("leaf"), hot_rows=self.hot_rows)
            own = F.when(F.col("state").isNull(), F.array().cast("array<string>")).when(F.col("state") == "tree", F.concat(F.array("above"), "up"))
            met = met.select("scope", own.alias("over"), F.when(F.col("state").isNull() | (F.col("state") == "tree"), F.lit("tree")).otherwise(F.lit("below_cycle")).alias("state"), F.col("line.id").alias("ids"), F.posexplode("line").alias("at", "x"))
            up = F.concat(F.reverse(F.slice("ids", F.lit(1), F.col("at"))), "over")
            done = done.unionByName(self.scratch.save(met.select("scope", F.col("x.id").alias("id"), up.alias("up"), F.col("x.n").alias("n_descendants"), "state"), f"down{k}"))
        return done


def hierarchy(symbols: DataFrame, built: Hierarchy | None = None) -> DataFrame:
    """(repo_id, symbol_id, path, depth, root_id, n_descendants, state) of each live symbol.

    path holds the symbol ids from the root down, joined by /. state: tree, cycle or below_cycle; path, depth
    and root_id are NULL but for tree, n_descendants is NULL for cycle.
    """
    nodes = (built or Hierarchy(live_links(symbols))).nodes()
    line = F.concat(F.reverse("up"), F.array("id"))
    return nodes.select(
        F.col("scope").alias("repo_id"), F.col("id").alias("symbol_id"), F.array_join(line, "/").alias("path"), F.when(F.col("up").isNotNull(), F.size("up")).cast("bigint").alias("depth"),
        F.when(F.col("up").isNotNull(), F.element_at(line, 1)).alias("root_id"), "n_descendants", "state",
    )


def descendants(symbols: DataFrame, built: Hierarchy | None = None) -> DataFrame:
    """(repo_id, symbol_id, descendant_id, distance): every live symbol with each symbol below it, in long form."""
    nodes = (built or Hierarchy(live_links(symbols))).nodes().where(F.col("up").isNotNull())
    return nodes.select(F.col("scope").alias("repo_id"), F.col("id").alias("descendant_id"), F.posexplode("up").alias("p", "symbol_id")).select("repo_id", "symbol_id", "descendant_id", (F.col("p") + 1).cast("bigint").alias("distance"))


def closed_chains(symbols: DataFrame) -> DataFrame:
    """(repo_id, symbol_id) of live symbols that are their own ancestors: what leaf peeling leaves."""
    return Hierarchy(live_links(symbols)).cycles().select(F.col("scope").alias("repo_id"), F.col("id").alias("symbol_id"))
