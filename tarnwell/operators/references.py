"""Problem 4: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .skew import HOT_ROWS, hot_keys, salted_join

#: Stands for a time that is not known; earlier than any real one.
LONG_AGO = "0001-01-01 00:00:00"
#: Scope of references that may be met by any repository.
ANYWHERE = "*"


def _own(repo) -> F.Column:
    return F.coalesce(F.concat(F.lit("r:"), repo), F.lit("null"))


def current_symbols(symbols: DataFrame) -> DataFrame:
    """(repo_id, symbol_id, live, parent_symbol_id, first_at): the current row of every symbol.

    The current row has the latest recorded_at; a NULL recorded_at is earlier than any. Rows of equal time are
    identical in sound data; if they differ, a live one wins and then the greatest parent. Rows without
    symbol_id or repo_id name nothing and are left out.
    """
    at = F.coalesce(F.col("recorded_at"), F.lit(LONG_AGO).cast("timestamp"))
    row = F.struct(at.alias("at"), F.col("deleted_at").isNull().alias("live"), F.col("parent_symbol_id").alias("parent"))
    return (
        symbols.where(F.col("symbol_id").isNotNull() & F.col("repo_id").isNotNull())
        .groupBy("repo_id", "symbol_id")
        .agg(F.max(row).alias("cur"), F.min(at).alias("first_at"))
        .select("repo_id", "symbol_id", F.col("cur.live").alias("live"), F.col("cur.parent").alias("parent_symbol_id"), "first_at")
    )


def claims(edges: DataFrame) -> DataFrame:
    """Edges that claim a symbol, with the scope in which it must be: edges' columns, scope."""
    anywhere = F.coalesce(F.col("reason").contains("cross-repo"), F.lit(False))
    return edges.where(F.col("to_id").isNotNull() & ~F.col("to_id").contains(":")).withColumn("scope", F.when(anywhere, F.lit(ANYWHERE)).otherwise(_own(F.col("repo_id"))))


def reference_states(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(scope, to_id, n, seen, live, first_at) of every key that is claimed and is an orphan or was claimed early.

    Parent and child keys are put together in long form, tagged, and grouped by scope and key; children are
    counted within each input split first, so a hot key sends one row a split. Parents appear under their own
    repository and under ANYWHERE. Groups without a live parent are orphans; groups whose parent came after the
    first claim are kept, too, as some of their rows came early.
    """
    at = F.coalesce(F.col("recorded_at"), F.lit(LONG_AGO).cast("timestamp"))
    children = claims(edges).groupBy("scope", "to_id").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("claimed_at"))
    children = children.select("scope", "to_id", "n", "claimed_at", F.lit(0).alias("seen"), F.lit(0).alias("live"), F.lit(None).cast("timestamp").alias("first_at"))
    parents = current_symbols(symbols).select(
        F.explode(F.array(_own(F.col("repo_id")), F.lit(ANYWHERE))).alias("scope"),
        F.col("symbol_id").alias("to_id"),
        F.lit(0).cast("bigint").alias("n"),
        F.lit(None).cast("timestamp").alias("claimed_at"),
        F.lit(1).alias("seen"),
        F.col("live").cast("int").alias("live"),
        F.when(F.col("live"), F.col("first_at")).alias("first_at"),
    )
    grouped = (
        children.unionByName(parents)
        .groupBy("scope", "to_id")
        .agg(F.sum("n").alias("n"), F.min("claimed_at").alias("claimed_at"), F.max("seen").alias("seen"), F.max("live").alias("live"), F.min("first_at").alias("first_at"))
    )
    return grouped.where((F.col("n") > 0) & ((F.col("live") == 0) | (F.col("claimed_at") < F.col("first_at")))).drop("claimed_at")


def classify_references(edges: DataFrame, symbols: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(edge_id, recorded_at, target_state) of every edge row whose claim is not plainly met.

    target_state: never_seen (the scope has no row of the symbol), deleted (it has, but none that is live), late
    (it is live but was first recorded after the edge; such a claim is met in the end). Duplicates count each.
    A NULL to_id or one with a colon claims nothing. A NULL repo_id is a repository without symbols. A NULL
    recorded_at is earlier than any. Keys that hold many rows are split by a salt in the join back to the rows.
    """
    scratch = Scratch(edges.sparkSession, "references")
    states = scratch.save(reference_states(edges, symbols), "states")
    at = F.coalesce(F.col("recorded_at"), F.lit(LONG_AGO).cast("timestamp"))
    rows = claims(edges).select("edge_id", "recorded_at", "scope", "to_id")
    hot = hot_keys(states, ["scope", "to_id"], hot_rows=hot_rows)
    joined = salted_join(rows, states.drop("n"), ["scope", "to_id"], "inner", hot=hot, spread=F.col("edge_id"))
    state = F.when(F.col("seen") == 0, F.lit("never_seen")).when(F.col("live") == 0, F.lit("deleted")).when(at < F.col("first_at"), F.lit("late"))
    return joined.select("edge_id", "recorded_at", state.alias("target_state")).where(F.col("target_state").isNotNull())


def orphan_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edge_id of the edges whose target does not exist as live in its scope."""
    return classify_references(edges, symbols).where(F.col("target_state") != "late").select("edge_id")


def orphans_by_period(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(child_table, parent_table, period, never_seen, deleted, late): counts of rows per month of recorded_at."""
    found = classify_references(edges, symbols)
    count = lambda s: F.sum((F.col("target_state") == s).cast("bigint")).alias(s)
    return found.groupBy(F.lit("edges").alias("child_table"), F.lit("symbols").alias("parent_table"), F.date_format("recorded_at", "yyyy-MM").alias("period")).agg(count("never_seen"), count("deleted"), count("late"))
