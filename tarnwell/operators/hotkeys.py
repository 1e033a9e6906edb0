"""Problem 1: per-key totals and distinct counts when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 16


def tree_aggregate(df: DataFrame, keys: list[str], distinct: dict[str, str], rows: str = "n_rows", fan_in: int = FAN_IN) -> DataFrame:
    """For each key its number of rows and, for each (name, column) of distinct, of distinct non-NULL values.

    Multi-level tree aggregation. Leaves: every input split (of spark.sql.files.maxPartitionBytes) combines its
    rows by (key, column, value) before anything moves, and what is left is spread by that whole triple, so a
    hot key is shared by all tasks and equal values meet once. From there all states are plain sums: each task
    folds its part of a key into one state, and the states climb a tree in which a node takes those of fan_in
    tasks, ceil(log_fan_in(tasks)) rounds in all. No reducer ever gets more than fan_in states of one key. Without
    distinct counts nothing but the keys moves: the leaves are the splits' own sums, spread over as many nodes as tasks.

    Defined cases: NULL is a key like any other; NULL values count as rows but not as distinct values; repeated
    rows count each; an empty table gives no rows; other columns are ignored.
    """
    names = list(distinct)
    k = [f"k{i}" for i in range(len(keys))]
    renamed = [F.col(key).alias(f"k{i}") for i, key in enumerate(keys)]
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if names:
        values = F.array(*[F.struct(F.lit(i).alias("m"), F.col(distinct[name]).cast("string").alias("v")) for i, name in enumerate(names)])
        leaves = df.select(*renamed, F.explode(values).alias("x")).select(*k, "x.m", "x.v").groupBy(*k, "m", "v").agg(F.count(F.lit(1)).alias("n"))
        states = leaves.select(
            *k,
            F.spark_partition_id().alias("node"),  # any numbering gives the same sums
            F.when(F.col("m") == 0, F.col("n")).otherwise(F.lit(0)).alias("r"),
            *[F.when((F.col("m") == i) & F.col("v").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias(f"d{i}") for i in range(len(names))],
        )
    else:
        states = df.select(*renamed, F.pmod(F.spark_partition_id(), F.lit(width)).alias("node")).groupBy(*k, "node").agg(F.count(F.lit(1)).alias("r"))
    sums = [F.sum("r").alias("r"), *[F.sum(f"d{i}").alias(f"d{i}") for i in range(len(names))]]
    while width > fan_in:
        width = -(-width // fan_in)
        states = states.groupBy(*k, F.floor(F.col("node") / fan_in).cast("int").alias("node")).agg(*sums)
    states = states.groupBy(*k).agg(*sums)
    return states.select(*[F.col(f"k{i}").alias(key) for i, key in enumerate(keys)], F.col("r").alias(rows), *[F.col(f"d{i}").alias(name) for i, name in enumerate(names)])


def hot_key_profile(edges: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(to_id, type, n_rows, n_repos, n_from) of edges."""
    return tree_aggregate(edges, ["to_id", "type"], {"n_from": "from_id", "n_repos": "repo_id"}, fan_in=fan_in).select("to_id", "type", "n_rows", "n_repos", "n_from")


def heavy_keys(edges: DataFrame, share: float = 0.01, fan_in: int = FAN_IN) -> DataFrame:
    """(to_id, type, n_rows) of the keys that hold at least that share of all rows, by tree_aggregate()."""
    total = edges.agg(F.count(F.lit(1))).scalar()
    return tree_aggregate(edges, ["to_id", "type"], {}, fan_in=fan_in).where(F.col("n_rows") >= F.lit(share) * total)
