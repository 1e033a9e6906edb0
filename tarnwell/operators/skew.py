"""Joins of many rows with one row per key, when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is spread over several tasks.
HOT_ROWS = 200_000
#: At most this many keys can be hot, as each has at least 1/MAX_HOT of the rows; their list may be broadcast.
MAX_HOT = 10_000


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Of counts (one row per key, n rows each) the keys to split: (keys, parts). Never more than MAX_HOT rows.

    The bound holds as a hot key has more than sum(n)/MAX_HOT rows.
    """
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).scalar()
    return counts.where((F.col(n) > hot_rows) & (F.col(n) * MAX_HOT > total)).select(
        *keys, F.ceil(F.col(n) / hot_rows).cast("int").alias("parts")
    )


def salted_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None, spread: Column | None = None, hot_rows: int = HOT_ROWS, hint: str | None = None
) -> DataFrame:
    """rows join lookup on keys (lookup has one row per key); rows of a hot key are split by a salt.

    hot: (keys, parts) from hot_keys(), else counted here. spread: what the salt is drawn from, by default
    all columns of rows. hint: how lookup is to be joined. Only how = inner, left, left_semi and left_anti are meaningful. NULL keys match nothing.
    """
    if hot is None:
        hot = hot_keys(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, hot_rows=hot_rows)
    hot = F.broadcast(hot)
    salted = rows.join(hot, keys, "left").withColumn(
        "__salt", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(spread if spread is not None else F.struct(*rows.columns)), F.col("parts"))).otherwise(F.lit(0)).cast("int")
    )
    copies = lookup.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
    copies = copies.drop("parts")
    return salted.drop("parts").join(copies.hint(hint) if hint else copies, [*keys, "__salt"], how).drop("__salt")
