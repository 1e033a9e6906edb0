"""Table profiles, order-independent fingerprints, schema and data differences, and the change ledger."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNIT, _NULL = "\x1f", "\x00"
_TWO63, _TWO64 = Decimal(9223372036854775808), Decimal(18446744073709551616)


def profile_exact(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_null, n_distinct) in one pass; n_distinct is NULL for maps and other incomparable types."""
    plain = [f for f in df.schema.fields]
    ok = lambda f: not isinstance(f.dataType, (T.MapType, T.VariantType))
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(plain):
        aggs += [F.count(F.col(f.name)).alias(f"c{i}"), F.countDistinct(F.col(f.name)).alias(f"d{i}") if ok(f) else F.lit(None).cast("bigint").alias(f"d{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"c{i}")).alias("n_null"), F.col(f"d{i}").alias("n_distinct")) for i, f in enumerate(plain)])
    return one.select(F.inline(rows))


def profile_estimated(df: DataFrame, error: float = 0.05) -> DataFrame:
    """(column, n_rows, null_frac, n_distinct, distinct_ratio) with estimated distinct counts."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        aggs += [F.avg(F.col(c).isNull().cast("int")).alias(f"f{i}"), F.approx_count_distinct(c, error).alias(f"d{i}")]
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.round(f"f{i}", 6).alias("null_frac"), F.col(f"d{i}").alias("n_distinct"), F.round(F.try_divide(F.col(f"d{i}"), F.col("n")), 6).alias("distinct_ratio")) for i, c in enumerate(df.columns)])))


def row_text(columns: list[str]) -> Column:
    """A row as text: values as strings, NULL marked, a unit separator between."""
    return F.concat_ws(_UNIT, *[F.coalesce(F.col(c).cast("string"), F.lit(_NULL)) for c in columns])


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n_rows, checksum) of the multiset of rows, in any order; the checksum of no rows is empty.

    The MD5 of each row is cut into two signed 64-bit halves, each summed exactly; the checksum is the MD5 of the sums.
    """
    h = F.md5(row_text(columns))
    half = lambda i: F.conv(F.substring(h, i, 16), 16, 10).cast("decimal(20,0)")
    signed = lambda x: F.when(x >= F.lit(_TWO63), x - F.lit(_TWO64)).otherwise(x).cast("decimal(38,0)")
    sums = df.select(half(1).alias("a"), half(17).alias("b")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(signed(F.col("a"))).alias("a"), F.sum(signed(F.col("b"))).alias("b"))
    return sums.select("n_rows", F.when(F.col("n_rows") > 0, F.md5(F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string")))).otherwise("").alias("checksum"))


def data_diff(left: DataFrame, right: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(columns, left_rows, right_rows, left_checksum, right_checksum, identical) over the common or given columns.

    identical is false if the column sets differ, whatever the rows.
    """
    common = columns or sorted(set(left.columns) & set(right.columns))
    a = fingerprint(left, common).select(F.col("n_rows").alias("left_rows"), F.col("checksum").alias("left_checksum"), F.lit(1).alias("k"))
    b = fingerprint(right, common).select(F.col("n_rows").alias("right_rows"), F.col("checksum").alias("right_checksum"), F.lit(1).alias("k"))
    same = F.lit(set(left.columns) == set(right.columns) or columns is not None)
    return a.join(b, "k").select(F.lit(",".join(common)).alias("columns"), "left_rows", "right_rows", "left_checksum", "right_checksum", (same & (F.col("left_rows") == F.col("right_rows")) & (F.col("left_checksum") == F.col("right_checksum"))).alias("identical"))


def schema_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, name, definition): one row per table and column."""
    spark = next(iter(tables.values())).sparkSession
    rows = [("table", t, "") for t in tables] + [("column", f"{t}.{f.name}", f"{f.dataType.simpleString()}{'' if f.nullable else ' not null'}") for t, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "kind string, name string, definition string")


def snapshot_id(rows: DataFrame) -> DataFrame:
    """(snapshot_id): SHA-256 over the sorted rows of a schema."""
    text = F.concat_ws("|", "kind", "name", "definition")
    return rows.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(text)), "\n"), 256).alias("snapshot_id"))


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(kind, name, change, was, now) of (kind, name, definition): added, removed or changed."""
    x = a.select("kind", "name", F.col("definition").alias("was"), F.lit(1).alias("in_a"))
    y = b.select("kind", "name", F.col("definition").alias("now"), F.lit(1).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return x.join(y, ["kind", "name"], "full_outer").select("kind", "name", change.alias("change"), "was", "now").where("change is not null")


def multiset_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose numbers of rows differ: (keys, in_a, in_b)."""
    x = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("in_a"))
    y = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("in_b"))
    r = x.join(y, keys, "full_outer").select(*keys, F.coalesce("in_a", F.lit(0)).alias("in_a"), F.coalesce("in_b", F.lit(0)).alias("in_b"))
    return r.where("in_a <> in_b")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same key. new has one row per key; NULL keys are never equal."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is greatest by order, then by all other columns."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    x = F.max(F.struct(*order, *rest)).alias("x")
    return df.groupBy(*keys).agg(x).select(*keys, *[F.col(f"x.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def ledger_state(history: DataFrame) -> DataFrame:
    """(environment, version, state): applied if the last applied row of a version goes up, else reverted."""
    done = history.where("status = 'applied' and version is not null").select("environment", "version", "applied_at", "id", "direction", "name", "checksum")
    last = latest(done, ["environment", "version"], ["applied_at", "id"])
    return last.select("environment", "version", "name", "checksum", F.when(F.col("direction") == "up", "applied").otherwise("reverted").alias("state"))


def ledger_status(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """(version, status) of files (version, name, checksum) against a ledger (version, name, checksum, state).

    applied, checksum_mismatch, renamed, out_of_order (older than the newest applied one but pending), pending, missing.
    """
    up = ledger.where("state = 'applied'")
    newest = up.agg(F.max("version")).scalar()
    f = files.select("version", F.col("name").alias("file_name"), F.col("checksum").alias("file_sum"), F.lit(1).alias("f"))
    x = f.join(up.select("version", "name", "checksum", F.lit(1).alias("l")), "version", "full_outer")
    status = (
        F.when(F.col("f").isNull(), "missing").when(F.col("l").isNotNull() & (F.col("file_sum") != F.col("checksum")), "checksum_mismatch").when(F.col("l").isNotNull() & (F.col("file_name") != F.col("name")), "renamed")
        .when(F.col("l").isNotNull(), "applied").when(F.col("version") < newest, "out_of_order").otherwise("pending")
    )
    return x.select("version", status.alias("status"))


def ledger_plan(status: DataFrame, target: str | None = None) -> DataFrame:
    """(version, step, refusal, digest) of ledger_status(): the pending versions up to target in order.

    refusal is the same on all steps: the worst of checksum_mismatch, missing, renamed and out_of_order at or below the
    target, NULL if there is none. digest: SHA-256 over the versions in order, to see that a plan is still the same.
    The ledger of one database is ordered in one task.
    """
    s = status.where(F.col("version") <= target) if target is not None else status
    rank = {"checksum_mismatch": 0, "missing": 1, "renamed": 2, "out_of_order": 3}
    worst = s.where(F.col("status").isin(*rank)).agg(F.min(F.struct(F.coalesce(*[F.when(F.col("status") == k, F.lit(v)) for k, v in rank.items()]).alias("r"), "status")).alias("w"))
    steps = s.where("status in ('pending', 'out_of_order')").select("version")
    whole = steps.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("version")), ","), 256).alias("digest"))
    numbered = steps.withColumn("step", F.row_number().over(Window.orderBy("version")))
    return numbered.join(F.broadcast(worst)).join(F.broadcast(whole)).select("version", "step", F.col("w.status").alias("refusal"), "digest")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
