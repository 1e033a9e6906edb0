"""Log and trace analytics over (at, severity, service, app, context, body) and span rows."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import instant, relative_time

#: Longest window that may be asked for, and the one used if none is given.
MAX_WINDOW, DEFAULT_WINDOW = timedelta(days=7), timedelta(hours=1)


def window(now: datetime, time: str | None = None, start: str | None = None, end: str | None = None, longest: timedelta = MAX_WINDOW) -> tuple[datetime, datetime]:
    """[start, end) of a request; start and end override time. ValueError if it is empty or too long."""
    if start or end:
        b = instant(end) if end else now
        a = instant(start) if start else b - DEFAULT_WINDOW
    else:
        a, b = now - (relative_time(time) if time else DEFAULT_WINDOW), now
    if b <= a or b - a > longest:
        raise ValueError("the window is empty or too long")
    return a, b


def in_window(df: DataFrame, at: str, a: datetime, b: datetime) -> DataFrame:
    naive = dict(df.dtypes)[at] == "timestamp_ntz"
    lit = lambda t: F.lit(t.astimezone(timezone.utc).replace(tzinfo=None) if naive else t)
    return df.where((F.col(at) >= lit(a)) & (F.col(at) < lit(b)))


def pick(df: DataFrame, *names: str) -> Column:
    """The first of the given columns, as far as they exist, that is neither NULL nor empty."""
    have = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def project(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """The named columns that exist; all without names or if none exists."""
    have = [c for c in columns or [] if c in df.columns]
    return df.select(*have) if have else df


def service(df: DataFrame, sentinel: str) -> Column:
    """service_name unless it is the sentinel, else the app's name if there is one, else service_name."""
    own = F.nullif(F.col("service_name"), F.lit(sentinel))
    return F.coalesce(own, pick(df, "app"), F.col("service_name"))


def level(df: DataFrame, prefix: str) -> DataFrame:
    """Rows whose severity begins so, without case; wildcards in the prefix are dropped."""
    return df.where(F.upper("severity").startswith(prefix.replace("%", "").replace("_", "").upper()))


def clamp(asked: int | None, default: int = 100, most: int = 1000) -> int:
    return default if asked is None else max(1, min(most, int(asked)))


def stats(df: DataFrame, by: str | Column, most: int | None = None) -> DataFrame:
    """Counts, largest first, ties by key; the top-k of a report."""
    r = df.groupBy((F.col(by) if isinstance(by, str) else by).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return r.orderBy(F.desc("n"), F.asc_nulls_first("key")).limit(clamp(most))


def service_inventory(df: DataFrame, name: Column) -> DataFrame:
    """(service, n, first_at, last_at, errors, warnings, contexts, by_resource, by_enricher)."""
    starts = lambda p: F.coalesce(F.upper("severity").startswith(p), F.lit(False)).cast("bigint")
    return df.groupBy(name.alias("service")).agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.sum(starts("ERR")).alias("errors"), F.sum(starts("WARN")).alias("warnings"),
        F.countDistinct("context").alias("contexts"), F.count("service_name").alias("by_resource"), F.count("app").alias("by_enricher"),
    )


def identity_source(by_resource: Column, by_enricher: Column) -> Column:
    return F.when((by_resource > 0) & (by_enricher > 0), "mixed").when(by_resource > 0, "resource").when(by_enricher > 0, "enricher")


def trace_inventory(spans: DataFrame) -> DataFrame:
    return spans.groupBy("service").agg(F.count(F.lit(1)).alias("spans"), F.min("start_at").alias("first_at"), F.max("start_at").alias("last_at"))


def contexts(df: DataFrame, with_service: bool = False) -> DataFrame:
    keys = (["service"] if with_service else []) + ["context"]
    return df.where(F.col("context").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def namespace_rollup(counts: DataFrame, framework: list[str], parts: int = 2) -> DataFrame:
    """(root, n): counts (context, n) by their first segments, framework contexts dropped."""
    own = counts.where(~F.greatest(F.lit(False), *[F.col("context").startswith(p) for p in framework]))
    return own.groupBy(F.substring_index("context", ".", parts).alias("root")).agg(F.sum("n").alias("n"))


def lanes(logs: DataFrame, traces: DataFrame) -> DataFrame:
    """(service, lanes): in which of the two a service appears."""
    a = logs.select("service").distinct().withColumn("l", F.lit("logs"))
    b = traces.select("service").distinct().withColumn("t", F.lit("traces"))
    return a.join(b, "service", "full_outer").select("service", F.concat_ws(",", "l", "t").alias("lanes"))


def field_census(df: DataFrame, json: str) -> DataFrame:
    """(field, types, non_null) of the top-level members of JSON objects: sorted type names, count of values."""
    pairs = df.select(F.explode(F.from_json(json, "map<string,string>")).alias("field", "v"), F.col(json).alias("j"))
    raw = F.expr("get_json_object(j, concat(\"$['\", field, \"']\"))")
    kind = F.when(F.col("v").isNull(), "null").when(raw.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$") & ~F.col("j").contains(F.concat(F.lit('"'), raw, F.lit('"'))), "number").when(raw.isin("true", "false"), "boolean").when(raw.startswith("{"), "object").when(raw.startswith("["), "array").otherwise("string")
    return pairs.withColumn("kind", kind).groupBy("field").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("types"), F.sum(F.col("v").isNotNull().cast("bigint")).alias("non_null"))


def shape(df: DataFrame, message_chars: int, exception_chars: int) -> DataFrame:
    """message dropped if the kept exception contains it, both cut with a note of what is missing; 0 drops."""
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…[+"), (F.length(c) - n).cast("string"), F.lit(" chars]"))).otherwise(c)
    exception = cut(F.col("exception"), exception_chars) if exception_chars else F.lit(None).cast("string")
    r = df.withColumn("kept", exception)
    return r.withColumn("message", F.when(F.instr(F.coalesce("kept", F.lit("")), F.col("message")) > 0, None).otherwise(cut(F.col("message"), message_chars))).withColumn("exception", F.col("kept")).drop("kept")


def trace(df: DataFrame, trace_id: str, order: str) -> DataFrame:
    """The rows of one trace, oldest first; trace_id or traceid, whichever is there."""
    return df.where(pick(df, "trace_id", "traceid") == trace_id).orderBy(order)


def tail(df: DataFrame, now: datetime, minutes: int = 15, most: int = 100) -> DataFrame:
    """The newest rows of the last minutes, newest first, ties by id."""
    return in_window(df, "at", now - timedelta(minutes=minutes), now).orderBy(F.desc("at"), F.desc("id")).limit(most)


def catalog(inventories: DataFrame) -> DataFrame:
    """(service, lanes, environments, contexts, n) of (service, lane, environment, context, n), sets sorted.

    A service without contexts of its own borrows those of others that begin with its name and a dot.
    """
    sets = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",").alias(c + "s")
    own = inventories.groupBy("service").agg(sets("lane"), sets("environment"), F.sort_array(F.collect_set("context")).alias("own"), F.sum("n").alias("n"))
    lent = inventories.where("context is not null").select(F.substring_index("context", ".", 1).alias("service"), F.col("context").alias("c")).distinct().groupBy("service").agg(F.sort_array(F.collect_set("c")).alias("lent"))
    r = own.join(lent, "service", "left")
    return r.select("service", "lanes", "environments", F.array_join(F.when(F.size("own") > 0, F.col("own")).otherwise(F.coalesce("lent", F.array().cast("array<string>"))), ",").alias("contexts"), "n")
