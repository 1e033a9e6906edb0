"""Current rows of the code index, which most queries start from, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import norm_path
from ..sources.tables import table

_SYMBOL = ["file_path", "name", "kind", "line", "end_line", "signature", "parent_symbol_id"]


def symbols(s: SparkSession, d: str) -> DataFrame:
    """Live symbols: repo_id, symbol_id, file_path with / as separator, name, kind, line, end_line, signature, parent_symbol_id."""
    row = F.struct("recorded_at", F.col("deleted_at").isNull().alias("live"), *_SYMBOL)
    cur = table(s, d, "symbols").groupBy("repo_id", "symbol_id").agg(F.max(row).alias("x")).where("x.live")
    return cur.select("repo_id", "symbol_id", norm_path(F.col("x.file_path")).alias("file_path"), *[f"x.{c}" for c in _SYMBOL[1:]])


def edges(s: SparkSession, d: str) -> DataFrame:
    """edges; edge_id is the insertion order."""
    return table(s, d, "edges").select("edge_id", "repo_id", "from_id", "to_id", "type", "confidence", "reason", "assigned_expression")


def files(s: SparkSession, d: str) -> DataFrame:
    """Current files: repo_id, path with / as separator, content_hash, language, updated_at (UTC)."""
    at = F.expr("try_to_timestamp(updated_at)").alias("at")
    row = F.max(F.struct(at, "content_hash", F.coalesce("language", F.lit("")).alias("language"))).alias("x")
    return table(s, d, "files").groupBy("repo_id", norm_path(F.col("path")).alias("path")).agg(row).select("repo_id", "path", "x.content_hash", F.nullif("x.language", F.lit("")).alias("language"), F.col("x.at").alias("updated_at"))


SYM = """sym as (
    select repo_id, symbol_id, replace(file_path, '\\', '/') as file_path, name, kind, line, end_line, signature, parent_symbol_id from symbols
    qualify row_number() over (partition by repo_id, symbol_id order by recorded_at desc, (deleted_at is null) desc) = 1 and deleted_at is null)"""
FIL = """fil as (
    select repo_id, replace(path, '\\', '/') as path, content_hash, language, cast(updated_at as timestamptz) as updated_at from files
    qualify row_number() over (partition by repo_id, replace(path, '\\', '/') order by cast(updated_at as timestamptz) desc, content_hash desc, coalesce(language, '') desc) = 1)"""


def test_sql(p: str) -> str:
    """SQL for a path of a test file, of a path with / as separator."""
    steps, name = f"string_split(lower({p}), '/')", f"string_split(lower({p}), '/')[-1]"
    parts = f"string_split({name}, '.')"
    return (
        f"(list_has_any({steps}[:-2], ['test', 'tests', '__tests__']) or (len({parts}) > 2 and {parts}[-2] in ('test', 'spec'))"
        f" or (starts_with({name}, 'test_') and ends_with({name}, '.py')) or ends_with({name}, '_test.py') or ends_with({name}, 'tests.cs'))"
    )
