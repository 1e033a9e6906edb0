"""Sections, terms and statements within texts, and the names they bind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How sure a name without a schema is, bound to the only schema that has it, and a full one.
ONLY_SCHEMA, FULL_NAME = 0.5, 0.6


def sections_mentioning(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, heading, target, n) of (doc_id, text): what matches in a section, that is below a heading up to the next
    one; heading is NULL before the first. Whole texts; headings within code fences are taken as such, too."""
    line = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("at", "l"))
    head = F.nullif(F.regexp_extract("l", r"^#{1,6} +(.*)$", 1), F.lit(""))
    line = line.withColumn("heading", F.last(head, True).over(Window.partitionBy("doc_id").orderBy("at")))
    found = line.select("doc_id", "heading", F.explode(F.regexp_extract_all("l", F.lit(pattern), F.lit(0))).alias("target"))
    return found.groupBy("doc_id", "heading", "target").agg(F.count(F.lit(1)).alias("n"))


def terms_defined(docs: DataFrame) -> DataFrame:
    """(term, n_docs, first_doc): terms that a line defines as **term** – text, over whole texts."""
    t = docs.where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\*\*([^*\n]+)\*\* +[–-] +\S"), F.lit(1))).alias("term"))
    return t.groupBy("term").agg(F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def inserted_values(scripts: DataFrame) -> DataFrame:
    """(repo_id, path, target, column, value, n) of (repo_id, path, content): the columns of INSERT statements with the values of
    their first row, paired by position; pairs where one side is shorter are left out."""
    pattern = r"(?i)insert into (\w+) \(([^()]*)\)\s*values \(([^()]*)\)"
    one = scripts.where("content is not null").select("repo_id", "path", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("s"))
    part = lambda k: F.regexp_extract("s", pattern, k)
    cols = one.select("repo_id", "path", part(1).alias("target"), F.arrays_zip(F.split(part(2), r",\s*").alias("c"), F.split(part(3), r",\s*").alias("v")).alias("z"))
    pair = cols.select("repo_id", "path", "target", F.explode("z").alias("x")).where("x.c is not null and x.v is not null")
    return pair.groupBy("repo_id", "path", "target", F.col("x.c").alias("column"), F.col("x.v").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def bind_sql_names(names: DataFrame, definitions: DataFrame) -> DataFrame:
    """(name, schema, state, confidence) of names (name, schema or NULL) against definitions (schema, name, state), one row a
    definition, state current or dropped.

    A full name is bound to its current definition; one without a schema to the only schema that has it, and is ambiguous
    if several have; a name whose definitions are all dropped is dropped, one without any is unknown.
    """
    asked = names.select("name", F.col("schema").alias("asked")).distinct()
    d = definitions.select("name", "schema", (F.col("state") == "current").alias("live"))
    met = asked.join(d, "name", "left").where("asked is null or schema is null or asked = schema")
    n = met.groupBy("name", "asked").agg(F.count_if(F.col("live")).alias("n"), F.count("schema").alias("all"), F.min(F.when(F.col("live"), F.col("schema"))).alias("only"))
    r = asked.alias("l").join(n.alias("n"), (F.col("l.name") == F.col("n.name")) & F.col("l.asked").eqNullSafe(F.col("n.asked")), "left")
    live, seen = F.coalesce("n.n", F.lit(0)), F.coalesce("n.all", F.lit(0))
    state = F.when(live == 1, "bound").when(live > 1, "ambiguous").when(seen > 0, "dropped").otherwise("unknown")
    conf = F.when(live == 1, F.when(F.col("l.asked").isNull(), ONLY_SCHEMA).otherwise(FULL_NAME))
    return r.select("l.name", F.when(live == 1, F.col("n.only")).otherwise(F.col("l.asked")).alias("schema"), state.alias("state"), conf.alias("confidence"))


def endpoint_dependants(edges: DataFrame, handlers: DataFrame) -> DataFrame:
    """(repo_id, symbol_id, route_id, n): who calls the handler of a route (repo_id, route_id, handler_id)."""
    h = handlers.select("repo_id", "route_id", F.col("handler_id").alias("to_id"))
    return edges.where("type = 'CALLS'").join(h, ["repo_id", "to_id"]).groupBy("repo_id", F.col("from_id").alias("symbol_id"), "route_id").agg(F.count(F.lit(1)).alias("n"))


def endpoint_contracts(symbols: DataFrame, handlers: DataFrame) -> DataFrame:
    """(repo_id, route_id, symbol_id): symbols that stand for a handler: itself, and those declared at its file and line."""
    y = symbols.select("repo_id", "symbol_id", "file_path", "line")
    at = handlers.join(y.withColumnRenamed("symbol_id", "handler_id"), ["repo_id", "handler_id"]).select("repo_id", "route_id", "file_path", "line")
    return at.join(y, ["repo_id", "file_path", "line"]).select("repo_id", "route_id", "symbol_id").distinct()
