"""Import specifiers in texts and the files they mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .context import shared_depth

# What a relative specifier of JavaScript and TypeScript may leave out, the likeliest first.
ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".json", ".css", "/index.ts", "/index.tsx", "/index.js"]
SCRIPT = r"(?:\bfrom|\bimport|\brequire\()\s*['\"]([^'\"\n]+)['\"]"
PYTHON = r"(?m)^\s*(?:from|import)\s+([\w.]+)"
REMOVED_CONFIDENCE = 0.95


def specifiers(contents: DataFrame) -> DataFrame:
    """(repo_id, path, specifier, python): what the scripts and Python files (repo_id, path, content) import, each once."""
    python = F.col("path").endswith(".py")
    found = F.when(python, F.regexp_extract_all("content", F.lit(PYTHON), F.lit(1))).when(F.col("path").rlike(r"\.(?:ts|tsx|js|jsx|mjs)$"), F.regexp_extract_all("content", F.lit(SCRIPT), F.lit(1)))
    return contents.where("content is not null").select("repo_id", "path", F.explode(F.array_distinct(found)).alias("specifier"), python.alias("python"))


def resolve_specifiers(asked: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(repo_id, path, specifier, target) of specifiers() against files (repo_id, path): what can be told.

    Scripts: a specifier that is relative, or begins with an alias (prefix to folder), with the first of ENDINGS that
    makes it a file. Python: a dotted name (leading dots relative to the file) that ends the path of a module or of a
    package; of several the one that shares most folders with the importer, then the shortest, then by path.
    """
    folder = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    spec = F.col("specifier")
    for prefix, to in sorted((aliases or {}).items(), key=lambda kv: -len(kv[0])):
        spec = F.when(F.col("specifier").startswith(prefix), F.concat(F.lit(to), F.substring("specifier", len(prefix) + 1, 10_000))).otherwise(spec)
    rooted = spec != F.col("specifier")
    ups = F.when(F.col("specifier").startswith("../"), F.size(F.regexp_extract_all("specifier", F.lit(r"\G(\.\./)"), F.lit(1)))).otherwise(0)
    kept = F.array_join(F.slice(folder, 1, F.size(folder) - ups), "/")
    rest = F.regexp_replace(spec, r"^(?:\.{1,2}/)+", "")
    script = asked.where("not python").where(rooted | F.col("specifier").rlike(r"^\.{1,2}/")).where(rooted | (ups <= F.size(folder)))
    full = F.when(rooted, rest).otherwise(F.concat_ws("/", F.nullif(kept, F.lit("")), rest))
    ends = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(e).alias("end")) for i, e in enumerate(ENDINGS)])
    tried = script.select("repo_id", "path", "specifier", full.alias("base"), F.inline(ends)).select("repo_id", "path", "specifier", "rank", F.concat("base", "end").alias("target"))
    known = files.select("repo_id", F.col("path").alias("target")).distinct()
    scripts = tried.join(known, ["repo_id", "target"]).groupBy("repo_id", "path", "specifier").agg(F.min(F.struct("rank", "target")).alias("b"))
    dots = F.length(F.regexp_extract("specifier", r"^(\.*)", 1))
    name = F.regexp_replace("specifier", r"^\.+", "")
    above = F.array_join(F.slice(folder, 1, F.greatest(F.size(folder) - dots + 1, F.lit(0))), ".")
    dotted = F.when(dots > 0, F.concat_ws(".", F.nullif(F.regexp_replace(above, "/", "."), F.lit("")), F.nullif(name, F.lit("")))).otherwise(name)
    wanted = asked.where("python").select("repo_id", "path", "specifier", dotted.alias("module")).where("module <> ''")
    steps = F.split(F.regexp_replace("target", r"(?:/__init__)?\.py$", ""), "/")
    modules = known.where("target like '%.py'").withColumn("steps", steps)
    modules = modules.select("repo_id", "target", F.explode(F.transform(F.sequence(F.lit(1), F.size("steps")), lambda k: F.array_join(F.slice("steps", k, F.size("steps")), "."))).alias("module"))
    met = wanted.join(modules, ["repo_id", "module"]).where("path <> target")
    best = met.groupBy("repo_id", "path", "specifier").agg(F.min(F.struct((-shared_depth(F.col("path"), F.col("target"))).alias("d"), F.length("target").alias("n"), "target")).alias("b"))
    return scripts.select("repo_id", "path", "specifier", F.col("b.target").alias("target")).unionByName(best.select("repo_id", "path", "specifier", F.col("b.target").alias("target")))


def removed_path_impact(asked: DataFrame, files: DataFrame, removed: DataFrame) -> DataFrame:
    """(repo_id, removed, importer, confidence): files whose specifiers would mean a removed path (repo_id, path), were it
    still there, and mean nothing without it."""
    now = resolve_specifiers(asked, files)
    then = resolve_specifiers(asked.join(now, ["repo_id", "path", "specifier"], "left_anti"), files.select("repo_id", "path").unionByName(removed.select("repo_id", "path")))
    met = then.join(removed.select("repo_id", F.col("path").alias("target")), ["repo_id", "target"])
    return met.select("repo_id", F.col("target").alias("removed"), F.col("path").alias("importer"), F.lit(REMOVED_CONFIDENCE).alias("confidence")).distinct()


def imports_cross_repo(edges: DataFrame, symbols: DataFrame, namespaces: list[str]) -> DataFrame:
    """(edge_id, to_repo, symbol_id): import: tokens whose first part is one of the namespaces, or that name a declared symbol
    of no own repository, to the repository with most symbols that has it; ties by repository and id."""
    own = symbols.select("repo_id", "name", "symbol_id")
    size = symbols.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    name = F.regexp_replace("to_id", "^import:", "")
    asked = edges.where(F.col("to_id").startswith("import:")).select("repo_id", "edge_id", name.alias("full"), F.substring_index(name, ".", -1).alias("name"))
    asked = asked.where(F.substring_index("full", ".", 1).isin(*namespaces) | ~F.col("full").contains(".")).join(own.select("repo_id", "name").distinct(), ["repo_id", "name"], "left_anti")
    best = own.join(size, "repo_id").groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("n"), "repo_id", "symbol_id")).alias("b"))
    return asked.join(best, "name").where(F.col("b.repo_id") != F.col("repo_id")).select("edge_id", F.col("b.repo_id").alias("to_repo"), F.col("b.symbol_id").alias("symbol_id"))
