"""Source trees: walking, filtering and language detection, and extractors of symbols, sections and literals."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Language by file extension.
EXTENSIONS = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cs": "csharp", "py": "python", "css": "css", "html": "html", "vue": "vue",
    "json": "json", "sql": "sql", "proto": "proto", "md": "markdown", "txt": "text", "yaml": "text", "yml": "text", "toml": "text",
}
#: Fixed value: base names that may hold secrets.
SECRETS = r"(?i)^(\.env(\..*)?|.*\.(pem|key|pfx|p12)|id_(rsa|dsa|ecdsa|ed25519).*|secrets?\.(json|ya?ml)|credentials(\.json)?)$"
#: Fixed value: folders a walk leaves out.
EXCLUDED = r"(^|/)(node_modules|\.git|bin|obj|dist|build|coverage)/"
MAX_BYTES = 1_000_000


def walk(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length, content) of all files below root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length", "content")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(table, extension(path))


def is_binary(content: Column) -> Column:
    """A NUL byte in the first 512."""
    return F.hex(F.substring(content, 1, 512)).rlike("^(..)*00")


def is_secret(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1).rlike(SECRETS)


def skip_reason(path: Column, length: Column) -> Column:
    """Why a walk leaves a file out; NULL if it is kept."""
    return F.when(path.rlike(EXCLUDED), "excluded").when(is_secret(path), "secret").when(length > MAX_BYTES, "too large").when(language(path).isNull(), "unknown language")


def skip_tally(files: DataFrame) -> DataFrame:
    """(reason, ext, n) of (path, length): the skipped files, for a report in order of n."""
    f = files.withColumn("reason", skip_reason(F.col("path"), F.col("length"))).where("reason is not null")
    return f.groupBy("reason", extension(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def markdown_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, level, heading) of the headings outside code fences."""
    bare = F.regexp_replace(F.col(text), r"(?ms)^(```|~~~).*?^\1[ \t]*$", "")
    lines = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(bare, "\r?\n")).alias("position", "l")).where(F.col("l").rlike(r"^#{1,6} "))
    return lines.select(key, "position", F.length(F.regexp_extract("l", r"^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("l", r"^#+ ", "")).alias("heading"))


def code_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, language, n_lines) of fenced code blocks."""
    blocks = F.regexp_extract_all(F.col(text), F.lit(r"(?ms)^```(\w*\n.*?)^```"), F.lit(1))
    b = docs.where(F.col(text).isNotNull()).select(key, F.explode(blocks).alias("b"))
    return b.select(key, F.regexp_extract("b", r"^(\w*)", 1).alias("language"), (F.size(F.split("b", "\n")) - 2).alias("n_lines"))


def _python_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for repo, path, text in zip(b["repo_id"], b["path"], b["content"]):
            try:
                tree = ast.parse((text if isinstance(text, str) else "").lstrip("﻿"))
            except (SyntaxError, ValueError, RecursionError):
                continue
            todo: list[tuple[ast.AST, str | None]] = [(tree, None)]
            while todo:
                node, owner = todo.pop()
                for child in ast.iter_child_nodes(node):
                    name = owner
                    if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                        out.append((repo, path, kind, child.name, owner, child.lineno, child.end_lineno))
                        name = child.name
                    elif isinstance(child, ast.Call):
                        callee = child.func.id if isinstance(child.func, ast.Name) else child.func.attr if isinstance(child.func, ast.Attribute) else None
                        if callee:
                            out.append((repo, path, "CALLS", f"callee:{callee}", owner, child.lineno, None))
                    elif isinstance(child, (ast.Import, ast.ImportFrom)):
                        module = "." * child.level + (f"{child.module}." if child.module else "") if isinstance(child, ast.ImportFrom) else ""
                        out += [(repo, path, "IMPORTS", f"import:{module}{a.name}", owner, child.lineno, None) for a in child.names]
                    todo.append((child, name))
        yield pd.DataFrame(out, columns=["repo_id", "path", "kind", "name", "owner", "line", "end_line"]).astype({"end_line": "Int32"})


def extract_python(contents: DataFrame) -> DataFrame:
    """(repo_id, path, kind, name, owner, line, end_line): declarations, calls and imports of Python files; files that
    don't parse give no rows."""
    return contents.select("repo_id", "path", "content").mapInPandas(_python_rows, "repo_id string, path string, kind string, name string, owner string, line int, end_line int")


def extract_by_pattern(contents: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(repo_id, path, kind, name, n): declarations found by one pattern a kind, its first group the name."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(F.col("content"), F.lit(p), F.lit(1)).alias("names")) for k, p in sorted(patterns.items())])
    x = contents.where("content is not null").select("repo_id", "path", F.inline(kinds)).select("repo_id", "path", "kind", F.explode("names").alias("name"))
    return x.groupBy("repo_id", "path", "kind", "name").agg(F.count(F.lit(1)).alias("n"))


# How SQL, C#, TypeScript, CSS and proto declare things.
DECLARATIONS = {
    "sql_table": r"(?im)^\s*create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.]+)", "sql_view": r"(?im)^\s*create\s+(?:or\s+replace\s+)?view\s+([\w.]+)", "sql_index": r"(?im)^\s*create\s+(?:unique\s+)?index\s+([\w.]+)",
    "class": r"(?m)^\s*(?:export\s+|public\s+|sealed\s+|static\s+|abstract\s+|internal\s+|partial\s+)*class\s+(\w+)", "interface": r"(?m)^\s*(?:export\s+|public\s+)*interface\s+(\w+)", "css_class": r"(?m)^\s*\.([\w-]+)[^{};]*\{", "message": r"(?m)^\s*message\s+(\w+)", "service": r"(?m)^\s*service\s+(\w+)",
}


def literals(contents: DataFrame) -> DataFrame:
    """(repo_id, path, value, n): quoted strings of one line, of any length.

    Possessive, as Java takes a stack frame for every repeat it could go back to; none can begin another match.
    """
    found = F.regexp_extract_all("content", F.lit(r"\"((?:[^\"\\\n]++|\\[^\n])++)\""), F.lit(1))
    return contents.where("content is not null").select("repo_id", "path", F.explode(found).alias("value")).groupBy("repo_id", "path", "value").agg(F.count(F.lit(1)).alias("n"))
