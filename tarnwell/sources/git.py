"""Output of git as tables: changes of a work tree and lines by author."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Letters of a change in porcelain output.
CHANGES = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "added", "T": "modified", "U": "conflict", "?": "untracked"}


def _change(letter):
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CHANGES.items() for x in kv]), letter)


def porcelain(outputs: DataFrame) -> DataFrame:
    """(repo_id, path, old_path, change) of (repo_id, output), output of git status --porcelain=v2.

    Ordinary, renamed, unmerged and untracked entries; the change in the index counts before that in the work tree.
    Paths may hold blanks; headers and ignored files give no rows.
    """
    line = outputs.where("output is not null").select("repo_id", F.explode(F.split("output", "\n")).alias("l"))
    kind, xy = F.substring("l", 1, 1), F.split_part("l", F.lit(" "), F.lit(2))
    letter = F.when(F.substring(xy, 1, 1) != ".", F.substring(xy, 1, 1)).otherwise(F.substring(xy, 2, 1))
    fields = F.when(kind == "1", 8).when(kind == "2", 9).when(kind == "u", 10).when(kind == "?", 1)  # before the path
    rest = F.array_join(F.slice(F.split("l", " "), fields + 1, F.size(F.split("l", " "))), " ")
    change = F.when(kind == "?", "untracked").when(kind == "u", "conflict").otherwise(_change(letter))
    old = F.when(kind == "2", F.nullif(F.split_part(rest, F.lit("\t"), F.lit(2)), F.lit("")))
    return line.where(kind.isin("1", "2", "u", "?")).select("repo_id", F.split_part(rest, F.lit("\t"), F.lit(1)).alias("path"), old.alias("old_path"), change.alias("change"))


def name_status(outputs: DataFrame) -> DataFrame:
    """(repo_id, path, old_path, change) of (repo_id, output), output of git diff --name-status; renames stay one row."""
    line = outputs.where("output is not null").select("repo_id", F.explode(F.split("output", "\n")).alias("l"))
    line = line.select("repo_id", F.split("l", "\t").alias("f")).where(F.size("f") > 1)
    two = F.size("f") > 2
    return line.select("repo_id", F.element_at("f", -1).alias("path"), F.when(two, F.col("f")[1]).alias("old_path"), _change(F.substring(F.col("f")[0], 1, 1)).alias("change"))


def blame(outputs: DataFrame) -> DataFrame:
    """(repo_id, path, author, commit, n_lines, first_line) of (repo_id, path, output), output of git blame --porcelain.

    Of a commit only its first group names the author; the others take it from there.
    """
    line = outputs.where("output is not null").select("repo_id", "path", F.posexplode(F.split("output", "\n")).alias("at", "l"))
    head = F.regexp_extract("l", r"^([0-9a-f]{40}) \d+ (\d+)", 1)
    marked = line.withColumn("commit", F.last(F.nullif(head, F.lit("")), True).over(Window.partitionBy("repo_id", "path").orderBy("at")))
    number = F.regexp_extract("l", r"^[0-9a-f]{40} \d+ (\d+)", 1)
    author = F.max(F.when(F.col("l").startswith("author "), F.substring("l", 8, 1000)))
    one = marked.where("commit is not null").groupBy("repo_id", "path", "commit").agg(author.alias("author"), F.count_if(number != "").alias("n_lines"), F.min(F.expr("try_cast(regexp_extract(l, '^[0-9a-f]{40} [0-9]+ ([0-9]+)', 1) as bigint)")).alias("first_line"))
    return one.select("repo_id", "path", "author", "commit", "n_lines", "first_line")
