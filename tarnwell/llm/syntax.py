"""Problem 3: source files that do not parse."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grammars import LANGUAGES, parser

_MARKER = re.compile(r"^(?:<{7}|>{7}|={7}|\|{7})(?=[ \r\n]|\Z)", re.M)
REPORT = "repo_id string, path string, language string, valid boolean, failed_at bigint, failed_line bigint, cause string"


def current_files(files: DataFrame) -> DataFrame:
    """(repo_id, key, language): of each file the row with the latest updated_at, an ISO time with any offset.

    key is the path with / as separator. Replays are equal; of differing rows of one time the greatest language
    wins. Times that cannot be read are earlier than any.
    """
    at = F.coalesce(F.expr("try_to_timestamp(updated_at)"), F.lit("0001-01-01").cast("timestamp"))
    last = F.max(F.struct(at.alias("at"), F.coalesce("language", F.lit("")).alias("language"))).alias("x")
    return files.groupBy("repo_id", F.replace("path", F.lit("\\"), F.lit("/")).alias("key")).agg(last).select("repo_id", "key", F.nullif("x.language", F.lit("")).alias("language"))


#: Bytes of paths and repositories up to which the list of files is broadcast, so that no content has to move.
BROADCAST_BYTES = 32 << 20


#: Bytes a core below which an input is too small for its splits to keep all cores at work.
SMALL_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files are too small to be split over them; larger inputs are read where they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_BYTES else df


def with_language(contents: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, path, content, language): contents with the current language of the file, NULL if it has none."""
    known = current_files(files)
    size = files.agg(F.sum(F.coalesce(F.octet_length("path"), F.lit(0)) + F.coalesce(F.octet_length("repo_id"), F.lit(0)) + 40)).first()[0] or 0
    body = spread(contents.select("repo_id", "path", "content", F.replace("path", F.lit("\\"), F.lit("/")).alias("key")))
    return body.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, ["repo_id", "key"], "left").drop("key")


def judge(text: str, language: str) -> tuple[bool, int | None, int | None, str | None]:
    """(valid, failed_at, failed_line, cause) of a text; language must be in LANGUAGES."""
    at = parser(language).parse(text)
    if at < 0:
        return True, None, None, None
    line = text.count("\n", 0, at) + 1
    begin = text.rfind("\n", 0, at) + 1
    end = text.find("\n", at)
    near = text[max(0, begin - 1) : end if end >= 0 else len(text)]
    if _MARKER.search(near):
        return False, at, line, "conflict"
    for other in LANGUAGES if text.strip() else ():
        if other != language and parser(other).parse(text) < 0:
            return False, at, line, f"written in {other}"
    if not text[at:].strip():
        return False, at, line, "incomplete"
    return False, at, line, "conflict" if _MARKER.search(text) else "unexpected text"


def _report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sys.setrecursionlimit(2**31 - 1)  # rules call each other on the heap, so that only memory bounds the depth of a text
    for b in batches:
        out = [(repo, path, language, *judge(content, language)) for repo, path, content, language in zip(b["repo_id"], b["path"], b["content"], b["language"])]
        yield pd.DataFrame(out, columns=["repo_id", "path", "language", "valid", "failed_at", "failed_line", "cause"]).astype({"valid": object, "failed_at": "Int64", "failed_line": "Int64"})


def _refused(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sys.setrecursionlimit(2**31 - 1)
    for b in batches:
        yield b.loc[[not parser(language).accepts(content) for content, language in zip(b["content"], b["language"])], ["repo_id", "path"]]


def judged(contents: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, path, content, language) of the files in a language that has a grammar."""
    known = with_language(contents, files).where(F.col("language").isin(*LANGUAGES) & F.col("content").isNotNull())
    return known.select("repo_id", "path", "content", "language")


def syntax_report(contents: DataFrame, files: DataFrame) -> DataFrame:
    """One row per file in a language that has a grammar: REPORT.

    Method: a packrat parser of a parsing-expression grammar per language must consume the whole text; failed_at
    is the furthest position at which a terminal failed, cause what stands there. Files whose language is NULL,
    text, markdown or any without a grammar are not judged and give no row; so do NULL contents. Empty files are
    judged like others (valid but for JSON). A repeated row gives a repeated row. Texts are parsed whole.
    """
    return judged(contents, files).mapInPandas(_report, REPORT)


def invalid_files(contents: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, path) of files that do not parse; as syntax_report(), but without looking for the place and cause."""
    return judged(contents, files).mapInPandas(_refused, "repo_id string, path string").distinct()


def invalid_rates(contents: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, language, n_files, n_invalid, n_conflict, n_incomplete, rate) per repository and language."""
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    r = syntax_report(contents, files).groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("n_files"), count(~F.col("valid")).alias("n_invalid"), count(F.col("cause") == "conflict").alias("n_conflict"), count(F.col("cause") == "incomplete").alias("n_incomplete"))
    return r.withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
