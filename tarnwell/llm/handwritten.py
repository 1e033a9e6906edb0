"""Problem 6: generated, minified, vendored and blob files among source files."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..session import Scratch
from .syntax import with_language

LABELS = ["handwritten", "generated", "minified", "vendored", "blob"]
#: Log-odds with which a file, and a directory, is hand-written before anything is known of it or what is around it.
FILE_PRIOR, DIR_PRIOR = 1.2, 2.0
#: Characters from which equal bodies fully tell a copy, and the form of a text fully tells what it is; less says less.
BODY_CHARS, FORM_CHARS = 200, 120

#: What the label of a directory says of a file in it, and of a directory in it: P(row label of the child | label of the directory).
FILE_GIVEN_DIR = {
    "handwritten": [0.90, 0.03, 0.02, 0.03, 0.02],
    "generated": [0.05, 0.89, 0.02, 0.02, 0.02],
    "minified": [0.10, 0.03, 0.82, 0.03, 0.02],
    "vendored": [0.05, 0.02, 0.06, 0.85, 0.02],
    "blob": [0.20, 0.03, 0.02, 0.02, 0.73],
}
DIR_GIVEN_DIR = {
    "handwritten": [0.84, 0.04, 0.04, 0.04, 0.04],
    "generated": [0.25, 0.66, 0.03, 0.03, 0.03],
    "minified": [0.25, 0.03, 0.66, 0.03, 0.03],
    "vendored": [0.08, 0.02, 0.02, 0.86, 0.02],
    "blob": [0.30, 0.03, 0.03, 0.03, 0.61],
}

# Directory names that by common usage hold one kind of file, as log-odds against hand-written.
DIR_NAMES = {
    "vendored": {"node_modules": 8, "vendor": 8, "_vendor": 8, "third_party": 8, "third-party": 8, "thirdparty": 8, "3rdparty": 8, "external": 7, "externals": 7, "bower_components": 8, "site-packages": 8, "pods": 4},
    "generated": {"gen": 7, "generated": 8, "__generated__": 8, "autogen": 7, "obj": 7, "__snapshots__": 4},
    "minified": {"dist": 5},
}
# File names that tools give to their output.
_GENERATED_NAME = re.compile(r"(?:\.(?:g|gen|generated|designer|pb|g\.i)\.\w+|_pb2(?:_grpc)?\.pyi?|_pb\.(?:js|ts)|\.pb\.(?:go|cc|h|js|ts)|_gen\.\w+|_generated\.\w+)$", re.I)
_MINIFIED_NAME = re.compile(r"(?:[.-]min\.(?:js|css|mjs)|\.bundle\.(?:js|css|mjs)|\.chunk\.(?:js|css)|-[0-9a-f]{8,}\.(?:js|css|mjs))$", re.I)
_LOCK_NAME = re.compile(r"(?:^|/)(?:[\w.-]*[-.]lock\.(?:json|ya?ml|toml)|[\w.-]*\.resolved\.json|package-lock\.json|yarn\.lock|poetry\.lock|cargo\.lock|composer\.lock|gemfile\.lock|npm-shrinkwrap\.json)$", re.I)
_VERSION_NAME = re.compile(r"-v?\d+\.\d+\.\d+(?:[-.]\w+)?\.\w+$")

# The ways in which tools mark their output, and in which people write of such marks.
_GENERATED_HEAD = re.compile(
    r"""<auto-?generated|@generated\b|\bcode\ generated\ by\b|\bauto-?generated\ (?:from|by|file|code|with)\b|\bthis\ (?:file|code|class|module)\ (?:is|was|has\ been)\ (?:auto\S*\ )?(?:written|generated|produced|created|emitted)\b
    |\bgenerated\ (?:on|at)\ \d{4}|\bgenerated\ (?:by|from|with)\b|\boutput\ of\ \S+|\bdo\ not\ (?:edit|modify|change)\b.{0,40}\bby\ hand\b|\bdo\ not\ edit\b|\bdo\ not\ change\b|\bsinh\ tự\ động\b|\bautomatisch\ (?:erzeugt|generiert)\b|\bgénéré\ automatiquement\b|\bchanges\ will\ be\ (?:lost|overwritten)\b""",
    re.X | re.I,
)
_TALKS_OF = re.compile(r"\bwas\ once\b|\bonce\ (?:auto|gen)|\bformerly\b|\bno\ longer\b|\breplaces?\ the\b|\bhand-?(?:tuned|written|edited)\b|\bmaintained\ by\b|\b(?:writes|emits|adds|prints|checks|parses|reads|detects|strips)\b|\bevery\ file\ it\b|\beach\ file\ it\b".replace("\\ ", " "), re.I)
_LIBRARY_HEAD = re.compile(
    r"""^[\s*/#!-]*[\w.@/-]+\ v?\d+\.\d+(?:\.\d+)?\S*(?:\s*$|.{0,40}(?:\(c\)|©|copyright|upstream|licen[cs]e|authors|contributors))|\bcopyright\b.{0,30}\bcontributors\b|\bupstream\ release\b|\bfree\ to\ copy\ under\b|\b(?:MIT|BSD|Apache)\b.{0,20}\blicen[cs]ed?\b""",
    re.X | re.I | re.M,
)
_OWN_HEAD = re.compile(r"\binternal use only\b|\bthe [\w-]+ team\b", re.I)
_COMMENTS = re.compile(r"\A﻿?(?:\s+|#![^\n]*|//[^\n]*|#(?![\w-]+\s*\{)[^\n]*|--[^\n]*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->)+")
_MARKS = re.compile(r"^[\s*/#!<-]+|[\s*/>-]+$", re.M)
#: Of _GENERATED_HEAD what is no common wording of a comment on single values, and so counts between declarations, too.
_GENERATED_AMID = re.compile(
    r"""^\W*(?:auto-?generated\b|@generated\b|code\ generated\ by\b|this\ (?:file|code|class|module)\ (?:is|was|has\ been)\ (?:auto\S*\ )?(?:written|generated|produced|created|emitted)\ by\b
    |generated\ (?:on|at)\ \d{4}|do\ not\ (?:edit|modify|change)\b.{0,40}\bby\ hand\b|do\ not\ (?:edit|modify|change):\ output\ of\b|changes\ will\ be\ (?:lost|overwritten)\b)
    |\bsinh\ tự\ động\b|\bautomatisch\ (?:erzeugt|generiert)\b|\bgénéré\ automatiquement\b""",
    re.X | re.I,
)
# Comments that begin a line, as group 1, by language; strings are matched first, as they may hold the marks that a generator writes.
_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?"
_BLOCK, _SLASHES = r"^[ \t]*(/\*[\s\S]*?(?:\*/|\Z))|/\*[\s\S]*?(?:\*/|\Z)", r"^[ \t]*(//[^\n]*)|//[^\n]*"
_TAG = r"^[ \t]*(<!--[\s\S]*?(?:-->|\Z))|<!--[\s\S]*?(?:-->|\Z)"
_HASH, _DASHES = r"^[ \t]*(#[^\n]*)|#[^\n]*", r"^[ \t]*(--[^\n]*)|--[^\n]*"
_LATER = {
    k: re.compile("|".join(x), re.M)
    for k, x in {
        "ecma": (_SLASHES, _BLOCK, r"`(?:\\.|[^`\\])*`?", _QUOTED),
        "csharp": (_SLASHES, _BLOCK, r"\"{3,}[\s\S]*?(?:\"{3,}|\Z)|(?:@\$?|\$@)\"(?:\"\"|[^\"])*\"?", _QUOTED),
        "css": (_BLOCK, _QUOTED),
        "proto": (_SLASHES, _BLOCK, _QUOTED),
        "python": (_HASH, r"\"{3}(?:\\[\s\S]|[^\\])*?(?:\"{3}|\Z)|'{3}(?:\\[\s\S]|[^\\])*?(?:'{3}|\Z)", _QUOTED),
        "sql": (_DASHES, _BLOCK, r"'(?:''|[^'])*'?|\"[^\"]*\"?"),
        "markdown": (r"^[ \t]*(?:```[\s\S]*?(?:^[ \t]*```|\Z)|~~~[\s\S]*?(?:^[ \t]*~~~|\Z))", r"`[^`\n]*`", _TAG),
        "html": (_TAG, _SLASHES, _BLOCK, r"`(?:\\.|[^`\\])*`?"),
        "other": (_SLASHES, _BLOCK, r"^[ \t]*(#[^\n]*)|(?<=\s)#[^\n]*", r"^[ \t]*(--[^\n]*)|(?<=\s)--\s[^\n]*", _TAG, _QUOTED),
    }.items()
}
_FAMILY = {"typescript": "ecma", "javascript": "ecma", "vue": "html", "text": "other", "json": None}
_FAMILY_OF_NAME = {"ts": "ecma", "tsx": "ecma", "mts": "ecma", "js": "ecma", "jsx": "ecma", "mjs": "ecma", "cs": "csharp", "py": "python", "pyi": "python", "css": "css", "proto": "proto", "sql": "sql", "md": "markdown", "html": "html", "vue": "html", "json": None}
_NUMBER = re.compile(r"(?<![\w.])-?(?:0x[0-9a-f]+|\d+(?:\.\d+)?)(?:[uUlLfFdDmM]{0,2})(?![\w.])", re.I)
_ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{60,}|(?:\\x[0-9a-f]{2}){16,}|(?:[0-9a-f]{2}[\s:]?){40,}", re.I)
_NUMBERED = re.compile(r"[A-Za-z_]\w*?(\d+)_?(?!\w)")


def later_comments(name: str, language: str | None, text: str, at: int) -> tuple[list[str], list[str]]:
    """The lines of the comments that begin a line from at on: those between code, and those after the last code."""
    family = _FAMILY.get(language, language) if language else _FAMILY_OF_NAME.get(name.rsplit(".", 1)[-1].lower(), "other")
    if family is None:
        return [], []
    amid, foot, end = [], [], at
    for m in _LATER.get(family, _LATER["other"]).finditer(text, at):
        if m.lastindex:
            if text[end : m.start()].strip():
                amid += foot
                foot = []
            foot += _MARKS.sub("", m[m.lastindex]).splitlines()
            end = m.end()
    return (amid + foot, []) if text[end:].strip() else (amid, foot)


def is_mark(line: str, form: re.Pattern) -> bool:
    """Whether a line of a comment is a tool's mark and doesn't just talk of one."""
    return bool(form.search(line)) and not _TALKS_OF.search(re.sub(r"[\"“'`][^\"”'`]{0,60}[\"”'`]", "", line))


def evidence(path: str, language: str | None, text: str) -> list[float]:
    """Log-likelihoods of LABELS from the name and the text of one file, against hand-written."""
    e = [0.0] * 5
    name = path.replace("\\", "/")
    if _GENERATED_NAME.search(name):
        e[1] += 4.0
    if _MINIFIED_NAME.search(name):
        e[2] += 3.5
    if _VERSION_NAME.search(name):
        e[3] += 3.0
    head = _COMMENTS.match(text)
    comments = _MARKS.sub("", head[0]) if head else ""
    body = text[head.end() :] if head else text
    lines = [x for x in re.split(r"[\n;]" if language == "sql" else r"\n", comments) if x.strip()]
    amid, foot = later_comments(name, language, text, head.end() if head else 0)
    if any(is_mark(x, _GENERATED_HEAD) for x in [*lines, *foot]) or any(is_mark(x, _GENERATED_AMID) for x in amid):
        e[1] += 7.0
    elif lines and _TALKS_OF.search(" ".join(lines)):
        e[0] += 2.0
    top = "\n".join(lines)
    if _LIBRARY_HEAD.search(top) and not _OWN_HEAD.search(top):
        e[3] += 6.0
    elif _OWN_HEAD.search(top):
        e[0] += 2.0
    if language == "json" or name.endswith(".json"):
        if _LOCK_NAME.search(name):
            e[1] += 6.0
        if re.search(r'"(?:lockVersion|lockfileVersion|integrity|resolved)"\s*:', text):
            e[1] += 6.0
    elif _LOCK_NAME.search(name):
        e[1] += 6.0
    code = body.strip()
    n = len(code)
    if n:
        full = min(1.0, n / FORM_CHARS) ** 3
        rows = [x for x in code.splitlines() if x.strip()]
        wide = "".join(x for x in rows if len(x) > 250)
        long = len(wide)
        data = (sum(len(m[0]) + 1 for m in _NUMBER.finditer(code)) + sum(len(m[0]) for m in _ENCODED.finditer(code))) / n
        if language not in ("json", "markdown", "text", None) or name.rsplit(".", 1)[-1] in ("js", "css", "ts", "mjs", "cs", "py"):
            if long > 0.75 * n and data < 0.4 and len(re.findall(r"\s", wide)) < 0.1 * long and len(re.findall(r"[{}();=?]", wide)) > 0.1 * long:
                e[2] += 7.0 * full
            if re.search(r"[#@]\s?sourceMappingURL=", text):
                e[2] += 3.0
        if data > 0.55:
            e[4] += 7.5 * full
        elif data > 0.42:
            e[4] += 5.5 * full
        if e[2] < 7 and code[0] not in "{[" and (len(rows) >= 8 or long > 0.5 * n):
            e[1] += _repeats(rows, code) * full
    return e


def _repeats(rows: list[str], code: str) -> float:
    """Log-odds of generated code from members that are numbered in order and from lines of few shapes."""
    numbers = {int(x) for x in _NUMBERED.findall(code) if len(x) < 19}  # no file numbers that many members
    run = 0
    while run in numbers or run + 1 in numbers:
        run += 1
    share = sum(bool(_NUMBERED.search(x)) for x in rows) / len(rows)
    shapes = len({re.sub(r"\w+", "w", re.sub(r"\d+", "9", x.strip())) for x in rows}) / len(rows)
    return (6.5 if run >= 5 and share > 0.3 else 0.0) + (1.5 if run >= 5 and shapes < 0.4 else 0.0)


def body_key(text: str) -> tuple[str | None, int]:
    """A hash of a file without its leading comments and white space, and its length; None for an empty one."""
    head = _COMMENTS.match(text)
    body = " ".join((text[head.end() :] if head else text).split())
    return (hashlib.md5(body.encode("utf-8", "surrogatepass")).hexdigest() if body else None), len(body)


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = b["content"].fillna("")
        e = [evidence(p, language, t) for p, language, t in zip(b["path"], b["language"].astype(object).where(b["language"].notna(), None), texts)]
        out = pd.DataFrame(e, columns=[f"e{i}" for i in range(5)])
        keys = [body_key(t) for t in texts]
        yield out.assign(repo_id=b["repo_id"].values, path=b["path"].values, body=[k for k, _ in keys], size=[n for _, n in keys])[["repo_id", "path", "body", "size", *out.columns]]


def _total(terms: list[Column]) -> Column:
    top = F.greatest(*terms)
    total = F.exp(terms[0] - top)
    for t in terms[1:]:
        total = total + F.exp(t - top)
    return top + F.log(total)


def _up(prefix: str, table: dict) -> list[Column]:
    """The message of a child with log-beliefs prefix0..4 to its directory, by the directory's label."""
    return [_total([F.col(f"{prefix}{i}") + math.log(table[d][i]) for i in range(5)]) for d in LABELS]


def _down(without: list[Column], table: dict) -> list[Column]:
    """The message of a directory, with its beliefs without that child, to the child, by the child's label."""
    return [_total([without[k] + math.log(table[d][i]) for k, d in enumerate(LABELS)]) for i in range(5)]


def labels(contents: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, path, label, confidence): the likeliest of LABELS for each file, and its probability.

    Method: belief propagation over the directory tree of each repository. Files give evidence (names, marks of
    tools in comments anywhere and of libraries in the leading ones, line lengths, share of data, numbered members, and the number
    of files with the same body); directories give that of their names. Messages go up the tree level by level,
    summed within each split first, and down again; on a tree this is exact. A file so gets what its siblings and
    the directories above say, by FILE_GIVEN_DIR and DIR_GIVEN_DIR.

    Defined cases: NULL or empty contents give no evidence of their own; a NULL path or repository gives no row; a
    repeated row gives a repeated row; either path separator counts; files without language are labelled, too.
    """
    scratch = Scratch(contents.sparkSession, "labels")
    known = with_language(contents.where(F.col("repo_id").isNotNull() & F.col("path").isNotNull()), files)
    seen = scratch.save(known.select("repo_id", "path", "content", "language").mapInPandas(_look, "repo_id string, path string, body string, size bigint, " + ", ".join(f"e{i} double" for i in range(5))), "seen")
    copies = seen.where("body is not null").groupBy("body").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = salted_join(seen, copies, ["body"], "left", spread=F.col("path"))
    copied = F.when(F.col("n") >= 4, 7.0).when(F.col("n") == 3, 4.0).when(F.col("n") == 2, 2.5).otherwise(0.0)
    copied = copied * F.pow(F.least(F.lit(1.0), F.col("size") / BODY_CHARS), F.lit(3.0))
    key = F.replace("path", F.lit("\\"), F.lit("/"))
    folder = F.when(key.contains("/"), F.regexp_replace(key, r"/[^/]*$", "")).otherwise(F.lit(""))
    seen = seen.select("repo_id", "path", folder.alias("dir"), (F.col("e0") + FILE_PRIOR).alias("e0"), "e1", "e2", (F.col("e3") + copied).alias("e3"), "e4")
    seen = scratch.save(seen.select("*", *[m.alias(f"u{k}") for k, m in enumerate(_up("e", FILE_GIVEN_DIR))]), "files")
    sums = [F.sum(f"u{k}").alias(f"s{k}") for k in range(5)]
    from_files = scratch.save(seen.groupBy("repo_id", "dir").agg(*sums), "from_files")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    dirs = from_files.select("repo_id", F.explode(above).alias("dir")).distinct()
    base = F.lower(F.regexp_extract("dir", r"([^/]*)$", 1))
    named = []
    for label in LABELS:
        c = F.lit(DIR_PRIOR if label == "handwritten" else 0.0)
        for name, odds in DIR_NAMES.get(label, {}).items():
            c = c + F.when(base == name, float(odds)).otherwise(0.0)
        if label == "vendored":
            c = c + F.when(F.lower("dir").rlike(r"(?:^|/)wwwroot/lib$"), 8.0).otherwise(0.0)
        named.append(c)
    dirs = dirs.select("repo_id", "dir", F.when(F.col("dir") == "", 0).otherwise(F.size(parts)).alias("depth"), F.when(F.col("dir").contains("/"), F.regexp_replace("dir", r"/[^/]*$", "")).otherwise(F.lit("")).alias("up"), *[c.alias(f"b{k}") for k, c in enumerate(named)])
    dirs = dirs.join(from_files, ["repo_id", "dir"], "left").select("repo_id", "dir", "depth", "up", *[(F.col(f"b{k}") + F.coalesce(f"s{k}", F.lit(0.0))).alias(f"b{k}") for k in range(5)])
    dirs = scratch.save(dirs, "dirs")
    deepest = dirs.agg(F.max("depth")).first()[0]
    levels: dict[int, DataFrame] = {}
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = dirs.where(F.col("depth") == depth)
        if depth + 1 in levels:
            from_dirs = levels[depth + 1].groupBy("repo_id", F.col("up").alias("dir")).agg(*sums)
            level = level.join(from_dirs, ["repo_id", "dir"], "left").select("repo_id", "dir", "depth", "up", *[(F.col(f"b{k}") + F.coalesce(f"s{k}", F.lit(0.0))).alias(f"b{k}") for k in range(5)])
        levels[depth] = scratch.save(level.select("*", *[m.alias(f"u{k}") for k, m in enumerate(_up("b", DIR_GIVEN_DIR))]), f"up{depth}")
    full: DataFrame | None = None
    done = None
    for depth in sorted(levels):
        level = levels[depth]
        if full is not None:
            parent = full.select("repo_id", F.col("dir").alias("up"), *[F.col(f"b{k}").alias(f"p{k}") for k in range(5)])
            down = _down([F.col(f"p{k}") - F.col(f"u{k}") for k in range(5)], DIR_GIVEN_DIR)
            level = level.join(parent, ["repo_id", "up"]).withColumns({f"m{k}": m for k, m in enumerate(down)})
            level = level.select("repo_id", "dir", *[(F.col(f"b{k}") + F.col(f"m{k}")).alias(f"b{k}") for k in range(5)])
        full = scratch.save(level.select("repo_id", "dir", *[f"b{k}" for k in range(5)]), f"down{depth}")
        done = full if done is None else done.unionByName(full)
    if done is None:
        return seen.select("repo_id", "path", F.lit("handwritten").alias("label"), F.lit(1.0).alias("confidence"))
    met = salted_join(seen, done.select("repo_id", "dir", *[F.col(f"b{k}").alias(f"p{k}") for k in range(5)]), ["repo_id", "dir"], "inner", spread=F.col("path"))
    down = _down([F.col(f"p{k}") - F.col(f"u{k}") for k in range(5)], FILE_GIVEN_DIR)
    met = met.withColumns({f"m{k}": F.col(f"e{k}") + m for k, m in enumerate(down)})
    best = F.greatest(*[F.struct(F.col(f"m{k}").alias("m"), F.lit(-k).alias("k")) for k in range(5)])
    total = _total([F.col(f"m{k}") for k in range(5)])
    return met.select("repo_id", "path", F.element_at(F.array(*map(F.lit, LABELS)), 1 - best["k"]).alias("label"), F.round(F.exp(best["m"] - total), 4).alias("confidence"))


def foreign_files(contents: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, path) of files that are not hand-written by the repository's team."""
    return labels(contents, files).where(F.col("label") != "handwritten").select("repo_id", "path").distinct()
