"""Scalar functions as native column expressions, but for the few that need a parser."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

# Default confidence of an edge by the prefix of its target token, else by its type, else 1.
TOKEN_CONFIDENCE = {"callee": 0.4, "import": 0.5, "type": 0.45, "property": 0.5}
TYPE_CONFIDENCE = {"CALLS": 1.0, "IMPORTS": 0.95, "TYPE_REF": 0.9, "PROPERTY_REF": 0.85, "PROPERTY_WRITE": 0.82}
# Folders of tests, and the part before the extension that names a test (walk.test.ts).
TEST_FOLDERS, TEST_PARTS = ("test", "tests", "__tests__"), ("test", "spec")


def stable_id(x: Column) -> Column:
    """The first 24 hex digits of SHA-256."""
    return F.substring(F.sha2(x, 256), 1, 24)


def norm_path(p: Column) -> Column:
    return F.replace(p, F.lit("\\"), F.lit("/"))


def is_test_path(p: Column) -> Column:
    """A file in a folder of tests, or one whose own name says so in the way of its language; case does not matter."""
    steps = F.split(F.lower(norm_path(p)), "/")
    name = F.element_at(steps, -1)
    parts = F.split(name, r"\.")
    in_folder = F.arrays_overlap(F.slice(steps, 1, F.size(steps) - 1), F.array(*map(F.lit, TEST_FOLDERS)))
    by_part = (F.size(parts) > 2) & F.try_element_at(parts, F.lit(-2)).isin(*TEST_PARTS)
    python = (name.startswith("test_") & name.endswith(".py")) | name.endswith("_test.py")
    return in_folder | F.coalesce(by_part, F.lit(False)) | python | name.endswith("tests.cs")


def is_migration(path: Column, name: Column) -> Column:
    """A file whose name starts with eight digits or more and _, or an Up or Down method in one."""
    base = F.regexp_extract(norm_path(path), r"([^/]*)$", 1)
    return base.rlike(r"^\d{8,}_") | (name.isin("Up", "Down") & norm_path(path).rlike(r"(?i)migration"))


def split_case(x: Column) -> Column:
    """Camel, Pascal and acronym parts separated by a blank."""
    return F.regexp_replace(F.regexp_replace(x, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")


def tokens(x: Column) -> Column:
    """Lower-case parts of at least two characters, in order of first appearance."""
    return F.array_distinct(F.filter(F.split(F.lower(split_case(x)), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 2))


# Words that say little about what a name means.
COMMON_WORDS = "get set the and for new test tests index main spec".split()


def distinctive_tokens(x: Column) -> Column:
    """tokens() of three characters or more that are not COMMON_WORDS."""
    return F.filter(tokens(x), lambda t: (F.length(t) >= 3) & ~t.isin(*COMMON_WORDS))


def intent_tokens(x: Column, most: int = 12) -> Column:
    """Whole words, then their case and snake parts, each once, at most that many."""
    words = F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) >= 2)
    return F.slice(F.array_distinct(F.concat(words, tokens(x))), 1, most)


def strip_generics(x: Column) -> Column:
    return F.regexp_replace(x, r"<[^>]*>", "")


def normalize_symbol(name: Column, signature: Column) -> Column:
    """Searchable text of a symbol: no token prefix or generics, case split, separators blank, lower case."""
    clean = lambda c: F.trim(F.lower(F.regexp_replace(split_case(strip_generics(c)), r"[^A-Za-z0-9]+", " ")))
    return F.trim(F.concat_ws(" ", clean(F.regexp_replace(name, r"^[a-z]+:", "")), clean(F.coalesce(signature, F.lit("")))))


def djb2(x: Column) -> Column:
    """h = 33 h + c modulo 2**32 from 5381 over the characters (UTF-16 units and code points agree in the BMP)."""
    return F.aggregate(F.split(x, ""), F.lit(5381).cast("bigint"), lambda h, c: F.when(c == "", h).otherwise(F.pmod(h * 33 + F.ascii(c), F.lit(4294967296))))


def trigram_buckets(x: Column, size: int = 512) -> Column:
    """Buckets of the trigrams of each word of two characters or more; a word of two counts whole."""
    words = F.filter(F.split(x, " "), lambda t: F.length(t) >= 2)
    grams = F.flatten(F.transform(words, lambda w: F.when(F.length(w) < 3, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))
    return F.transform(grams, lambda g: F.pmod(djb2(g), F.lit(size)).cast("int"))


def trigram_vector(x: Column, size: int = 512) -> Column:
    """The counts of trigram_buckets() as a vector of length 1; all zero stays zero."""
    b = trigram_buckets(x, size)
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(b, lambda y: y == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(counts, lambda v: F.when(norm > 0, v / norm).otherwise(v))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, without case."""
    x, y = F.lower(a), F.lower(b)
    return F.when(x == y, 1.0).when((F.length(x) == 0) | (F.length(y) == 0), 0.0).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def bigrams(x: Column) -> Column:
    return F.when(F.length(x) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2))))


def dice(a: Column, b: Column) -> Column:
    """2 * common / all bigrams as multisets; strings under two characters: 1 if equal."""
    x, y = bigrams(a), bigrams(b)
    count = lambda arr, g: F.size(F.filter(arr, lambda z: z == g))
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, g: s + F.least(count(x, g), count(y, g)))
    return F.when((F.length(a) < 2) | (F.length(b) < 2), (a == b).cast("double")).otherwise(2.0 * common / (F.size(x) + F.size(y)))


def convention_key(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"[_\-]", ""))


def convention_stem(x: Column) -> Column:
    return F.regexp_replace(convention_key(x), r"(es|s)$", "")


def singular(x: Column) -> Column:
    return F.when(x.rlike("ies$"), F.regexp_replace(x, "ies$", "y")).when(x.rlike("ses$"), F.regexp_replace(x, "es$", "")).when(x.rlike("[^s]s$"), F.regexp_replace(x, "s$", "")).otherwise(x)


def plural(x: Column) -> Column:
    return F.when(x.rlike("[^aeiou]y$"), F.regexp_replace(x, "y$", "ies")).when(x.rlike("(s|x|z|ch|sh)$"), F.concat(x, F.lit("es"))).otherwise(F.concat(x, F.lit("s")))


@F.pandas_udf(StringType())
def fold_diacritics(x: pd.Series) -> pd.Series:
    """Without combining marks; đ becomes d."""
    return x.str.normalize("NFD").str.replace(r"[̀-ͯ]", "", regex=True).str.replace("đ", "d").str.replace("Đ", "D")


def non_ascii_letters(x: Column) -> Column:
    """Letters outside ASCII that stand next to another letter."""
    return F.regexp_count(x, F.lit(r"(?<=\p{L})(?=\P{ASCII})\p{L}|(?=\P{ASCII})\p{L}(?=\p{L})"))


def norm_endpoint(x: Column) -> Column:
    """The path of a quoted URL or path: no host, query or fragment, single slashes, one in front, lower case."""
    bare = F.regexp_replace(x, "[\"'`]", "")
    path = F.regexp_replace(F.regexp_replace(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), r"[?#].*$", "")
    return F.lower(F.regexp_replace(F.concat(F.lit("/"), path), "/+", "/"))


def combine_route(prefix: Column, template: Column, controller: Column, action: Column) -> Column:
    joined = F.concat_ws("/", F.coalesce(prefix, F.lit("")), F.coalesce(template, F.lit("")))
    return F.regexp_replace(F.replace(F.replace(joined, F.lit("[controller]"), controller), F.lit("[action]"), action), "/+", "/")


def _parameters(signature: str | None) -> int | None:
    """Top-level parameters in the first parenthesis of a signature; quotes and nested brackets count as one."""
    if signature is None or "(" not in signature:
        return None
    depth, quote, commas, seen = 0, "", 0, False
    for c in signature[signature.index("(") :]:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote, seen = c, True
        elif c in "([{<":
            seen |= depth > 0
            depth += 1
        elif c in ")]}>":
            depth -= 1
            if depth == 0:
                break
        elif depth == 1 and c == ",":
            commas += 1
        elif not c.isspace():
            seen = True
    return commas + 1 if seen else 0


@F.pandas_udf(IntegerType())
def param_count(x: pd.Series) -> pd.Series:
    return x.map(_parameters).astype("Int32")


def sql_name_key(name: Column) -> Column:
    """schema|rest; the schema public is as none."""
    parts = F.split(F.lower(F.regexp_replace(name, '[\\[\\]"`]', "")), r"\.")
    has = F.size(parts) > 1
    schema = F.when(has & (parts[0] != "public"), parts[0]).otherwise(F.lit(""))
    return F.concat_ws("|", schema, F.when(has, F.array_join(F.slice(parts, 2, 10), ".")).otherwise(parts[0]))


def edge_confidence(to_id: Column, kind: Column) -> Column:
    c = F.lit(None).cast("double")
    for k, v in TYPE_CONFIDENCE.items():
        c = F.coalesce(c, F.when(kind == k, v))
    p = F.lit(None).cast("double")
    for k, v in TOKEN_CONFIDENCE.items():
        p = F.coalesce(p, F.when(to_id.startswith(k + ":"), v))
    return F.coalesce(p, c, F.lit(1.0))


def epoch_to_timestamp(x: Column) -> Column:
    """A number of ns, µs, ms or s since 1970, told apart by its size."""
    micros = F.when(x > 1e17, x / 1000).when(x > 1e14, x).when(x > 1e11, x * 1000).otherwise(x * 1000000)
    return F.timestamp_micros(F.floor(micros).cast("bigint"))


def duration_ms(us: Column) -> Column:
    return us / 1000.0


def namespace_root(x: Column, parts: int = 2) -> Column:
    return F.substring_index(x, ".", parts)


def classify_namespace(x: Column, app: list[str], framework: list[str]) -> Column:
    """app before framework before unclassified, by prefix."""
    starts = lambda ps: F.lit(False) if not ps else F.greatest(F.lit(False), *[x.startswith(p) for p in ps])
    return F.when(starts(app), "app").when(starts(framework), "framework").otherwise("unclassified")


def risk_score(n_files: Column, unresolved: Column, median: Column, low: Column, n_edges: Column) -> Column:
    """0 to 100: 70 for files (full at 50), 15 for the unresolved part, 10 for doubt, 5 for the part of weak edges."""
    weak = F.when(n_edges > 0, low / n_edges).otherwise(0.0)
    return F.floor(100 * (0.7 * F.least(F.lit(1.0), n_files / 50.0) + 0.15 * unresolved + 0.1 * (1 - median) + 0.05 * weak) + 0.5)


def risk_level(score: Column) -> Column:
    return F.when(score >= 67, "high").when(score >= 34, "medium").otherwise("low")


def redact(x: Column) -> Column:
    """Credentials in URIs, values of secret keys and e-mail addresses masked."""
    x = F.regexp_replace(x, r"(\w+://)[^/\s:@]+:[^/\s@]+@", "$1***@")
    x = F.regexp_replace(x, r"(?i)\b(password|passwd|pwd|secret|token|api[_-]?key)\b(\s*[=:]\s*)\S+", "$1$2***")
    return F.regexp_replace(x, r"[\w.+-]+@[\w-]+\.[\w.]+", "***@***")


def bytes_hex(x: Column, most: int = 64) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(F.substring(x, 1, most))))


def json_normalize(columns: dict[str, Column], drop_null: bool = True) -> Column:
    """A JSON object with its keys in order; NULL members dropped or written."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": str(drop_null).lower()})


_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}


def relative_time(text: str) -> timedelta:
    m = re.fullmatch(r"(\d+)\s*([smhdSMHD])", text.strip())
    if not m:
        raise ValueError(f"not a relative time: {text!r}")
    return timedelta(**{_UNITS[m[2].lower()]: int(m[1])})


def instant(text: str) -> datetime:
    """Bare digits are milliseconds since 1970, anything else is ISO 8601; without offset it is UTC."""
    if text.strip().isdigit():
        return datetime.fromtimestamp(int(text) / 1000, timezone.utc)
    t = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)
