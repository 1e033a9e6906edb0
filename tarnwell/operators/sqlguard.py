"""A guarded, read-only SQL surface over scoped views."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCAN = re.compile(r"--[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|(?P<c>\Z))|'(?:[^']|'')*(?:'|(?P<s>\Z))|\"(?:[^\"]|\"\")*(?:\"|(?P<d>\Z))|(?P<t>\$\w*\$)")
# Words that a reading statement has no use for.
FORBIDDEN = "insert update delete merge drop alter create truncate grant revoke call exec execute set reset use cache uncache refresh add load copy vacuum analyze attach detach pragma install".split()


class Refused(ValueError):
    """A statement that is not allowed."""


def blank(sql: str) -> tuple[str, bool]:
    """The statement with comments and literals blanked, of the same length, and whether all of them are closed."""
    out, at, closed = [], 0, True
    while True:
        m = _SCAN.search(sql, at)
        if not m:
            return "".join(out) + sql[at:], closed
        end = m.end()
        if m["t"]:
            k = sql.find(m["t"], end)
            closed &= k >= 0
            end = k + len(m["t"]) if k >= 0 else len(sql)
        closed &= m["c"] is None and m["s"] is None and m["d"] is None
        out += [sql[at : m.start()], re.sub(r"[^\n]", " ", sql[m.start() : end])]
        at = end


def check(sql: str, longest: int = 20_000) -> str:
    """The statement without a final semicolon; Refused unless it is a single SELECT or WITH ... SELECT."""
    text, closed = blank(sql)
    if not text.strip() or len(sql) > longest or not closed:
        raise Refused("the statement is empty, too long or not closed")
    body = text.rstrip().rstrip(";")
    if ";" in body:
        raise Refused("only one statement is allowed")
    if not re.match(r"\s*(select|with)\b", body, re.I) or not re.search(r"\bselect\b", body, re.I):
        raise Refused("only SELECT is allowed")
    word = re.search(rf"\b({'|'.join(FORBIDDEN)})\b", body, re.I)
    if word:
        raise Refused(f"{word[1].upper()} is not allowed")
    return sql[: len(body)]


# Functions that run other code.
REFLECTION = frozenset(["reflect", "try_reflect", "java_method"])


def relations(spark: SparkSession, sql: str) -> set[str]:
    """The tables that a query reads, from its parsed plan, subqueries included and its common table expressions left
    out. Refused if the statement is no plain query or names anything but tables of one part."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused("the statement can't be parsed") from e
    forbidden = [spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{c}") for c in ("Command", "ParsedStatement")]
    found: set[str] = set()

    def each(seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    def expression(x, own: frozenset) -> None:
        kind = x.getClass().getSimpleName()
        if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            visit(x.plan(), own)
        if kind == "UnresolvedFunction" and x.nameParts().last().lower() in REFLECTION:
            raise Refused("functions that run other code are not allowed")
        for y in each(x.children()):
            expression(y, own)

    def visit(node, own: frozenset) -> None:
        kind = node.getClass().getSimpleName()
        if any(c.isInstance(node) for c in forbidden):
            raise Refused("only queries are allowed")
        if kind == "UnresolvedWith":
            recursive = node.allowRecursion()
            for pair in each(node.cteRelations()):
                name = pair._1().lower()
                visit(pair._2(), own | {name} if recursive else own)
                own |= {name}
        elif kind == "UnresolvedRelation":
            parts = each(node.multipartIdentifier())
            if len(parts) != 1:
                raise Refused(f"no such table: {'.'.join(parts)}")
            if parts[0].lower() not in own:
                found.add(parts[0])
        elif kind == "UnresolvedTableValuedFunction" and node.name().last().lower() not in ("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "json_tuple", "stack"):
            raise Refused(f"no such table function: {node.name().last()}")
        elif "Relation" in kind and kind not in ("OneRowRelation", "LocalRelation"):
            raise Refused(f"{kind} is not allowed")
        for x in each(node.expressions()):
            expression(x, own)
        for child in each(node.children()):
            visit(child, own)

    visit(plan, frozenset())
    return found


def scoped_query(spark: SparkSession, tables: dict[str, DataFrame], sql: str, scope: str, column: str = "repo_id", most: int = 1000, args: dict | None = None) -> tuple[DataFrame, int]:
    """(rows, most): a checked statement over views that hold only the rows of scope, at most most + 1 of them, so that
    one can tell whether there are more.

    Every table in the parsed plan must be one of the given ones or an own common table expression; files, functions
    that make tables, and other views of the session are refused. The given tables come in as common table expressions,
    which hide anything else of their names, over views with names of this call, which are dropped once it is analysed.
    """
    sql = check(sql)
    known = {name.lower(): name for name in tables}
    used = {t.lower() for t in relations(spark, sql)}
    strange = used - known.keys()
    if strange:
        raise Refused(f"no such table: {', '.join(sorted(strange))}")
    call, views = uuid.uuid4().hex, {}
    for name in sorted(used):
        df = tables[known[name]]
        views[name] = f"__scoped_{call}_{name}"
        (df.where(df[column] == scope) if column in df.columns else df).createOrReplaceTempView(views[name])
    try:
        given = ", ".join(f"`{name}` as (select * from {view})" for name, view in views.items())
        head = re.match(r"\s*with(\s+recursive)?\b", blank(sql)[0], re.I)
        if given:
            sql = f"with{head[1] or ''} {given}, {sql[head.end():]}" if head else f"with {given} {sql}"
        return spark.sql(sql, args or {}).limit(most + 1), most
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def verdict(sql: str) -> str:
    """allowed, or why check() refuses the statement."""
    try:
        check(sql)
        return "allowed"
    except Refused as e:
        return str(e)


def pg_read(spark: SparkSession, tables: dict[str, DataFrame], sql: str, most: int = 100, costly: int = 10 << 30) -> tuple[DataFrame, int, str | None]:
    """(rows, bytes, warning): at most most + 1 rows of a checked statement, what its plan expects to handle, and a warning
    if that is more than costly bytes."""
    rows, _ = scoped_query(spark, tables, sql, "", column="", most=most)
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    scanned = [int(str(x.stats().sizeInBytes())) for x in _leaves(rows._jdf.queryExecution().optimizedPlan())]
    size = max([size, *scanned])
    return rows, size, f"the statement may handle {size} bytes" if size > costly else None


def _leaves(plan) -> list:
    found = plan.collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def bounded(rows: DataFrame, most: int, seconds: float) -> tuple[list, str]:
    """(rows, state): rows as they come, at most that many; state complete, capped or timed out. The job is cancelled at
    the deadline."""
    context, tag = rows.sparkSession.sparkContext, f"bounded-{uuid.uuid4().hex}"
    late = threading.Event()

    def cancel() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, cancel)
    context.addJobTag(tag)
    timer.start()
    try:
        found = rows.limit(most + 1).collect()  # most + 1 rows at most
    except Exception:
        if late.is_set():
            return [], "timed out"
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    return found[:most], "capped" if len(found) > most else "complete"


def resolve_catalogs(database: str | None, databases: list[str] | None, known: list[str], most: int = 10) -> list[str]:
    """The catalogs that a request means: one of both parameters, known names only, without case, each once."""
    if (database is None) == (databases is None):
        raise Refused("exactly one of database and databases is needed")
    by = {k.lower(): k for k in known}
    asked = list(dict.fromkeys(d.lower() for d in ([database] if database is not None else databases or [])))
    if not asked or any(d not in by for d in asked):
        raise Refused("no such database")
    if len(asked) > most:
        raise Refused(f"at most {most} databases at once")
    return [by[d] for d in asked]


def tables_named(sql: str) -> list[str]:
    """The tables that a statement reads from or joins, without its own common table expressions."""
    text = blank(sql)[0]
    own = set(re.findall(r"(?:\bwith|,)\s+(\w+)\s+as\s*\(", text, re.I))
    return sorted({t for t in re.findall(r"\b(?:from|join|update|into)\s+([\w.]+)", text, re.I)} - own)


def catalogs_named(sql: str) -> list[str]:
    """Catalogs of three-part names."""
    return sorted({m for m in re.findall(r"\b(\w+)\.\w+\.\w+\b", blank(sql)[0])})


# Changes that lock or rewrite a table, and what they are called.
RISKS = {
    r"\balter\s+table\b.*\balter\s+column\b.*\btype\b": "rewrites the table", r"\balter\s+table\b.*\badd\s+column\b.*\bnot\s+null\b(?!.*\bdefault\b)": "fails on rows that exist", r"\bcreate\s+(?:unique\s+)?index\b(?!\s+concurrently)": "locks writes",
    r"\bdrop\s+(?:table|column)\b": "loses data", r"\btruncate\b": "loses data", r"\balter\s+table\b.*\badd\s+constraint\b(?!.*\bnot\s+valid\b)": "scans under a lock",
}


def lint(sql: str) -> list[str]:
    text = re.sub(r"\s+", " ", blank(sql)[0].lower())
    return sorted({what for statement in text.split(";") for pattern, what in RISKS.items() if re.search(pattern, statement)})
