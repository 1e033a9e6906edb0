"""Queries of import resolution, vector search and pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import imports as op
from ..operators import search
from ..sources.tables import table
from . import base
from .functions import SQL as FUNCTION_SQL
from .functions import _djb2

#: Files of a repository of their own, as the folder's texts import little that is in it.
FILES = {
    "src/a.ts": "import { b } from './lib/b';\nimport c from '../out.js';\nconst d = require('./lib');\nimport '~/lib/b';\nimport x from 'react';\n", "src/lib/b.ts": "import a from '../a.ts';\nimport gone from './gone';\n", "src/lib/index.ts": "",
    "out.js": "export {};\n", "pkg/mod.py": "import os\nfrom pkg.sub import x\nfrom sub.deep import y\n", "pkg/sub/__init__.py": "from pkg import mod\n", "pkg/sub/deep.py": "import mod\n", "other/sub/deep.py": "import pkg.lost\n",
}
REMOVED = {"src/lib/gone.ts": "", "pkg/lost.py": ""}
RESOLVED = [
    ("src/a.ts", "./lib/b", "src/lib/b.ts"), ("src/a.ts", "../out.js", "out.js"), ("src/a.ts", "./lib", "src/lib/index.ts"), ("src/a.ts", "~/lib/b", "src/lib/b.ts"), ("src/lib/b.ts", "../a.ts", "src/a.ts"),
    ("pkg/mod.py", "pkg.sub", "pkg/sub/__init__.py"), ("pkg/mod.py", "sub.deep", "pkg/sub/deep.py"), ("pkg/sub/deep.py", "mod", "pkg/mod.py"),
]


def _small(s, rows: dict):
    return s.createDataFrame([("fixture", p, c) for p, c in rows.items()], "repo_id string, path string, content string")


def _all(s, d):
    return table(s, d, "file_contents").select("repo_id", fn.norm_path(F.col("path")).alias("path"), "content").unionByName(_small(s, FILES))


def _specifiers(s, d):
    x = _all(s, d)
    return op.resolve_specifiers(op.specifiers(x), x.select("repo_id", "path"), {"~/": "src/"})


def _named(s, d):
    """Symbols of five kinds."""
    return base.symbols(s, d).where("kind in ('class', 'interface', 'function', 'method', 'type')").select("repo_id", "symbol_id", "name")


def _padded(s, d):
    """Symbols that hold a word, filled up with those whose vectors are nearest."""
    v = _named(s, d)
    exact = v.where(F.lower("name").contains("harborsampler")).select("repo_id", "symbol_id", F.lit("match").alias("how"), F.lit(0.0).alias("distance"))
    return search.padded(exact, v, "harborSampler", 10)


QUERIES = {
    "x_module_specifier": _specifiers,
    "x_removed_path_impact": lambda s, d: op.removed_path_impact(op.specifiers(_all(s, d)), _all(s, d).select("repo_id", "path"), _small(s, REMOVED)),
    "x_imports_cross_repo": lambda s, d: op.imports_cross_repo(base.edges(s, d), base.symbols(s, d), ["System", "Tarn"]),
    "lim_after_path": lambda s, d: search.after_path(search.search_lines(table(s, d, "file_contents").withColumn("path", F.concat_ws(":", "repo_id", "path")), r"return", "path", "content"), "f", 3, 50),
    "vector_index": lambda s, d: search.vector_index(_named(s, d), ["repo_id", "symbol_id"]).select("repo_id", "symbol_id", "bucket", F.round("weight", 5).alias("weight")),
    "search_padding": _padded,
    "fn_distinctive_tokens": lambda s, d: base.symbols(s, d).select(F.explode(fn.distinctive_tokens(F.col("name"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")),
}

_BUCKETS = FUNCTION_SQL["fn_trigram_vector"].split(" select name, cast(")[0].replace("w as (select distinct name,", "names as (select name from sym union select 'harborSampler'), w as (select distinct name,").replace("as i from sym)", "as i from names)")
_VECTORS = _BUCKETS + ", c as (select name, cast(" + _djb2("g") + """ % 512 as integer) as bucket, count(*) as n from x group by 1, 2),
    u as (select name, bucket, n / sqrt(sum(n * n) over (partition by name)) as w from c),
    five as (select repo_id, symbol_id, name from sym where kind in ('class', 'interface', 'function', 'method', 'type'))"""
SQL = {
    "x_module_specifier": "select 'fixture' as repo_id, * from (values " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in RESOLVED) + ") t(path, specifier, target)",
    "x_removed_path_impact": "select * from (values ('fixture', 'src/lib/gone.ts', 'src/lib/b.ts', 0.95::double), ('fixture', 'pkg/lost.py', 'other/sub/deep.py', 0.95::double)) t(repo_id, removed, importer, confidence)",
    "x_imports_cross_repo": "with " + base.SYM + """, size as (select repo_id, count(*) as n from sym group by 1),
        best as (select name, arg_min({'r': y.repo_id, 's': symbol_id}, {'a': -n, 'b': y.repo_id, 'c': symbol_id}) as b from sym y join size using (repo_id) group by 1),
        a as (select repo_id, edge_id, regexp_replace(to_id, '^import:', '') as f from edges where starts_with(to_id, 'import:'))
        select edge_id, best.b.r as to_repo, best.b.s as symbol_id from a join best on best.name = string_split(f, '.')[-1]
        where (string_split(f, '.')[1] in ('System', 'Tarn') or not contains(f, '.')) and best.b.r <> a.repo_id and not exists (select 1 from sym o where o.repo_id = a.repo_id and o.name = string_split(f, '.')[-1])""",
    "lim_after_path": r"""with l as (select repo_id || ':' || path as path, unnest(string_split_regex(content, '\r?\n')) as l, generate_subscripts(string_split_regex(content, '\r?\n'), 1) as line from file_contents),
        h as (select path, line, len(regexp_extract_all(l, 'return')) as n_hits, 'return' as first from l where contains(l, 'return') and path >= 'f')
        select path, line, n_hits, first, (select count(*) from h) > 53 as truncated from h order by path, line limit 50 offset 3""",
    "vector_index": _VECTORS + " select repo_id, symbol_id, bucket, round(w, 5) as weight from five join u using (name)",
    "search_padding": _VECTORS + """, hit as (select repo_id, symbol_id, 'match' as how, 0.0::double as distance from five where contains(lower(name), 'harborsampler')),
        dot as (select a.name, sum(a.w * b.w) as dot from u a join u b on b.bucket = a.bucket and b.name = 'harborSampler' group by 1),
        far as (select repo_id, symbol_id, 'fuzzy' as how, round(sqrt(greatest(0, 2 - 2 * coalesce(dot, 0))), 6) as distance from five left join dot using (name) where not contains(lower(name), 'harborsampler'))
        select * from hit union all select * from (select * from far order by distance, repo_id, symbol_id limit case when (select count(*) from hit) >= 3 then 0 else 10 - (select count(*) from hit) end)""",
    "fn_distinctive_tokens": "with " + base.SYM + r", t as (select unnest(list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 3 and x not in ('get', 'set', 'the', 'and', 'for', 'new', 'test', 'tests', 'index', 'main', 'spec')))) as token from sym) select token, count(*) as n from t group by 1",
}
