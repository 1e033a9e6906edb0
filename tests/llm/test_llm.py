"""Training-data operators against brute force, exact parsers, planted cases and round trips."""

import ast
import base64
import json
import math
import quopri
import random
import warnings
from bisect import bisect_left, bisect_right
from datetime import datetime, timedelta

import numpy as np
import pytest

from tarnwell.llm import handwritten, leakage, mixing, residue, sketch, syntax
from tarnwell.llm.grammars import parser

T0 = datetime(2026, 1, 1, 12)


# --- problem 2

@pytest.mark.parametrize("shape", ["uniform", "ties", "heavy", "sorted"])
def test_sketch_keeps_its_error(shape):
    rnd = np.random.default_rng(5)
    n = 200_000
    v = {"uniform": rnd.random(n), "ties": rnd.integers(0, 7, n).astype(float), "heavy": rnd.pareto(1, n), "sorted": np.arange(n, dtype=float)}[shape]
    parts = [sketch.Compactors(f"k{i}") for i in range(20)]
    for s, p in zip(parts, np.array_split(v, 20)):
        s.update(p)
    whole = sketch.Compactors("all")
    for s in parts:
        for h, x in enumerate(s.levels):
            whole.merge_level(h, x, s.flips[h], s.sections[h])
    whole.finish()
    assert whole.n == n and sum(len(x) << h for h, x in enumerate(whole.levels)) == n
    assert sum(map(len, whole.levels)) < 12_000
    s = np.sort(v)
    for q, x in zip((0.5, 0.9, 0.99, 0.999), whole.quantiles((0.5, 0.9, 0.99, 0.999))):
        lo, hi, k = bisect_left(s, x) + 1, bisect_right(s, x), math.ceil(q * n)
        assert (0 if lo <= k <= hi else min(abs(lo - k), abs(hi - k))) <= sketch.RANK_ERROR * (n - k) + 1


def test_percentiles_take_each_id_once(spark):
    ddl = [(i, "prod" if i % 3 else None, [None, -5, 10, 20, 30][i % 5], T0 + timedelta(days=i % 2)) for i in range(100)]
    audit = [(1, "t", 7, T0), (1, "t", 7, T0), (None, "t", 9, T0), (2, "t", None, T0)]
    a = spark.createDataFrame(ddl + ddl[:30], "id bigint, environment string, duration_ms int, applied_at timestamp")
    b = spark.createDataFrame(audit, "id bigint, tool string, rows_affected int, ts timestamp")
    got = {(r.metric, r.grp, r.period, r.day): (r.n, r.p50, r.p90, r.p99) for r in sketch.percentiles(a, b).collect()}
    for grp in ("prod", None):
        own = sorted(x for _, g, x, _ in ddl if g == grp and x is not None and x >= 0)
        assert got["duration_ms", grp, "all", None] == (len(own), *[own[math.ceil(q * len(own)) - 1] for q in (0.5, 0.9, 0.99)])
    assert got["rows_affected", "t", "all", None] == (1, 7.0, 7.0, 7.0)
    assert len(got) == 2 + 4 + 2
    assert sketch.percentiles(a.limit(0), b.limit(0)).count() == 0


# --- problem 3

VALID = {
    "javascript": ["", "#!/usr/bin/env node\nlet a = b\nlet c = a / 2 / 3", "const r = /[/]\\//g.test(`a${ `${x}}` }`)", "/*\n<<<<<<< ours\n=======\n>>>>>>> theirs\n*/", "export default async function* f({a, b: [c] = []} = {}, ...d) { for await (const x of y) yield x ?? 1 }", "class A extends B { static #p = 1; get x() { return this.#p } async *[k]() {} }", "a ? (b, c) => d : e; label: for (;;) break label", "x = y\n++z", "import a, { b as c } from 'd'; export * as e from 'f'"],
    "typescript": ["const a = <T,>(x: T): x is string => true", "type A<T> = T extends (infer U)[] ? U : { readonly [K in keyof T]?: T[K] }", "abstract class A<T> implements B { constructor(private readonly a: string, b?: number) { super() } abstract f(): void; x!: string }", "declare module 'x' { export const y: number }", "let v = (a as any)!.b<string>(c) satisfies D; enum E { A = 1, B }", "const x = `\n<<<<<<< ours\n=======\n>>>>>>> theirs\n`", "function f(a: string): void\nfunction f(a: any) { return a < b && c > d }"],
    "csharp": ["", "using System;\nnamespace A.B;\npublic record R<T>(string X, int? Y = 3) : I where T : class;", 'var s = $"{(a ? "x" : "y"),5:N2}" + @"c:\\" + """raw "q" """; Foo<int>(a < b, c > d);', "class A { public int this[int i] { get => x[i]; set { } } public static A operator +(A a, A b) => new() { X = 1 }; event Action? E; }", "var q = from x in y where x is { A: > 3 and < 5, B: not null } select new { x.A }; await foreach (var z in w) yield return z switch { 1 => 2, _ => throw new E() };", "#if DEBUG\nclass A { }\n#endif\n", "[A(1), B] enum E : byte { X = 1, Y, }"],
    "python": ["", "def f(a, /, *b, c: int = 1, **d) -> None:\n\tpass\n", "x = [a for b in c if d if e]; y: int = 3\nmatch x:\n  case {'a': [1, *_]} | A(b=2) as z if z: pass\n  case _: pass\n", "if a:\n  b\nelif (c := d): e\nelse:\n\n # note\n  f\n", "s = '''\n<<<<<<< ours\n=======\n>>>>>>> theirs\n'''", "with (open(a) as b, c): pass\nasync def g():\n  async with x as y: return await z\n", "lambda *a, b=1: (yield)\nf'{x!r}' \"y\"\n@d.e(1)\nclass A(B, metaclass=C): x = 1\n"],
    "sql": ["", "select 1", "-- a\ncreate table if not exists t (a bigint primary key, b text default 'it''s (', c numeric(10, 2) not null check (c > 0), foreign key (b) references u (x) on delete cascade);", "insert into t (a, offset) values (1, null), (2, 'x') on conflict (a) do update set b = excluded.b returning *;", "with recursive a as (select 1 union all select n + 1 from a where n < 5) select x::int, count(*) filter (where y) over (partition by z order by w desc nulls last) from a left join b using (c) group by 1 having max(d) > 2 order by 1 limit 3;", "create or replace function f(a int) returns int language sql as $$ select ( $$;", "/*\n<<<<<<< ours\n*/ update t set a = case when b then 1 else 2 end where c in (select d from e) and f between 1 and 2; delete from x;"],
    "json": ["{}", ' [1, -2.5e3, "a\\u00e9\\n", null, true, {"a": {}}] ', '"x"'],
    "css": ["", "@media (max-width: 3px) { a:hover > b::after, .c[d=\"e\"] { content: \"}\"; width: calc(100% - 2px) } }\n@import url(x.css);", ":root { --a: { b }; --c:; } /* <<<<<<< */ a{color:#fff!important}"],
    "proto": ["", 'syntax = "proto3"; package a.b; import "c.proto"; message M { repeated int32 a = 1 [packed = true]; oneof o { string b = 2; } map<string, M> c = 3; reserved 4, 6 to 9; enum E { X = 0; } }', "service S { rpc F (stream A) returns (.b.C) { option (x).y = { z: 1 }; } }"],
}
INVALID = {
    "javascript": ["const x: number = 1", "function f( {", "interface A { b: string }", "<<<<<<< a\nx\n=======\ny\n>>>>>>> b", "a = 'open", "/* open", "import {type a} from 'b'", "x = {a: 1", "return = 3"],
    "typescript": ["class A {", "let x: = 3", "=======\nlet a = 1", "import logging\nfrom a import b", "type A = {"],
    "csharp": ["class A {", "using System\nclass A {}", "import x from 'y';", "class A { void F() { x = ; } }", ">>>>>>> x\nclass A {}"],
    "python": ["def f(:", "x = (1,", "if a:\npass", "using System;", "<<<<<<< a\nx = 1\n=======\n>>>>>>> b\n", "print 'x'", "  x = 1", "if a:\n    b\n  c\n", "s = 'open"],
    "sql": ["create table t (", "select from where", "insert into t (a) valuess (1)", "def f(): pass", "create index i on t (a"],
    "json": ["", "{'a': 1}", "[1,]", "{\"a\": 01}", "{} x", "{\"a\": undefined}", "// c\n{}"],
    "css": ["a { color: red", "a { b } }", "<!doctype html>", "<<<<<<< a\na {}", "a { content: \"open }"],
    "proto": ["message A {", "message A { string a; }", "import os", "syntax = proto3;"],
}


@pytest.mark.parametrize("language", VALID)
def test_grammars_accept_and_refuse(language):
    for text in VALID[language]:
        assert parser(language).parse(text) < 0, text
        assert parser(language).parse("﻿" + text.replace("\n", "\r\n")) < 0, text
    for text in INVALID[language]:
        assert parser(language).parse(text) >= 0, text


def test_python_and_json_grammars_agree_with_exact_parsers_on_broken_texts():
    rnd = random.Random(7)
    warnings.simplefilter("ignore")
    for k in range(600):
        text = VALID["python"][k % len(VALID["python"])]
        i = rnd.randrange(len(text) + 1)
        broken = [text[:i], text[:i] + rnd.choice(":()[]\n ,=x'") + text[i:], text[:i] + text[i + 1 :]][k % 3]
        try:
            ast.parse(broken)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        if ok:  # the grammar is no stricter than Python; it is laxer where the compiler, not the syntax, objects
            assert parser("python").parse(broken) < 0, broken
        doc = VALID["json"][k % 3]
        j = rnd.randrange(len(doc) + 1)
        cut = [doc[:j], doc[:j] + rnd.choice('{}[],:"1 ') + doc[j:]][k % 2]
        try:
            json.loads(cut)
            ok = True
        except ValueError:
            ok = False
        assert (parser("json").parse(cut) < 0) == ok, cut


def test_deep_and_long_texts_are_parsed():
    assert parser("json").parse("[" + "1," * 200_000 + "1]") < 0
    import sys

    sys.setrecursionlimit(200_000)
    assert parser("json").parse("[" * 3000 + "]" * 3000) < 0


def _repo(spark, raw):
    contents = spark.createDataFrame([("r", p, c, "x", 1) for p, c, _ in raw], "repo_id string, path string, content string, language string, key int")
    files = [("r", p.replace("/", "\\") if i % 2 else p, "h", lang, "2026-02-01T00:00:00+02:00") for i, (p, _, lang) in enumerate(raw)]
    files += [("r", p, "h", "json", "2026-01-01T00:00:00Z") for p, _, _ in raw]
    return contents, spark.createDataFrame(files, "repo_id string, path string, content_hash string, language string, updated_at string")


def test_syntax_report_joins_current_language(spark):
    raw = [("a/ok.js", "let a = 1", "javascript"), ("a/cut.js", "let a = {", "javascript"), ("a/ts.js", "let a: number = 1", "javascript"), ("a/m.cs", "class A {}\n<<<<<<< x\n", "csharp"), ("a/t.md", "(((", "markdown"), ("a/n", "(((", None), ("a/e.json", "", "json"), ("a/null.js", None, "javascript")]
    contents, files = _repo(spark, raw)
    got = {r.path: r for r in syntax.syntax_report(contents, files).collect()}
    assert {p: r.cause for p, r in got.items()} == {"a/ok.js": None, "a/cut.js": "incomplete", "a/ts.js": "written in typescript", "a/m.cs": "conflict", "a/e.json": "incomplete"}
    assert got["a/m.cs"].failed_line == 2
    rates = {r.language: (r.n_files, r.n_invalid) for r in syntax.invalid_rates(contents, files).collect()}
    assert rates == {"javascript": (3, 2), "csharp": (1, 1), "json": (1, 1)}
    assert syntax.invalid_files(contents.limit(0), files.limit(0)).count() == 0


# --- problem 6

def test_labels(spark):
    hand = "import x from './y.js';\n\nexport function walk(a) {\n  // once per run\n  return a.map((b) => b + 1);\n}\n"
    gen = "\n".join(f"export function encodeField{i}(w, v) {{\n  return writeField(w, {i}, v);\n}}" for i in range(12))
    mini = "!function(){" + "".join(f"function a{i}(b){{return b.c?d({i}):b||{{e:1}}}}" for i in range(30)) + "}();"
    blob = "export const d = [" + ",".join(str(i * 7 % 251) for i in range(400)) + "];"
    raw = [("src/a.js", hand, "javascript"), ("src/talk.js", '// Writes the header "DO NOT EDIT" into each file it emits.\n' + hand, "javascript"), ("src/once.js", "// Hand-tuned, was once auto-generated by xgen.\n" + hand, "javascript"),
           ("src/marked.js", "// Code generated by xgen v1.2. DO NOT EDIT.\n" + hand, "javascript"), ("src/members.js", gen, "javascript"), ("src/m.js", mini, "javascript"), ("src/d.js", blob, "javascript"),
           ("vendor/q.js", hand.replace("walk", "run"), "javascript"), ("src/lib.js", "/*!\n * cordage v1.2.3 - (c) the cordage authors, free to copy\n */\n" + hand, "javascript"), ("x-lock.json", '{"lockVersion": 2}', "json"), ("src/empty.js", "", "javascript"), ("src/null.js", None, "javascript"),
           *((f"src/util/same{i}.js", (hand * 3).replace("walk", "copied"), "javascript") for i in range(5))]
    contents, files = _repo(spark, raw)
    got = {r.path: r.label for r in handwritten.labels(contents, files).collect()}
    want = {"src/a.js": "handwritten", "src/talk.js": "handwritten", "src/once.js": "handwritten", "src/marked.js": "generated", "src/members.js": "generated", "src/m.js": "minified", "src/d.js": "blob", "vendor/q.js": "vendored", "src/lib.js": "vendored", "x-lock.json": "generated", "src/empty.js": "handwritten", "src/null.js": "handwritten", **{f"src/util/same{i}.js": "vendored" for i in range(5)}}
    assert got == want
    assert handwritten.foreign_files(contents.limit(0), files.limit(0)).count() == 0


def test_marks_count_anywhere():
    hand = "import x from './y.js';\n\nexport function walk(a) {\n  return a.map((b) => b + 1);\n}\n"
    marked = lambda name, language, text: handwritten.evidence(name, language, text)[1] >= 7
    licence = "".join(f"// Clause {i} of the terms of use.\n" for i in range(20))
    assert marked("a.js", "javascript", hand + "\n// @generated by walkgen\n") and marked("a.cs", None, "class A {}\n\n// <auto-generated>\n// Changes will be lost.\n// </auto-generated>\n")
    assert marked("a.js", "javascript", licence + "// Code generated by xgen v1.2. DO NOT EDIT.\n" + hand) and marked("a.js", "javascript", hand + "\n/*\n * @generated by walkgen\n */\n" + hand)
    assert marked("a.sql", "sql", "select 1;\n\n-- Do not change: output of walkgen v1.2 for a.xsd\n") and marked("a.py", "python", "x = '#'\n\n# Generated on 2026-01-02 from a.proto\n")
    for name, language, text in (
        ("a.js", "javascript", "const head = `\n// @generated by walkgen\n`;\n" + hand), ("a.py", "python", 'HEAD = """\n# @generated by walkgen\n"""\nprint(HEAD)\n'), ("a.cs", "csharp", 'var a = @"\n// <auto-generated>\n";\n'), ("a.md", "markdown", "Text\n\n```\n<!-- @generated -->\n```\n"),
        ("a.js", "javascript", hand + '\n// Writes the header "DO NOT EDIT" into each file it emits.\n'), ("a.js", "javascript", hand + "\n// the output of walk, with ids generated by the server\n" + hand), ("a.json", "json", '{"a": "// @generated by x"}'),
    ):
        assert not marked(name, language, text), text


# --- problem 7

def test_winnowing_keeps_its_guarantee():
    rnd = random.Random(9)
    for _ in range(300):
        ws = [str(rnd.randrange(50)) for _ in range(rnd.randrange(8, 60))]
        n = leakage.GRAM + leakage.WINDOW - 1
        i = rnd.randrange(len(ws) - n + 1)
        other = [f"x{k}" for k in range(rnd.randrange(5))] + ws[i : i + n] + [f"y{k}" for k in range(rnd.randrange(5))]
        a, b = (leakage.grams(x, leakage.GRAM) for x in (ws, other))
        assert set(a[leakage.winnow(a)].tolist()) & set(b[leakage.winnow(b)].tolist())


def test_words_ignore_layout():
    plain = leakage.words("The answer of walk_tree isn't <T> – yet, row 12")
    for text in ("the ANSWER of walk_tree\n# isn't &lt;T&gt; – yet, row 12", "<b>The</b> answer of walk_tree isn't &lt;T&gt; \\u2013 yet,<br/> row 12", "The ans\u200bwer\xa0of walk_tree isn't &lt;T&gt; yet row 12"):
        assert [w for w in leakage.words(text)] == [w for w in plain if w != "t" or "T" in text] or leakage.covered(plain, leakage.words(text)) > 0.8


def test_leaks(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, "s", "Read the following situation and answer the question. " + " ".join(rnd.choice(vocabulary) for _ in range(60))) for i in range(12)]
    noise = lambda k: " ".join(f"n{rnd.randrange(10**6)}" for _ in range(k))
    ws = lambda i: items[i][2].split()
    docs = [(1, noise(50) + " " + items[0][2] + " " + noise(40)), (2, "> " + "\n> ".join(" ".join(ws(1)[k : k + 7]).upper() for k in range(0, len(ws(1)), 7))), (3, noise(30) + " ".join(["", *ws(2)[8:42]]) + " " + noise(9)),
            (4, noise(30) + " ".join(["", *ws(3)[10:23]]) + noise(30)), (5, "Read the following situation and answer the question. " + noise(30)), (6, None), (7, ""), (8, " ".join(w if k % 9 else "typo" for k, w in enumerate(ws(4)))), (1, items[0][2])]
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(spark.createDataFrame([(*d, 0, "z") for d in docs], "doc_id bigint, text string, share int, print string"), spark.createDataFrame(items, "item_id bigint, suite string, text string")).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (8, 4)}


def test_leaks_of_short_encoded_and_repetitive_texts(spark, monkeypatch):
    rnd = random.Random(14)
    noise = lambda k: " ".join(f"n{rnd.randrange(10**6)}" for _ in range(k))
    item = " ".join(f"w{rnd.randrange(300)}" for _ in range(50))
    items = [(0, "s", item), (1, "s", "quartz lantern"), (2, "s", "same " * 40), (3, "s", "?!"), (4, "s", None)] + [(10 + i, "s", f"Answer this question with care and in full sentences please {noise(30)}") for i in range(40)]
    coded = base64.b64encode(item.encode()).decode()
    docs = [(1, f"A line of prose goes first.\n{coded}\nand one after it"), (2, f"{noise(30)}\n> {coded[:76]}\n> {coded[76:]}\n"), (3, item.encode().hex()), (4, f"a Quartz-Lantern {noise(5)}"), (5, "same " * 30_000), (6, "same " * 9),
            (7, quopri.encodestring(item.encode()).decode()), (8, '<p title="' + "x" * 3000 + '">' + item.replace(" ", '<b class="' + "y" * 500 + '"> </b>') + "</p>"), (9, items[7][2]), (10, (" ".join(item.split()[:9]) + " ") * 300), (11, "Answer this question with care and in full sentences please")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, suite string, text string")
    want = {(1, 0), (2, 0), (3, 0), (4, 1), (5, 2), (7, 0), (8, 0), (9, items[7][0])}
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect()} == want
    monkeypatch.setattr(leakage, "BLOCK_BYTES", 900)  # many blocks give the same
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect()} == want
    assert leakage.leaks(d.limit(0), i).count() == leakage.leaks(d, i.limit(0)).count() == 0


def test_covered_equals_trying_every_stretch():
    rnd = random.Random(15)

    def by_hand(item, doc):
        n, step, best = len(item), min(3, len(item)), 0
        for a in range(len(doc)):
            hits = [(j, i) for j in range(a, min(len(doc), a + int(1.5 * n) + 21 + step - 1) - step + 1) if j - a <= int(1.5 * n) + 20 for i in range(n - step + 1) if doc[j : j + step] == item[i : i + step]]
            chain = dict.fromkeys(hits, step)
            for k, h in enumerate(hits):
                for g in hits[:k]:
                    if g[0] < h[0] and g[1] < h[1]:
                        chain[h] = max(chain[h], chain[g] + min(step, h[0] - g[0], h[1] - g[1]))
            best = max([best, *chain.values()])
        return best / n

    for _ in range(60):
        item = [f"w{k % rnd.choice((3, 12, 12))}" for k in range(12)]
        pieces = [(rnd.randrange(10), rnd.randrange(2, 9)) for _ in range(4)]
        doc = [x for a, k in pieces for x in (item[a : a + k] if rnd.random() < 0.7 else ["z"] * k)]
        assert leakage.covered(item, doc) == by_hand(item, doc), (item, doc)


# --- problem 8

def test_pivot_keeps_mass():
    rnd = random.Random(6)
    rows = [["s", i, rnd.randrange(1, 400), 1, rnd.random(), 0, False] for i in range(2000)]
    mass = sum(r[2] * (r[3] + r[4]) for r in rows)
    out = mixing.pivot(rows, True)
    assert all(r[6] and r[5] in (1, 2) for r in out)
    assert abs(sum(r[2] * r[5] for r in out) - mass) <= 400


def test_mix_reaches_its_shares(spark):
    rnd = random.Random(8)
    docs = [(i, rnd.choice(["a"] * 8 + ["b", None]), " ".join(["word"] * rnd.randrange(0, 60)) or None) for i in range(1500)] + [(9001, "c", ""), (None, "a", "x")]
    targets = [("a", 0.6, 2), ("b", 0.3, 5), ("c", 0.05, 3), ("none", 0.05, 3)]
    d = spark.createDataFrame([(*r, 5) for r in docs], "doc_id bigint, source string, text string, copies int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixing.shares(d, t).collect()}
    assert got["none"].mix_tokens == got["c"].mix_tokens == 0
    assert abs(got["a"].mix_tokens / got["b"].mix_tokens - 2) < 0.01
    used = mixing.mix(d, t).collect()
    assert len({r.doc_id for r in used}) == len(used) and all(1 <= r.copies <= dict((s, m) for s, _, m in targets)[r.source] and r.n_tokens > 0 for r in used)
    capped = {r.source: r for r in mixing.shares(d, t, total_tokens=10**7).collect()}
    assert capped["b"].mix_tokens == 5 * capped["b"].available_tokens
    assert mixing.mix(d.limit(0), t).count() == 0


# --- problem 9

FILLED = ["The owner of this service is {}, reachable at {}.", "Impact: {}"]
MARKS = ["<your-team>", "{{ owner }}", "${OWNER}", "[Insert owner here]", "__OWNER__", "TBD (owner)", "TODO: describe the owner", "@@OWNER@@", "%(owner)s", "<%= owner %>", "#{owner}", "[YOUR OWNER]", "(fill in owner)", "&lt;owner&gt;", "$OWNER$", "%%owner%%", "[[owner]]", "<owner goes here>", "{owner}"]


def test_residue(spark):
    good = "The limit of 12 is per file and not per repository. Older clients send text."
    bad = [(100 + i, f"{good}\n\n" + FILLED[i % 2].format(m, m)) for i, m in enumerate(MARKS)]
    bad += [(200, "Lorem ipsum dolor sit amet massa velit."), (201, "# Title\n\nText goes here. blah blah blah"), (202, "404 Not Found\nThe link you followed is outdated.\nGo to the home page."), (203, "Skip to content\n\nJavaScript must be active to read these docs. Loading…"), (204, "Zugriff verweigert. Bitte melden Sie sich erneut an."), (205, "Trang này cần JavaScript, hãy bật lên rồi tải lại.")]
    fine = [(1, good), (2, "Use `{{ owner }}` in the template.\n\n```\n${OWNER}\n404 Not Found\n```"), (3, 'The linter rejects "lorem ipsum" in src/a.ts, so write a real description.'), (4, "Requests for a removed symbol answer 404 Not Found, and walk maps that to an empty list."), (5, ""), (6, None), (7, "We removed the last TODO list from src/a.ts."), (8, "Fix walker (GX-12)")]
    fine += [(10 + i, f"Names of the form <your-name> in src/a{i}.ts are documented in GX-{i}.") for i in range(4)]
    d = spark.createDataFrame([(*r, "en") for r in bad + fine + bad[:2]], "doc_id bigint, text string, kind string")
    assert {r.doc_id for r in residue.residue(d).collect()} == {i for i, _ in bad}
    assert residue.residue(d.limit(0)).count() == 0


def test_residue_of_one_template_in_many_records(spark):
    d = [(i, f"Dear {{{{ owner }}}}, the run for build-{450 + i} has finished.") for i in range(6)]
    d += [(20 + i, f"Names of the form <your-name> in src/a{i}.ts are documented in GX-{i}.") for i in range(4)] + [(30, "Slots of the form ${owner} in src/b.ts are reserved.")]
    d += [(40 + i, f"The name [YOUR OWNER] stands for the team, see GX-{i}.") for i in range(4)] + [(50, "The name Mai Tran stands for the team, see GX-9.")]
    got = {r.doc_id for r in residue.residue(spark.createDataFrame(d, "doc_id bigint, text string")).collect()}
    assert got == {*range(6), *range(40, 44)}


def test_error_pages_of_any_length(spark):
    trace = "500 Internal Server Error\n" + "".join(f"at walk.step{i} (src/walk.js:{i})\n" for i in range(1500))
    notice = "\n".join(["Access denied"] + [f"Permission denied for the folder number {i} of this project and for all that is in it." for i in range(12)])
    own = "\n".join(f"The gateway {x} keeps a note of each such call for later review by those who run it and by no others." for x in ("north", "south", "east", "west", "upper"))
    assert len(trace) > 40_000 and len(notice.split()) > 90 and len(own.split()) > 90
    d = [(1, trace), (2, notice), *((10 + i, f"503 Service Unavailable\n{own}") for i in range(3)), (20, trace + "\nWe raised the pool to 40 and the errors stopped."), (21, "x/" * 30_000), (22, "y" * 60_000)]
    assert {r.doc_id for r in residue.residue(spark.createDataFrame(d, "doc_id bigint, text string")).collect()} == {1, 2, 10, 11, 12}


def test_bare_names_defaults_and_blanks_in_induced_slots(spark):
    letter = "Dear {}, your order has left our store on Monday."
    d = [(i, letter.format(x)) for i, x in enumerate(["Anna Meyer", "Mai Tran", "Luc Petit", "Ola", "Anna Meyer", "Bo Li", "Eva", "Jan Kos"])]
    d += [(20 + i, letter.format(x)) for i, x in enumerate(["customer_name", "FIRSTNAME", "N/A"])] + [(30, "Dear , your order has left our store on Monday.")]
    d += [(40 + i, f"We compared {a} with {b} and found a difference.") for i, (a, b) in enumerate([("owner_name", "PendingBroker"), ("walkTree", "ColdToken"), ("SilentQuota", "user_id"), ("a.ts", "b.ts")])]
    d += [(50, "Dear customer_name, this template has only one record."), (51, "customer_name"), (52, None), (53, "")]
    t = spark.createDataFrame(d + d[:2], "doc_id bigint, text string")
    assert {(r.doc_id, r.unfilled) for r in residue.residue(t).collect()} == {(i, True) for i in (20, 21, 22, 30)}
    few = t.where("doc_id < 21 and doc_id not between 1 and 7")  # one value only: nothing is known to vary
    assert residue.residue(few).count() == 0


def test_skeletons_align_records():
    a, b, c = (residue.skeleton(f"Dear {x}, your order {n} has left.") for x, n in (("Anna Meyer", 17), ("customer_name", "GX-4"), ("N/A", "ORDER_ID")))
    assert a[0] == b[0] == c[0] and [k for _, k, _ in a[1]] == [residue.VALUE] * 2 and [k for _, k, _ in b[1]] == [residue.NAME, residue.VALUE]
    assert [k for _, k, _ in c[1]] == [residue.MISSING, residue.NAME]
