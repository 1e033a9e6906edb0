"""Packrat parsers from parsing-expression grammars given as text.

A grammar is a list of lines ``Name = expression``; lines that start with white space continue the last one.

    a b         sequence                 a | b      ordered choice (the first that matches wins)
    a* a+ a?    greedy repetition        &a !a      lookahead
    (a)         grouping                 @name      predicate of the grammar's Python side: (text, position) -> bool
    'x'         the text x, then white space; a word must end there
    /x/         the regular expression x, then white space     ~/x/    the same without white space

White space is the rule named in ``skip``, a regular expression. Every rule keeps its result by position
(packrat), so each is tried once per position and time is linear in the text; ``Name ~= expression`` marks a
rule that is expanded where it is used. A text is valid only if the rule File consumes all of it. The grammar is
compiled to Python functions: one set for speed, and one that also notes the furthest position at which any
terminal failed, used for texts that are invalid. The fast set tries an expression only if the next character can
begin it, as far as that follows from its terminals.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser

_TOKEN = re.compile(r"\s*(?:(~?/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/)|('(?:[^'\\]|\\.)+')|(@?\w+)|([()|*+?&!]))")


#: Stand for any character beyond ASCII, and for the end of the text.
OTHER, END = "\x80", "\x81"
_ASCII = [chr(i) for i in range(128)]
_CATEGORY = {op.CATEGORY_DIGIT: r"\d", op.CATEGORY_NOT_DIGIT: r"\D", op.CATEGORY_SPACE: r"\s", op.CATEGORY_NOT_SPACE: r"\S", op.CATEGORY_WORD: r"\w", op.CATEGORY_NOT_WORD: r"\W"}


def _begins(tree, fold: bool) -> tuple[set[str] | None, bool]:
    """The characters that can begin a match of a parsed regular expression (None: any), and whether it may be empty."""
    chars: set[str] = set()
    for kind, x in tree:
        empty = False
        if kind is op.LITERAL:
            c = chr(x)
            found = {y if y < OTHER else OTHER for y in ((c.lower(), c.upper(), OTHER) if fold else (c,))}
        elif kind is op.IN:
            found = _class(x, fold)
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue
        elif kind is op.FAILURE:
            return set(), False
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            found, empty = _begins(x[2], fold)
            empty |= x[0] == 0
        elif kind is op.SUBPATTERN:
            found, empty = _begins(x[3], fold)
        elif kind is op.ATOMIC_GROUP:
            found, empty = _begins(x, fold)
        elif kind is op.BRANCH:
            each = [_begins(y, fold) for y in x[1]]
            found = None if any(y is None for y, _ in each) else set().union(*(y for y, _ in each))
            empty = any(e for _, e in each)
        else:
            return None, True
        if found is None:
            return None, True
        chars |= found
        if not empty:
            return chars, False
    return chars, True


def _class(parts: list, fold: bool) -> set[str]:
    found, negated = {OTHER}, False
    for kind, x in parts:
        if kind is op.NEGATE:
            negated = True
        elif kind is op.LITERAL:
            found |= {chr(x).lower(), chr(x).upper()} if fold else {chr(x)}
        elif kind is op.RANGE:
            found |= {y for c in map(chr, range(x[0], min(x[1], 127) + 1)) for y in ((c.lower(), c.upper()) if fold else (c,))}
        elif kind is op.CATEGORY:
            found |= {c for c in _ASCII if re.match(_CATEGORY[x], c)}
    return {c for c in _ASCII if c not in found} | {OTHER} if negated else {c for c in found if c < OTHER} | {OTHER}


class Grammar:
    def __init__(self, text: str, skip: str, predicates: dict | None = None, flags: int = 0, alternatives: dict[str, str] | None = None):
        self.skip, self.flags, self.predicates = skip, flags, predicates or {}
        self.rules: dict[str, tuple] = {}
        self.inline: set[str] = set()
        for k, v in (alternatives or {}).items():
            text = text.replace(k, v)
        joined: list[str] = []
        for line in text.split("\n"):
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            if line[0].isspace():
                joined[-1] += " " + line.strip()
            else:
                joined.append(line)
        for line in joined:
            name, mark, body = re.match(r"(\w+)\s*(~?=)\s*(.*)", line, re.S).groups()
            if name in self.rules:
                raise ValueError(f"rule {name} is given twice")
            if mark == "~=":
                self.inline.add(name)
            self.rules[name] = self._parse(body)
        for name in list(self.inline):  # a rule that leads to itself can't be expanded in place
            seen, todo = set(), self._refs(self.rules[name])
            while todo:
                n = todo.pop()
                if n in self.inline and n not in seen:
                    seen.add(n)
                    todo |= self._refs(self.rules[n])
            if name in seen:
                self.inline.discard(name)
        self.terminals: dict[str, str] = {}
        self.sets: dict[frozenset, str] = {}
        self._known: dict[str, tuple[frozenset | None, bool]] = dict.fromkeys(self.rules, (frozenset(), False))
        before = None
        while before != self._known:  # grows to the least that all rules agree on
            before = dict(self._known)
            for name, rule in self.rules.items():
                self._known[name] = self._first(rule)
        self._fast, self._slow = self._compile(False), None

    def _refs(self, x: tuple) -> set[str]:
        if x[0] == "rule":
            if x[1] not in self.rules:
                raise ValueError(f"no rule {x[1]}")
            return {x[1]}
        if x[0] in ("seq", "or"):
            return set().union(*map(self._refs, x[1]))
        return self._refs(x[1]) if x[0] in ("opt", "many", "some", "and", "not") else set()

    def _parse(self, body: str) -> tuple:
        tokens, at = [], 0
        body = body.rstrip()
        while at < len(body):
            m = _TOKEN.match(body, at)
            if not m:
                raise ValueError(f"bad grammar text at {body[at:at + 40]!r}")
            tokens.append((m.lastindex, m.group(m.lastindex)))
            at = m.end()
        tokens.append((0, ""))
        pos = 0

        def choice() -> tuple:
            nonlocal pos
            options = [sequence()]
            while tokens[pos][1] == "|" and tokens[pos][0] == 4:
                pos += 1
                options.append(sequence())
            return options[0] if len(options) == 1 else ("or", options)

        def sequence() -> tuple:
            nonlocal pos
            parts = []
            while tokens[pos][0] and not (tokens[pos][0] == 4 and tokens[pos][1] in "|)"):
                parts.append(prefixed())
            return parts[0] if len(parts) == 1 else ("seq", parts)

        def prefixed() -> tuple:
            nonlocal pos
            kind, t = tokens[pos]
            if kind == 4 and t in "&!":
                pos += 1
                return ("and" if t == "&" else "not", prefixed())
            pos += 1
            if kind == 4 and t == "(":
                x = choice()
                if tokens[pos][1] != ")":
                    raise ValueError(f"missing ) in {body!r}")
                pos += 1
            elif kind == 1:
                x = ("re", t[2:-1].replace("\\/", "/"), False) if t[0] == "~" else ("re", t[1:-1].replace("\\/", "/"), True)
            elif kind == 2:
                lit = t[1:-1].replace("\\'", "'").replace("\\\\", "\\")
                x = ("re", re.escape(lit) + (r"(?![\w$])" if re.match(r"\w", lit[-1]) else ""), True)
            elif kind == 3:
                x = ("pred", t[1:]) if t[0] == "@" else ("rule", t)
            else:
                raise ValueError(f"unexpected {t!r} in {body!r}")
            while tokens[pos][0] == 4 and tokens[pos][1] in "*+?":
                x = ({"*": "many", "+": "some", "?": "opt"}[tokens[pos][1]], x)
                pos += 1
            return x

        x = choice()
        if tokens[pos][0]:
            raise ValueError(f"unexpected {tokens[pos][1]!r} in {body!r}")
        return x

    def _terminal(self, pattern: str, spaced: bool) -> str:
        full = f"(?:{pattern})(?:{self.skip})*+" if spaced else pattern
        return self.terminals.setdefault(full, f"T{len(self.terminals)}")

    def _first(self, x: tuple) -> tuple[frozenset | None, bool]:
        """The characters that can begin what x consumes (None: not known), and whether x may consume nothing."""
        kind = x[0]
        if kind == "re":
            chars, empty = _begins(_parser.parse(x[1] + (f"(?:{self.skip})*" if x[2] else ""), self.flags), bool(self.flags & re.I))
            return None if chars is None else frozenset(chars), chars is None or empty
        if kind == "rule":
            return self._known[x[1]]
        if kind in ("seq", "or"):
            each = [self._first(y) for y in x[1]]
            if kind == "or":
                return None if any(f is None for f, _ in each) else frozenset().union(*(f for f, _ in each)), any(e for _, e in each)
            chars: frozenset = frozenset()
            for f, empty in each:
                if f is None:
                    return None, True
                chars |= f
                if not empty:
                    return chars, False
            return chars, True
        if kind in ("opt", "many"):
            return self._first(x[1])[0], True
        return self._first(x[1]) if kind == "some" else (frozenset(), True)

    def _guard(self, x: tuple, a: str, b: str, ind: str, out: list[str]) -> str:
        """Code that fails at once unless the next character can begin x, if that is known; the indent to go on with."""
        chars, empty = self._first(x)
        if chars is None or empty or len(chars) > 110:
            return ind
        out += [f"{ind}{b} = -1", f"{ind}if u[{a}] in {self.sets.setdefault(chars, f'S{len(self.sets)}')}:"]
        return ind + "    "

    def _compile(self, track: bool) -> dict:
        """Each expression becomes code that goes from position variable a to b and sets b = -1 on failure."""
        out: list[str] = []
        fresh = iter(range(10**9))

        def emit(x: tuple, a: str, b: str, ind: str) -> None:
            kind = x[0]
            if kind == "re":
                t = self._terminal(x[1], x[2])
                out.append(f"{ind}m = {t}(s, {a})")
                if track and x[2]:
                    out.append(f"{ind}if m: {b} = m.end()")
                    out.append(f"{ind}else:")
                    out.append(f"{ind}    if {a} > far[0]: far[0] = {a}")
                    out.append(f"{ind}    {b} = -1")
                else:
                    out.append(f"{ind}{b} = m.end() if m else -1")
            elif kind == "pred":
                out.append(f"{ind}{b} = {a} if P_{x[1]}(s, {a}) else -1")
            elif kind == "rule":
                if x[1] not in self.rules:
                    raise ValueError(f"no rule {x[1]}")
                if x[1] in self.inline:
                    emit(self.rules[x[1]], a, b, ind)
                else:
                    out.append(f"{ind}{b} = G_{x[1]}.get({a})")
                    out.append(f"{ind}if {b} is None: {b} = R_{x[1]}({a})")
            elif kind == "seq":
                if not x[1]:
                    out.append(f"{ind}{b} = {a}")
                    return
                cur = a
                for i, part in enumerate(x[1]):
                    last = i == len(x[1]) - 1
                    nxt = b if last else f"v{next(fresh)}"
                    emit(part, cur, nxt, ind)
                    if not last:
                        out.append(f"{ind}if {nxt} < 0: {b} = -1")
                        out.append(f"{ind}else:")
                        ind += "    "
                    cur = nxt
            elif kind == "or":
                for i, part in enumerate(x[1]):
                    emit(part, a, b, ind if track else self._guard(part, a, b, ind, out))
                    if i < len(x[1]) - 1:
                        out.append(f"{ind}if {b} < 0:")
                        ind += "    "
            elif kind == "opt":
                emit(x[1], a, b, ind if track else self._guard(x[1], a, b, ind, out))
                out.append(f"{ind}if {b} < 0: {b} = {a}")
            elif kind in ("many", "some"):
                c, d = f"v{next(fresh)}", f"v{next(fresh)}"
                out.append(f"{ind}{c} = {a}")
                out.append(f"{ind}while True:")
                emit(x[1], c, d, ind + "    " if track else self._guard(x[1], c, d, ind + "    ", out))
                out.append(f"{ind}    if {d} <= {c}: break")
                out.append(f"{ind}    {c} = {d}")
                out.append(f"{ind}{b} = {c}" if kind == "many" else f"{ind}{b} = {c} if {c} > {a} else -1")
            elif kind in ("and", "not"):
                c = f"v{next(fresh)}"
                emit(x[1], a, c, ind)
                out.append(f"{ind}{b} = {a} if {c} {'>=' if kind == 'and' else '<'} 0 else -1")

        names = [n for n in self.rules if n not in self.inline]
        out.append("def make(s, far):")
        if not track:
            out.append("    u = (s if s.isascii() else BEYOND(OTHER, s)) + END")
        for n in names:
            out.append(f"    M_{n} = {{}}; G_{n} = M_{n}")
        for n in names:
            out.append(f"    def R_{n}(p):")
            out.append(f"        M_{n}[p] = -1")
            emit(self.rules[n], "p", "q", "        ")
            out.append(f"        M_{n}[p] = q")
            out.append("        return q")
        out.append("    return R_File")
        scope = {f"P_{k}": v for k, v in self.predicates.items()}
        scope |= {name: re.compile(p, self.flags).match for p, name in self.terminals.items()}
        scope |= {name: chars for chars, name in self.sets.items()} | {"BEYOND": re.compile(r"[^\x00-\x7f]").sub, "OTHER": OTHER, "END": END}
        exec("\n".join(out), scope)  # noqa: S102 - text made from the grammar only
        return scope

    def accepts(self, text: str) -> bool:
        """Whether the whole text is of the grammar."""
        return self._fast["make"](text, [0])(0) == len(text)

    def parse(self, text: str) -> int:
        """-1 if the whole text is of the grammar, else the furthest position at which a terminal failed."""
        if self.accepts(text):
            return -1
        if self._slow is None:
            self._slow = self._compile(True)
        far = [0]
        end = self._slow["make"](text, far)(0)
        return max(far[0], end)
