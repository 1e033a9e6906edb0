"""Python 3. Logical lines are found first: marks stand for indents, dedents, line ends and string literals."""

from __future__ import annotations

import re
from bisect import bisect_right

from ..packrat import Grammar

INDENT, DEDENT, NEWLINE, STRING = "\x01", "\x02", "\x03", "\x04"

_KEYWORDS = "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"

TEXT = r"""
File = Stmt* ~/\Z/
NL ~= /\x03/
Id ~= /(?!(?:KEYWORDS|True|False|None)(?!\w))[^\W\d]\w*/
Stmt = Compound | Simple
Simple = Small (';' Small)* ';'? NL
Block = NL /\x01/ Stmt+ /\x02/ | Simple
Small = /(?:pass|break|continue)(?!\w)/ | 'return' Stars? | 'raise' (Expr ('from' Expr)?)? | 'del' Targets | /(?:global|nonlocal)(?!\w)/ Id (',' Id)*
    | 'assert' Expr (',' Expr)? | Import | TypeAlias | Assignment
Import ~= 'import' Dotted ('as' Id)? (',' Dotted ('as' Id)?)* | 'from' (/\.+/ Dotted? | Dotted) 'import' ('*' | '(' Names ','? ')' | Names)
Dotted ~= Id ('.' Id)*
Names ~= Id ('as' Id)? (',' Id ('as' Id)?)*
TypeAlias ~= /type(?=\s+[^\W\d])/ Id TypeParams? '=' Expr
Assignment ~= Stars (/(?:\/\/|\*\*|<<|>>|[+\-*\/%@&|^])=/ (Yield | Stars) | ':' Expr ('=' (Yield | Stars))? | ('=' !/=/ (Yield | Stars))*) | Yield ('=' (Yield | Stars))*
Stars = Star (',' Star)* ','?
Star ~= /\*(?!\*)/ Expr | Named
Targets = /\*(?!\*)/? Primary (',' /\*(?!\*)/? Primary)* ','?
Yield ~= 'yield' ('from' Expr | Stars)?

Compound ~= If | For | While | Try | With | Def | Match
If ~= 'if' Named ':' Block ('elif' Named ':' Block)* ('else' ':' Block)?
While ~= 'while' Named ':' Block ('else' ':' Block)?
For ~= 'async'? 'for' Targets 'in' Stars ':' Block ('else' ':' Block)?
Try ~= 'try' ':' Block (('except' '*'? (Expr (',' Expr)* ('as' Id)?)? ':' Block)+ ('else' ':' Block)? ('finally' ':' Block)? | 'finally' ':' Block)
With ~= 'async'? 'with' ('(' WithItem (',' WithItem)* ','? ')' ':' | WithItem (',' WithItem)* ':') Block
WithItem ~= Expr ('as' /\*(?!\*)/? Primary)?
Def ~= ('@' Named NL)* ('async'? 'def' Id TypeParams? '(' Params ')' ('->' Expr)? ':' Block | 'class' Id TypeParams? ('(' Args ')')? ':' Block)
TypeParams = '[' TypeParam (',' TypeParam)* ','? ']'
TypeParam ~= /\*{0,2}/ Id (':' Expr)? ('=' Expr)?
Params ~= (Param (',' Param)* ','?)?
Param ~= '/' | /\*\*?/ Id (':' /\*?/ Expr)? | '*' | Id (':' Expr)? ('=' Expr)?
Match ~= /match(?=[^\x03]*:\s*\x03\x01case(?!\w))/ Stars ':' NL /\x01/ ('case' Patterns ('if' Named)? ':' Block)+ /\x02/
Patterns ~= Pattern (',' Pattern)* ','?
Pattern = /\*(?!\*)/ Id | OrPat ('as' Id)?
OrPat ~= Pat ('|' Pat)*
Pat = Strs | /-?/ Num (/[+-]/ Num)? | /(?:None|True|False)(?!\w)/ | Dotted ('(' (PatArg (',' PatArg)* ','?)? ')')? | '[' Patterns? ']' | '(' Patterns? ')' | '{' (PatItem (',' PatItem)* ','?)? '}'
PatArg ~= Id '=' Pattern | Pattern
PatItem ~= '**' Id | Pat ':' Pattern

Named = Id ':=' Expr | Expr
Expr = Lambda | Binary ('if' Binary 'else' Expr)?
Lambda ~= 'lambda' LParams ':' Expr
LParams ~= (LParam (',' LParam)* ','?)?
LParam ~= '/' | /\*\*?/ Id | '*' | Id ('=' Expr)?
Binary = Unary (BinOp Unary)*
BinOp ~= /(?:and|or|in|is(?:\s+not(?!\w))?|not\s+in)(?!\w)|\/\/(?!=)|\*\*(?!=)|<<(?!=)|>>(?!=)|<=|>=|==|!=|[<>]|[+\-*\/%@&|^](?!=)/
Unary ~= /(?:not(?!\w)\s*|[+\-~]\s*)*/ 'await'? Primary
Primary = Atom (/\.(?!\.)/ Id | '(' Args ')' | '[' Slice (',' Slice)* ','? ']')*
Args = (Arg (',' Arg)* ','?)?
Arg = /\*\*?/ Expr | Id /=(?!=)/ Expr | Named CompFor?
Slice ~= /\*(?!\*)/ Expr | Named? ':' Expr? (':' Expr?)? | Named
CompFor = ('async'? 'for' Targets 'in' Binary ('if' CompIf)*)+
CompIf ~= Id ':=' Binary | Lambda | Binary
Strs ~= /\x04/+
Num ~= /(?:0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?)(?!\w)/
Atom = Id | Strs | Num | '(' (Yield | Star (CompFor | (',' Star)* ','?))? ')' | '[' (Star (CompFor | (',' Star)* ','?))? ']' | Dict | /(?:True|False|None)(?!\w)/ | '...'
Dict ~= '{' (Item (CompFor | (',' Item)* ','?) | Star (CompFor | (',' Star)* ','?))? '}'
Item ~= '**' Expr | Expr ':' Expr
"""

_LEX = re.compile(
    r"""(?P<str>(?i:[rbuft]{0,2})(?:'{3}(?:[^\\']|\\[\s\S]|'(?!''))*+'{3}|"{3}(?:[^\\"]|\\[\s\S]|"(?!""))*+"{3}|'(?!'')(?:[^\\'\n\r]|\\(?:\r\n|[\s\S]))*+'|"(?!"")(?:[^\\"\n\r]|\\(?:\r\n|[\s\S]))*+"|''(?!')|""(?!")))"""
    r"""|(?P<bad>["'\x00-\x08])|(?P<name>[\w.]+)|(?P<skip>[ \t\f]+|\#[^\n\r]*|\\(?:\r\n|\n|\r))|(?P<nl>\r\n|\n|\r)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<op>[\s\S])"""
)


def logical_lines(text: str) -> tuple[str, list[int], list[int], int]:
    """The marked text, where its pieces begin in it and in text, and where it breaks off (-1: nowhere)."""
    out: list[str] = []
    here: list[int] = []
    there: list[int] = []
    n = depth = 0
    levels = [0]
    at, end, start = 1 if text.startswith("﻿") else 0, len(text), True

    def put(piece: str, source: int) -> None:
        nonlocal n
        out.append(piece)
        here.append(n)
        there.append(source)
        n += len(piece)

    while at < end:
        if start:
            m = re.compile(r"[ \t\f]*").match(text, at)
            k = m.end()
            if k >= end:
                break
            if text[k] in "#\r\n":
                m = re.compile(r"[^\n\r]*(?:\r\n|\n|\r)?").match(text, k)
                at = m.end()
                continue
            width = len(m.group().expandtabs(8))
            if width > levels[-1]:
                levels.append(width)
                put(INDENT, k)
            while width < levels[-1]:
                levels.pop()
                put(DEDENT, k)
            if width != levels[-1]:
                return "".join(out), here, there, k
            start, at = False, k
        m = _LEX.match(text, at)
        kind, piece = m.lastgroup, m.group()
        if kind == "str":
            put(STRING, at)
        elif kind == "skip":
            put(" ", at)
        elif kind == "nl":
            if depth:
                put(" ", at)
            else:
                put(NEWLINE, at)
                start = True
        elif kind == "bad":
            return "".join(out), here, there, at
        else:
            depth += (kind == "open") - (kind == "close")
            depth = max(depth, 0)
            put(piece, at)
        at = m.end()
    if not start:
        put(NEWLINE, end)
    while len(levels) > 1:
        levels.pop()
        put(DEDENT, end)
    return "".join(out), here, there, -1


class Python:
    def __init__(self):
        self.grammar = Grammar(TEXT.replace("KEYWORDS", _KEYWORDS.replace(" ", "|")), r"[ ]++")

    def accepts(self, text: str) -> bool:
        marked, _, _, broken = logical_lines(text)
        return broken < 0 and self.grammar.accepts(marked)

    def parse(self, text: str) -> int:
        marked, here, there, broken = logical_lines(text)
        if broken >= 0:
            return broken
        k = self.grammar.parse(marked)
        if k < 0:
            return -1
        i = bisect_right(here, k) - 1
        return there[i] + (k - here[i]) if 0 <= i < len(there) else len(text)


def build(language: str) -> Python:
    return Python()
