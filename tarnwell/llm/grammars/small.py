"""JSON (strict), CSS and Protocol Buffers."""

from __future__ import annotations

from ..packrat import Grammar

JSON = r"""
File = ~/﻿?[ \t\r\n]*/ Value ~/\Z/
Value = Str | Num | Obj | Arr | /(?:true|false|null)(?!\w)/
Str ~= /"(?:[^"\\\x00-\x1f]|\\(?:["\\\/bfnrt]|u[0-9a-fA-F]{4}))*+"/
Num ~= /-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])/
Obj = '{' (Str ':' Value (',' Str ':' Value)*)? '}'
Arr = '[' (Value (',' Value)*)? ']'
"""

CSS_SKIP = r"[\s﻿]++|/\*(?:[^*]++|\*(?!/))*+\*/|<!--|-->"
CSS = r"""
File = ~/(?:SKIP)*+/ Node* ~/\Z/
Node ~= AtRule | Rule | ';'
AtRule = /@[\w-]+/ Piece* (';' | Block | &/\}|\Z/)
Rule = Selector (',' Selector)* Block
Selector = Sel+
Sel ~= /[>+~|*&]|::?[\w-]+|[.#]?-?(?:[^\W\d]|_|\\.|--)(?:[\w-]|\\.)*|\d[\d.]*%|#[\w-]+|\.\d*/ | '[' Str? (Str | /[^"'\[\]{}]/)* ']' | '(' Inner* ')'
Block = '{' Item* '}'
Item ~= ';' | AtRule | Custom (';' | &/\}/) | Decl (';' | &/\}/) | Rule
Decl = /[*_]?(?:--[\w-]*|-?(?:[^\W\d]|\\.)(?:[\w-]|\\.)*)(?=\s*:|\s*\/\*)/ ':' Piece* Block?
Custom ~= /--[\w-]*(?=\s*:)/ ':' Any*
Any = Piece | '{' (Any | ';')* '}'
Str ~= /"(?:[^"\\\n\r\f]|\\(?:\r\n|[\s\S]))*+"|'(?:[^'\\\n\r\f]|\\(?:\r\n|[\s\S]))*+'/
Url ~= /url\(\s*(?!["'])(?:[^"'()\\\s]|\\.)*\s*\)/
Piece = Url | Str | /(?:[^\s"'(){}\[\];@\/]|@(?=[\w-])|\\.)+|\/(?!\*)/ | '(' Inner* ')' | '[' Inner* ']'
Inner = Url | Str | /(?:[^\s"'(){}\[\]\/\\]|\\.)+|\/(?!\*)/ | '(' Inner* ')' | '[' Inner* ']'
"""

PROTO_SKIP = r"[\s﻿]++|//[^\n\r]*+|/\*(?:[^*]++|\*(?!/))*+\*/"
PROTO = r"""
File = ~/(?:SKIP)*+/ (/(?:syntax|edition)(?!\w)/ '=' Str ';')? Top* ~/\Z/
Top ~= ';' | 'import' /(?:weak|public)(?!\w)/? Str ';' | 'package' Full ';' | Option | Message | Enum | Service | Extend
Id ~= /[A-Za-z_]\w*/
Full ~= /\.?[A-Za-z_]\w*(?:\s*\.\s*[A-Za-z_]\w*)*/
Int ~= /-?(?:0[xX][0-9a-fA-F]+|\d+)(?!\w)/
Str ~= (/"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'/)+
Const = Str | /[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|0[xX][0-9a-fA-F]+|inf|nan)(?!\w)/ | Full | Aggregate
Aggregate = '{' ((Id | '[' Full ('/' Full)? ']') (':' (Const | List) | Aggregate) /[,;]/?)* '}'
List ~= '[' ((Const) (',' Const)*)? ']'
OptName ~= (Id | '(' Full ')') (~/\s*\.\s*/ (Full | '(' Full ')'))*
Option = 'option' OptName '=' Const ';'
Opts ~= '[' OptName '=' Const (',' OptName '=' Const)* ']'
Message = 'message' Id '{' Part* '}'
Part ~= ';' | Message | Enum | Option | Extend | Oneof | MapField | Reserved | Group | Field
Field = /(?:repeated|optional|required)(?=\s)/? !/(?:message|enum|option|reserved|extensions)(?=\s+[^=]*[;{])/ Full Id '=' Int Opts? ';'
Group = /(?:repeated|optional|required)(?=\s)/ 'group' Id '=' Int Opts? '{' Part* '}'
MapField ~= 'map' '<' Full ',' Full '>' Id '=' Int Opts? ';'
Oneof ~= 'oneof' Id '{' (Option | Field | ';')* '}'
Reserved ~= /(?:reserved|extensions)(?!\w)/ ((Range (',' Range)*) | Str (',' Str)* | Id (',' Id)*) Opts? ';'
Range ~= Int ('to' (Int | 'max'))?
Extend = 'extend' Full '{' (Group | Field | ';')* '}'
Enum = 'enum' Id '{' (Option | Reserved | Id '=' Int Opts? ';' | ';')* '}'
Service = 'service' Id '{' (Option | Rpc | ';')* '}'
Rpc = 'rpc' Id '(' 'stream'? Full ')' 'returns' '(' 'stream'? Full ')' (';' | '{' (Option | ';')* '}' ';'?)
"""


def build(language: str) -> Grammar:
    if language == "json":
        return Grammar(JSON, r"[ \t\r\n]++")
    text, skip = (CSS, CSS_SKIP) if language == "css" else (PROTO, PROTO_SKIP)
    return Grammar(text.replace("SKIP", skip.replace("/", "\\/")), skip)
