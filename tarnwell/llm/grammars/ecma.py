"""JavaScript modules and TypeScript. One grammar; the rules of types never match in JavaScript."""

from __future__ import annotations

import re

from ..packrat import Grammar

SKIP = r"[\s﻿]++|//[^\n\r]*+|/\*(?:[^*]++|\*(?!/))*+\*/"
_IN_TEXT = SKIP.replace("/", "\\/")
_ONLY_SPACE = re.compile(rf"(?:[^\n]*\*/)?(?:{SKIP})*+\Z")

_RESERVED = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum"
ID = rf"(?:(?!(?:{'|'.join(_RESERVED.split())})(?![\w$]))(?:[^\W\d]|\$)[\w$]*)"


def newline_before(s: str, p: int) -> bool:
    i = max(s.rfind("\n", 0, p), s.rfind("\r", 0, p))
    return i >= 0 and _ONLY_SPACE.match(s[i + 1 : p]) is not None


BASE = rf"""
File = ~/﻿?(?:#![^\n]*)?/ Skip Item* ~/\Z/
Skip ~= ~/(?:{_IN_TEXT})*+/
Item ~= Import | Export | Stmt
EOS ~= ';' | &/\}}|\Z/ | @nl

Id ~= /{ID}/
Name ~= /(?:[^\W\d]|\$)[\w$]*/
Str ~= /"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*+"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*+'/
Num ~= /(?:0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)(?![\w$])/
Regex ~= /\/(?![*\/])(?:[^\\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*+\])++\/[a-z]*(?![\w$])/
Template = ~/`(?:[^`\\$]|\\[\s\S]|\$(?!\{{))*+/ (~/\$\{{/ Skip Expr ~/\}}(?:[^`\\$]|\\[\s\S]|\$(?!\{{))*+/)* /`/

Import = 'import' !/[(.]/ (TypeKw? ImportClause 'from' Str With? EOS | Str With? EOS | ImportEq)
ImportClause ~= NS | Named | Id (',' (NS | Named))?
NS ~= '*' 'as' Id
Named ~= '{{' (Spec (',' Spec)* ','?)? '}}'
Spec = TypeKw Name ('as' Name)? | (Name | Str) ('as' (Name | Str))?
With ~= /(?:with|assert)(?![\w$])/ Object
Export = Decorator* 'export' (
    'default' (FuncDecl | ClassDecl | IfaceDecl | Assign EOS)
    | TypeKw? '*' ('as' (Name | Str))? 'from' Str With? EOS
    | TypeKw? Named ('from' Str With?)? EOS
    | VarStmt | FuncDecl | ClassDecl | TsDecl | ExportEq)

Block = '{{' Stmt* '}}'
Stmt = VarStmt | Return | If | ExprStart | FuncDecl | ClassDecl | For | While | Do | Try | Switch | Throw | Jump | TsDecl | Labelled | Block | ';' | 'debugger' EOS | ExprStmt
ExprStart ~= !/(?:function|class|async|let|type|interface|enum|namespace|module|declare|abstract|global)(?![\w$])/ Postfix ~/=(?![=>])/ Skip Assign (',' Assign)* EOS
VarStmt = VarHead EOS
VarHead ~= /(?:const(?!\s+enum\b)|var|let|using)(?![\w$])/ Binding (',' Binding)*
Binding = Target NonNull? TypeAnn? ('=' Assign)?
Target = ArrPat | ObjPat | Id
ArrPat ~= '[' (','* Elem)* ','* ']'
Elem = '...' Target | Target ('=' Assign)? (',' | &/\]/)
ObjPat ~= '{{' (PatProp (',' PatProp)* ','?)? '}}'
PatProp = '...' Target | Key ':' Target ('=' Assign)? | Id ('=' Assign)?

Return ~= 'return' (!@nl !/;|\}}/ Expr)? EOS
If ~= 'if' '(' Expr ')' Stmt ('else' Stmt)?
For ~= 'for' 'await'? '(' (
    /(?:const|var|let|using)(?![\w$])/ Target TypeAnn? /(?:of|in)(?![\w$])/ Expr
    | VarHead ';' Expr? ';' Expr?
    | Postfix /(?:of|in)(?![\w$])/ Expr
    | Expr? ';' Expr? ';' Expr?) ')' Stmt
While ~= 'while' '(' Expr ')' Stmt
Do ~= 'do' Stmt 'while' '(' Expr ')' ';'?
Try ~= 'try' Block ('catch' ('(' Target TypeAnn? ')')? Block ('finally' Block)? | 'finally' Block)
Switch ~= 'switch' '(' Expr ')' '{{' (('case' Expr | 'default') ':' Stmt*)* '}}'
Throw ~= 'throw' !@nl Expr EOS
Jump ~= /(?:break|continue)(?![\w$])/ (!@nl Id)? EOS
Labelled ~= Id ':' Stmt
ExprStmt ~= !/(?:function|class)(?![\w$])/ Expr EOS

FuncDecl = 'async'? 'function' '*'? Id Sig (Block | NoBody)
Sig ~= TypeParams? '(' Params ')' RetType?
Params = (Param (',' Param)* ','?)?
Param = Decorator* Access* ('...' Target TypeAnn? | Target Optional? TypeAnn? ('=' Assign)? | This)
ClassDecl = Decorator* Abstract* 'class' (!/(?:extends|implements)(?![\w$])/ Id)? TypeParams? ('extends' Postfix TypeArgs?)? Implements? '{{' Member* '}}'
Member = ';' | 'static' Block | Decorator* Access* (
    ('async' !@nl)? '*'? MemberName Mark? Sig (Block | NoBody)
    | /(?:get|set)(?![\w$])/ MemberName Sig (Block | NoBody)
    | MemberName Mark? TypeAnn? ('=' Assign)? EOS
    | IndexSig EOS)
Access ~= /static(?=\s+[\w$#\[*"'])/ | TsAccess
MemberName = '[' Expr ']' | /#?(?:[^\W\d]|\$)[\w$]*/ | Str | Num
Decorator = '@' ('(' Expr ')' | Name (~/\./ Skip Name)*) ('(' Args ')')*

Expr = Assign (',' Assign)*
Assign = Arrow | Yield | Postfix /(?:=(?![=>])|(?:\*\*|<<|>>>?|&&|\|\||\?\?|[+\-*\/%&|^])=)/ Assign | Cond
Arrow ~= &/(?:async(?![\w$])\s*)?(?:[(<]|(?:[^\W\d]|\$)[\w$]*\s*=>)/ ('async' !@nl)? (Id | TypeParams? '(' Params ')' RetType?) !@nl '=>' (Block | Assign)
Yield ~= 'yield' ('*'? !@nl Assign)?
Cond = Binary ('?' Assign ':' Assign)?
Binary ~= Unary (/(?:===|!==|==|!=|<<|>>>|>>|<=|>=|<|>|&&|\|\||\?\?|\*\*|[+\-*\/%&|^])(?!=)|(?:instanceof|in)(?![\w$])/ Unary | AsOp)*
Unary = /(?:(?:delete|void|typeof|await)(?![\w$])|\+\+|--|[+\-!~])/ Unary | Cast Unary | Postfix (!@nl /\+\+|--/)?
Postfix = New Suffix* | Primary Suffix*
New = 'new' (~/\./ Skip Name | (New | Primary) NewSuffix* TypeArgs? ('(' Args ')')?)
NewSuffix ~= ~/\.(?![.\d])/ Skip /#?(?:[^\W\d]|\$)[\w$]*/ | '[' Expr ']'
Suffix ~= ~/\.(?![.\d])/ Skip /#?(?:[^\W\d]|\$)[\w$]*/ | '(' Args ')' | '[' Expr ']' | ~/\?\.(?!\d)/ Skip ('(' Args ')' | '[' Expr ']' | /#?(?:[^\W\d]|\$)[\w$]*/) | Template | Bang | TypeArgs &/[(`]/
Args = ('...'? Assign (',' '...'? Assign)* ','?)?
Primary = FuncExpr | Id | Str | Num | Template | '(' Expr ')' | Array | Object | /(?:this|super|null|true|false)(?![\w$])/ | Regex | ClassDecl | ImportCall | /#(?:[^\W\d]|\$)[\w$]*(?=\s+in\b)/
ImportCall ~= 'import' ('(' Args ')' | ~/\./ Skip Name)
FuncExpr ~= ('async' !@nl)? 'function' '*'? Id? Sig Block
Array ~= '[' (','* '...'? Assign (',' | &/\]/))* ','* ']'
Object ~= '{{' (Prop (',' Prop)* ','?)? '}}'
Prop = '...' Assign | Key ':' Assign | ('async' !@nl)? '*'? Key Sig Block | /(?:get|set)(?![\w$])/ Key Sig Block | Id ('=' Assign)?
Key ~= Name | Str | Num | '[' Assign ']'
"""

NEVER = "TypeKw ImportEq ExportEq IfaceDecl TsDecl NonNull TypeAnn RetType TypeParams TypeArgs Implements Abstract NoBody Optional This Mark IndexSig TsAccess AsOp Cast Bang"

TYPES = rf"""
TypeKw ~= /type(?=\s*[{{*]|\s+(?!from\b)[\w$])/
ImportEq ~= Id '=' ('require' '(' Str ')' | Name (~/\./ Skip Name)*) EOS
ExportEq ~= '=' Expr EOS | 'as' 'namespace' Id EOS | 'import' Id '=' Expr EOS
NonNull ~= '!'
Bang ~= !@nl ~/!(?!=)/ Skip
Mark ~= /[?!]/
Optional ~= '?'
This ~= 'this' TypeAnn
NoBody ~= EOS
Cast ~= '<' Type '>'
AsOp ~= !@nl /(?:as|satisfies)(?![\w$])/ Type
TsAccess ~= /(?:public|private|protected|readonly|abstract|declare|override|accessor|static)(?=\s+[\w$#\[*"'])/
Abstract ~= /(?:abstract|declare)(?![\w$])/
IndexSig ~= '[' Id ':' Type ']' TypeAnn
TypeAnn = ':' Type
RetType = ':' (/asserts(?=\s+\w)/? (Id | 'this') /is(?![\w$])/ Type | /asserts(?=\s+\w)/ (Id | 'this') | Type)
Implements ~= 'implements' Type (',' Type)*
TypeParams = '<' TParam (',' TParam)* ','? '>'
TParam ~= /(?:const|in|out)(?=\s+\w)/* Id ('extends' Type)? ('=' Type)?
TypeArgs = '<' Type (',' Type)* ','? ~/>/ Skip
TsDecl ~= 'declare' /global(?![\w$])/ Block | /declare(?=\s+[\w$])/? (IfaceDecl | TypeAlias | Enum | Namespace | ClassDecl | FuncDecl | VarStmt)
IfaceDecl ~= 'interface' Id TypeParams? ('extends' Type (',' Type)*)? ObjType
TypeAlias ~= /type(?=\s+[\w$])/ Id TypeParams? '=' Type EOS
Enum ~= 'const'? 'enum' Id '{{' (Key ('=' Assign)? (',' Key ('=' Assign)?)* ','?)? '}}'
Namespace ~= /(?:namespace|module)(?=\s+[\w$"'])/ (Str | Name (~/\./ Skip Name)*) '{{' Item* '}}'
Type = FuncType | Union ('extends' Union '?' Type ':' Type)?
FuncType ~= 'abstract'? 'new'? TypeParams? '(' Params ')' '=>' (RetPred | Type)
RetPred ~= /asserts(?=\s+\w)/? (Id | 'this') /is(?![\w$])/ Type
Union = '|'? Inter (/\|(?!\|)/ Inter)*
Inter ~= '&'? TUnary ('&' TUnary)*
TUnary = /(?:keyof|unique|readonly|infer)(?=[\s\[({{])/ TUnary | TPrim (!@nl ~/\[/ Skip Type? ']')*
TPrim ~= ObjType | Str | '-'? Num | Template | '[' (TupElem (',' TupElem)* ','?)? ']' | '(' Type ')' | 'typeof' (ImportCall | Name) (~/\./ Skip Name)* TypeArgs?
    | 'import' '(' Args ')' (~/\./ Skip Name)* TypeArgs? | /(?:void|null|true|false|this)(?![\w$])/ | Id (~/\./ Skip Name)* TypeArgs?
TupElem = '...'? (Name '?'? ':' Type | Type '?'?)
ObjType = '{{' (TMember (/[;,]/ | &/\}}/ | @nl))* '}}'
TMember = Mapped | /(?:readonly|static)(?=\s*[\w$\["'])/? IndexSig | 'new'? Sig | /(?:get|set)(?=\s+[\w$\["'])/ TName Sig | /readonly(?=\s+[\w$\["'])/? TName '?'? (Sig | TypeAnn)?
TName ~= '[' Expr ']' | Name | Str | Num
Mapped ~= /[+-]?readonly(?=\s*\[)/? '[' Id 'in' Type ('as' Type)? ']' /[+-]?\?/? TypeAnn?
"""


def build(language: str) -> Grammar:
    rest = TYPES if language == "typescript" else "\n".join(f"{n} ~= ~/(?!)/" for n in NEVER.split())
    return Grammar(BASE + rest, SKIP, {"nl": newline_before})
