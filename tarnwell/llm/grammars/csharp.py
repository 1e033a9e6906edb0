"""C#. Preprocessor lines count as white space."""

from __future__ import annotations

from ..packrat import Grammar

SKIP = r"[\s﻿]++|//[^\n\r]*+|/\*(?:[^*]++|\*(?!/))*+\*/|(?:(?<=[\n\r])|(?<=[\n\r][ \t])|(?<=\A)|(?<=﻿))\#[^\n\r]*+"
_IN_TEXT = SKIP.replace("/", "\\/")

_RESERVED = "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while"
_NAMED_TYPES = "bool byte char decimal double float int long object sbyte short string uint ulong ushort void dynamic"

TEXT = rf"""
File = ~/(?:{_IN_TEXT})*+/ ('extern' 'alias' Id ';')* Using* ('[' /(?:assembly|module)\s*:/ AttrList ']')* (Namespace | FileScoped | TypeDecl | TopStmt)* ~/\Z/
TopStmt ~= LocalFunc | Stmt
Using = 'global'? 'using' !/\(|var(?!\w)/ 'static'? ('unsafe')? (Id '=' Type | QName) ';'
Namespace = 'namespace' QName '{{' Using* (Namespace | TypeDecl)* '}}' ';'?
FileScoped ~= 'namespace' QName ';' Using*
Id ~= /@?(?!(?:{'|'.join(_RESERVED.split())})(?!\w))[^\W\d]\w*|@[^\W\d]\w*/
QName ~= /(?:global::)?/ Id TypeArgs? (~/\./ Skip Id TypeArgs?)*
Skip ~= ~/(?:{_IN_TEXT})*+/
Attrs ~= ('[' !/\]/ (/(?:field|return|param|type|method|property|event|assembly|module)\s*:/)? AttrList ']')*
AttrList ~= Attr (',' Attr)* ','?
Attr ~= QName ('(' Args ')')?
Mods ~= /(?:public|private|protected|internal|static|sealed|abstract|virtual|override|readonly|unsafe|extern|new|async|volatile|partial|required|file|const|ref|fixed)(?=\s+[\w@(])/*
TypeDecl = Attrs Mods (Class | Enum | Delegate) ';'?
Class ~= /(?:record\s+(?:class|struct)|class|struct|interface|record)(?=\s+[\w@])/ Id TypeParams? ('(' Params ')')? (':' Base (',' Base)*)? Where* ('{{' Member* '}}' | ';')
Base ~= Type ('(' Args ')')?
Where ~= 'where' Id ':' Bound (',' Bound)*
Bound ~= 'new' '(' ')' | /(?:class\s*\??|struct|notnull|unmanaged|default)(?!\w)/ | Type
TypeParams ~= '<' TParam (',' TParam)* '>'
TParam ~= Attrs /(?:in|out)(?=\s)/? Id
Enum ~= 'enum' Id (':' Type)? '{{' (EnumItem (',' EnumItem)* ','?)? '}}'
EnumItem ~= Attrs Id ('=' Expr)?
Delegate ~= 'delegate' !/[*({{]/ Type Id TypeParams? '(' Params ')' Where* ';'
Params = (Param (',' Param)* ','?)?
Param ~= Attrs /(?:this|ref|out|in|params|scoped|readonly)(?=\s)/* Type Id ('=' Expr)? | '__arglist'

Member = Attrs Mods (Class ';'? | Enum ';'? | Delegate | Ctor | Operator | Event | Method | Indexer | Property | Field) | ';'
Ctor ~= '~'? Id '(' Params ')' (':' /(?:base|this)(?!\w)/ '(' Args ')')? (Block | Arrow ';' | ';')
Operator ~= /(?:implicit|explicit)(?!\w)/ 'operator' /checked(?=\s)/? Type '(' Params ')' (Block | Arrow ';' | ';') | Type 'operator' /checked(?=\s)/? /true|false|\+\+|--|>>>|<<|>>|==|!=|<=|>=|[+\-!~*\/%&|^<>]/ '(' Params ')' (Block | Arrow ';' | ';')
Event ~= 'event' Type QName ('{{' Accessor* '}}' | ('=' Expr)? (',' Id ('=' Expr)?)* ';')
Method ~= Type MemberName TypeParams? '(' Params ')' Where* (Block | Arrow ';' | ';')
MemberName ~= Id TypeArgs? (~/\./ Skip Id TypeArgs?)*
Indexer ~= Type (QName ~/\./ Skip)? 'this' '[' Params ']' ('{{' Accessor+ '}}' | Arrow ';')
Property ~= Type MemberName ('{{' Accessor+ '}}' ('=' VarInit ';')? | Arrow ';')
Accessor ~= Attrs /(?:(?:public|private|protected|internal|readonly)\s+)*/ /(?:get|set|init|add|remove)(?!\w)/ (Block | Arrow ';' | ';')
Field ~= Type Declarator (',' Declarator)* ';'
Declarator ~= Id ('[' Expr ']')? ('=' VarInit)?
VarInit ~= ArrayInit | 'ref' Expr | Expr
ArrayInit = '{{' (VarInit (',' VarInit)* ','?)? '}}'
Arrow ~= '=>' ('ref' Expr | Throw | Expr)

Type = ('ref' /readonly(?=\s)/?)? TypeCore (/\?(?![?.:\[])|\*/ | /\[[\s,]*\]/)*
Bare ~= TypeCore (/\?(?=\[\])/? /\[[\s,]*\]/)*
TypeCore ~= /(?:{'|'.join(_NAMED_TYPES.split())})(?!\w)/ | '(' TupleItem (',' TupleItem)+ ')' | 'delegate' '*' TypeArgs | QName
TupleItem ~= Type Id?
TypeArgs = '<' (Type (',' Type)* | /,*/) ~/>/ Skip

Block = '{{' Stmt* '}}'
Stmt = Block | ';' | If | Return | LocalDecl | For | Foreach | While | Do | Switch | Try | UsingStmt | Lock | Jump | LocalFunc | Labelled | ExprStmt
If ~= 'if' '(' Expr ')' Stmt ('else' Stmt)?
Return ~= 'return' ('ref'? Expr)? ';'
LocalDecl ~= (/(?:await\s+)?using(?=\s)|const(?=\s)|scoped(?=\s)/)? !/(?:return|await|yield|throw|else|new|not)(?!\w)/ Type Declarator (',' Declarator)* ';'
LocalFunc ~= Attrs /(?:(?:static|async|unsafe|extern)\s+)*/ Type Id TypeParams? '(' Params ')' Where* (Block | Arrow ';' | ';')
For ~= 'for' '(' (Type Declarator (',' Declarator)* | Expr (',' Expr)*)? ';' Expr? ';' (Expr (',' Expr)*)? ')' Stmt
Foreach ~= 'await'? 'foreach' '(' (Type Id | 'var'? Expr) 'in' Expr ')' Stmt
While ~= 'while' '(' Expr ')' Stmt
Do ~= 'do' Stmt 'while' '(' Expr ')' ';'
Switch ~= 'switch' '(' Expr ')' '{{' Section* '}}'
Section ~= ('case' Pattern ('when' Expr)? ':' | 'default' ':')+ Stmt*
Try ~= 'try' Block (Catch+ ('finally' Block)? | 'finally' Block)
Catch ~= 'catch' ('(' Type Id? ')')? ('when' '(' Expr ')')? Block
UsingStmt ~= 'await'? 'using' '(' (Type Declarator (',' Declarator)* | Expr) ')' Stmt | /(?:checked|unchecked|unsafe)(?!\w)/ Block | 'fixed' '(' Type Declarator (',' Declarator)* ')' Stmt
Lock ~= 'lock' '(' Expr ')' Stmt
Jump ~= /(?:break|continue)(?!\w)/ ';' | 'throw' Expr? ';' | 'goto' ('case' Expr | 'default' | Id) ';' | 'yield' (/break(?!\w)/ | 'return' Expr) ';'
Labelled ~= Id /:(?!:)/ Stmt
ExprStmt ~= Expr ';'
Throw = 'throw' Expr

Expr = Lambda | Query | Throw | Unary /(?:=(?![=>])|(?:\?\?|<<|>>>?|[+\-*\/%&|^])=)/ ('ref'? Expr | ArrayInit) | Cond
Cond = Binary ('?' (Throw | Expr) ':' (Throw | Expr))?
Binary ~= Range (/(?:\?\?|&&|\|\||==|!=|<<|<=|>=|>>>|>>|[<>+\-*\/%&|^])(?![=])|<=|>=|==|!=/ (Throw | Range) | 'is' Pattern | 'as' Bare)*
Range ~= Unary (/\.\./ Unary?)? | /\.\./ Unary?
Unary = /\+\+|--|[+\-!~&*^]|await(?=\s+[\w@(])/ Unary | Cast | Postfix
Cast = '(' Type ')' &/[\w@"'(~!$\x7f-\uffff]|\{{/ !/(?:is|as|in|and|or|switch|with|when)(?!\w)/ Unary
Postfix = Primary Suffix* ('switch' '{{' (Arm (',' Arm)* ','?)? '}}' | 'with' ObjInit)*
Arm ~= Pattern ('when' Expr)? '=>' (Throw | Expr)
Suffix ~= /\??(?:\.(?!\.)|->)/ Id (TypeArgs &/[(.,;)\]}}:?!=>]/)? | /\??\[/ Args ']' | '(' Args ')' | /\+\+|--|!(?!=)/ | '::' Id
Args = (Arg (',' Arg)* ','?)?
Arg ~= (Id /:(?!:)/)? (/(?:ref|in)(?=\s)/ Expr | 'out' (Type Id | Expr) | Expr)
Primary = Id (TypeArgs &/[(.,;)\]}}:?!]/)? | Lit | '(' Expr (',' Expr)+ ')' | '(' TupleArg (',' TupleArg)+ ')' | '(' Expr ')' | New | /(?:this|base|true|false|null)(?!\w)/ | /(?:typeof|sizeof)(?!\w)/ '(' Type ')' | /(?:nameof|checked|unchecked)(?!\w)/ '(' Expr ')'
    | 'default' ('(' Type ')')? | AnonMethod | Stackalloc | /(?:{'|'.join(_NAMED_TYPES.split())})(?!\w)/ | Collection
Collection ~= '[' (('..')? Expr (',' ('..')? Expr)* ','?)? ']'
TupleArg ~= (Id ':')? (Type Id | Expr)
New = 'new' (/\[[\s,]*\]/ ArrayInit | ObjInit | '(' Args ')' ObjInit? | NewType ('(' Args ')' ObjInit? | '[' Expr (',' Expr)* ']' /\[[\s,]*\]/* ArrayInit? | /\[[\s,]*\]/+ ArrayInit | ObjInit))
NewType ~= TypeCore '?'?
ObjInit ~= '{{' (InitItem (',' InitItem)* ','?)? '}}'
InitItem ~= '[' Args ']' '=' VarInit | Id /=(?![=>])/ VarInit | ArrayInit | Expr
Stackalloc ~= 'stackalloc' Type? ('[' Expr? ']')? ArrayInit?
AnonMethod ~= /(?:(?:async|static)\s+)*/ 'delegate' ('(' Params ')')? Block
Lambda = Attrs /(?:(?:async|static)\s+)*/ (Id | '(' (LParam (',' LParam)*)? ')' | Type '(' (LParam (',' LParam)*)? ')') '=>' (Block | 'ref'? Expr)
LParam ~= Attrs /(?:ref|out|in|params|scoped)(?=\s)/* (Type Id ('=' Expr)? | Id)
Query = &/from\s+[\w@]/ From QueryPart* (/select(?!\w)/ Expr | /group(?!\w)/ Expr /by(?!\w)/ Expr) (/into(?!\w)/ Id QueryPart* (/select(?!\w)/ Expr | /group(?!\w)/ Expr /by(?!\w)/ Expr))?
From ~= 'from' (Type Id | Id) 'in' Expr
QueryPart ~= From | 'let' Id '=' Expr | 'where' Expr | 'join' (Type Id | Id) 'in' Expr 'on' Expr 'equals' Expr ('into' Id)? | 'orderby' Expr /(?:ascending|descending)(?!\w)/? (',' Expr /(?:ascending|descending)(?!\w)/?)*

Pattern = PatAnd ('or' PatAnd)*
PatAnd ~= PatUnary ('and' PatUnary)*
PatUnary = 'not' PatUnary | /<=|>=|[<>]/ Range | '(' Pattern ')' !/\{{/ | PatRec | 'var' Id | /_(?!\w)/ | '[' ('..' Pattern? | Pattern)? (',' ('..' Pattern? | Pattern))* ']' | Bare Name !/[.(]/ | Bare !/[.(<]/ | Range
PatRec ~= Bare? ('(' (SubPat (',' SubPat)*)? ')')? '{{' (SubPat (',' SubPat)* ','?)? '}}' Name? | Bare? '(' (SubPat (',' SubPat)*)? ')' Name?
Name ~= !/(?:and|or|when|select|where|from|let|join|on|equals|into|orderby|group|by|ascending|descending)(?!\w)/ Id
SubPat ~= (Id (~/\./ Skip Id)* ':')? Pattern

Lit ~= Str | Interp | /'(?:[^'\\\n\r]|\\[^\n\r][0-9a-fA-F]*)'/ | /(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[uUlLfFdDmM]{{0,2}}(?!\w)/
Str ~= /(?:@"(?:[^"]|"")*+"|"{{3,}}(?:[^"]|"(?!""))*+"{{3,}}|"(?!"")(?:[^"\\\n\r]|\\[^\n\r])*+"|""(?!"))(?:u8)?/
Interp = ~/\$@"|@\$"/ (~/[^"{{}}]++|""|\{{\{{|\}}\}}/ | Hole)* /"/ | ~/\$"(?!"")/ (~/(?:[^"\\{{}}\n\r]++|\\[^\n\r]|\{{\{{|\}}\}})/ | Hole)* /"/ | /\$+"{{3,}}(?:[^"]|"(?!""))*+"{{3,}}/
Hole ~= ~/\{{/ Skip Expr (',' Expr)? (~/:[^}}"]*/)? ~/\}}/
"""


def build(language: str) -> Grammar:
    return Grammar(TEXT, SKIP)
