"""SQL: definitions, data changes and queries in the PostgreSQL manner, which T-SQL and ANSI SQL share in the main."""

from __future__ import annotations

import re

from ..packrat import Grammar

SKIP = r"[\s﻿]++|--[^\n\r]*+|/\*(?:[^*]++|\*(?!/))*+\*/"

#: Words that can name nothing unless quoted.
_RESERVED = "all analyse analyze and any array as asc both case cast check collate constraint create default desc distinct do else end except false for foreign from grant group having in initially intersect into leading limit not null on only or order primary references returning select some then to trailing true union unique user using when where window with join left right full inner outer cross natural"

TEXT = r"""
File = ~/(?:SKIPTEXT)*+/ (Stmt? /;|go(?=\s)/)* Stmt? ~/\Z/
Id ~= /(?!(?:RESERVED)(?!\w))[^\W\d][\w$]*|"(?:[^"]|"")+"|\[[^\]\n]+\]|`[^`\n]+`/
Any ~= /[^\W\d][\w$]*|"(?:[^"]|"")+"|\[[^\]\n]+\]|`[^`\n]+`/
Name ~= Id ('.' Any)*
Str ~= /(?:[eEbBxXnN]|U&)?'(?:[^']|'')*+'(?:\s*\n\s*'(?:[^']|'')*+')*|\$(\w*)\$[\s\S]*?\$\1\$/
Num ~= /(?:0x[0-9a-f]+|(?:\d[\d_]*\.?\d*|\.\d+)(?:e[+-]?\d+)?)(?!\w)/
Stmt = Query | Insert | Update | Delete | Merge | Create | Alter | Drop | Grant | Other

Create ~= 'create' ('or' /replace|alter/)? (Table | View | Index | Schema | Type | Sequence | Function | Trigger | Simple)
Exists ~= 'if' 'not' 'exists'
Table ~= /(?:(?:global|local)\s+)?(?:temp|temporary|unlogged|external|foreign)(?!\w)/? 'table' Exists? Name (('(' (TableItem (',' TableItem)*)? ')') TableOpt* ('as' Query)? | 'as' Query | 'partition' 'of' Name TableOpt*)
TableOpt ~= 'inherits' NameList | /with(?=\s*\()/ Params | /without\s+oids/ | 'tablespace' Id | 'partition' 'by' Any '(' Expr (',' Expr)* ')' | /on\s+commit/ Any Any? | 'for' 'values' (/in|with/ '(' Args ')' | 'from' '(' Args ')' 'to' '(' Args ')') | 'default' | 'server' Id | /engine/ '=' Id
Params ~= '(' Opt (',' Opt)* ')'
Opt ~= Name ('=' (Expr | Any))?
NameList ~= '(' Any ('.' Any)* (',' Any ('.' Any)*)* ')'
TableItem ~= TableCons | 'like' Name (Any Any)* | ColDef
TableCons ~= ('constraint' Id)? ('primary' 'key' Clustered? ColList UsingIx? | 'unique' Clustered? (/nulls\s+not\s+distinct/)? ColList | 'foreign' 'key' NameList Refs | 'check' '(' Expr ')' | 'exclude' ('using' Id)? '(' IndexCol 'with' Op (',' IndexCol 'with' Op)* ')') Defer*
Clustered ~= /(?:non)?clustered(?!\w)/
UsingIx ~= 'using' 'index' Any*
ColList ~= '(' Id (/asc|desc/)? (',' Id (/asc|desc/)?)* ')'
Refs ~= 'references' Name NameList? (/match\s+\w+/)? (/on\s+(?:delete|update)\s+(?:cascade|restrict|no\s+action|set\s+null|set\s+default)(?!\w)/ )*
Defer ~= /(?:not\s+)?deferrable(?!\w)|initially\s+(?:deferred|immediate)(?!\w)|not\s+valid(?!\w)|no\s+inherit(?!\w)/
ColDef = Id (DataType ColOpt* | ColOpt+ | 'as' Expr 'persisted'?)
ColOpt ~= ('constraint' Id)? ('not'? 'null' | 'default' Add | 'primary' 'key' Clustered? | 'unique' | Refs | 'check' '(' Expr ')' | 'collate' Name | /generated\s+(?:always|by\s+default)\s+as/ ('identity' ('(' SeqOpt* ')')? | '(' Expr ')' 'stored'?) | /identity(?!\w)/ ('(' Num ',' Num ')')? | /auto_?increment(?!\w)/ | Defer)
DataType = /setof(?!\w)/? (/double\s+precision|(?:character|char|bit|binary)\s+varying|(?:timestamp|time)(?:\s*\(\s*\d+\s*\))?\s+with(?:out)?\s+time\s+zone|interval\s+\w+(?:\s+to\s+\w+)?(?=\s*[,);])/ | Name) ('(' (Num | Any | '*') (',' (Num | Any))* ')')? (/\[\d*\]|array(?!\w)/)* (/%(?:row)?type/)?
View ~= /(?:(?:temp|temporary|recursive|materialized)\s+)*view(?!\w)/ Exists? Name NameList? (/with(?=\s*\()/ Params)? 'as' Query (/with\s+(?:(?:cascaded|local)\s+)?check\s+option|with\s+(?:no\s+)?data/)?
Index ~= /(?:unique\s+)?(?:(?:non)?clustered\s+)?index(?!\w)/ /concurrently(?!\w)/? (Exists? Name)? 'on' 'only'? Name ('using' Id)? '(' IndexCol (',' IndexCol)* ')' (/include(?!\w)/ NameList)? (/nulls\s+(?:not\s+)?distinct/)? (/with(?=\s*\()/ Params)? ('tablespace' Id)? ('where' Expr)?
IndexCol ~= Unary ('collate' Name)? (Name Params?)? (/asc|desc/)? (/nulls\s+(?:first|last)/)?
Schema ~= 'schema' Exists? Id? ('authorization' Id)?
Type ~= /type|domain/ Name 'as'? ('enum' '(' (Str (',' Str)*)? ')' | '(' ColDef (',' ColDef)* ')' | DataType ColOpt*)
Sequence ~= /(?:(?:temp|temporary)\s+)?sequence(?!\w)/ Exists? Name SeqOpt*
SeqOpt ~= /(?:as\s+\w+|increment(?:\s+by)?\s+-?\d+|minvalue\s+-?\d+|no\s+(?:minvalue|maxvalue|cycle)|maxvalue\s+-?\d+|start(?:\s+with)?\s+-?\d+|cache\s+\d+|cycle|owned\s+by\s+[\w.]+|restart(?:\s+with\s+\d+)?)(?!\w)/
Function ~= /function|procedure|proc(?!\w)/ Name ('(' (FuncArg (',' FuncArg)*)? ')')? ('returns' ('table' '(' ColDef (',' ColDef)* ')' | DataType))? FuncOpt*
FuncArg ~= /(?:in|out|inout|variadic)(?=\s)/? (DataType /(?:default|=)/ Expr | Id DataType (/default|:?=/ Expr)? | DataType)
FuncOpt ~= /language\s+'?\w+'?|immutable|stable|volatile|(?:not\s+)?leakproof|strict|called\s+on\s+null\s+input|returns\s+null\s+on\s+null\s+input|(?:external\s+)?security\s+(?:definer|invoker)|parallel\s+\w+|cost\s+\d+|rows\s+\d+|window/ | 'set' Name (/to|=/ Expr (',' Expr)* | /from\s+current/) | 'as' Str (',' Str)? | 'return' Expr | /as\s+begin|begin(?:\s+atomic)?/ (Stmt ';'?)* 'end'
Trigger ~= /(?:constraint\s+)?trigger(?!\w)/ Name /before|after|instead\s+of/ /insert|update|delete|truncate/ ('of' Name (',' Name)*)? ('or' /insert|update|delete|truncate/ ('of' Name (',' Name)*)?)* 'on' Name ('from' Name)? Defer* (/referencing/ (/(?:new|old)\s+table(?:\s+as)?/ Id)+)? (/for\s+(?:each\s+)?(?:row|statement)/)? ('when' '(' Expr ')')? 'execute' /function|procedure/ Name '(' Args? ')'
Simple ~= 'extension' Exists? Id (/with(?!\w)/? Any (Any | Str))* | /role|user|database/ Exists? Any Bare* | 'policy' Id 'on' Name (/as\s+\w+/)? (/for\s+\w+/)? ('to' Any (',' Any)*)? ('using' '(' Expr ')')? (/with\s+check/ '(' Expr ')')?
Bare ~= Str | Num | Any | '='

Alter ~= 'alter' (('table' ('if' 'exists')? 'only'? Name '*'? AlterItem (',' AlterItem)*) | /index|view|sequence|type|schema|function|procedure|materialized\s+view|default\s+privileges|role|user|database|domain|policy|extension/ AlterTok+)
AlterTok ~= Str | Num | '(' AlterTok* ')' | Any | /[=,.*]/
AlterItem ~= 'add' ('column' Exists? ColDef | TableCons | Exists? ColDef) | 'drop' ('constraint' ('if' 'exists')? Id | 'column'? ('if' 'exists')? Id) (/cascade|restrict/)?
    | 'alter' 'column'? Id (/(?:set\s+data\s+)?type(?!\w)/ DataType ('collate' Name)? ('using' Expr)? | 'set' ('default' Expr | 'not' 'null' | /statistics|storage|\(/ AlterTok*) | 'drop' ('default' | 'not' 'null' | 'identity' ('if' 'exists')? | 'expression') | 'add' /generated\s+(?:always|by\s+default)\s+as\s+identity/ | DataType ColOpt*)
    | 'rename' (/column|constraint/? Id)? 'to' Id | 'owner' 'to' Any | 'set' ('schema' Id | 'tablespace' Id | Params | /logged|unlogged/ | /without\s+\w+/) | /(?:enable|disable|force|no\s+force)\s+(?:row\s+level\s+security|(?:(?:always|replica)\s+)?(?:trigger|rule)\s+\w+)/ | 'validate' 'constraint' Id | /attach|detach/ 'partition' Name TableOpt* | /no\s+inherit|inherit/ Name | 'cluster' 'on' Id | /replica\s+identity/ Any+
Drop ~= 'drop' /(?:table|view|materialized\s+view|index|schema|type|sequence|function|procedure|trigger|extension|role|user|database|domain|policy|column)(?!\w)/ /concurrently(?!\w)/? ('if' 'exists')? DropName (',' DropName)* ('on' Name)? (/cascade|restrict/)? | 'truncate' 'table'? 'only'? Name (',' Name)* (/(?:restart|continue)\s+identity/)? (/cascade|restrict/)?
DropName ~= Name ('(' (DataType (',' DataType)*)? ')')?
Grant ~= /grant|revoke/ (/grant\s+option\s+for/)? Priv (',' Priv)* ('on' (/(?:all\s+)?(?:tables|sequences|functions)\s+in\s+schema|table|schema|sequence|function|database|type/)? DropName (',' DropName)*)? /to|from/ Any (',' Any)* (/with\s+(?:grant|admin)\s+option|cascade|restrict/)?
Priv ~= /(?:all(?:\s+privileges)?|select|insert|update|delete|truncate|references|trigger|usage|execute|create|connect|temporary|temp)(?!\w)/ NameList? | Id
Other ~= /begin(?!\w)/ (/transaction|work|tran/)? | /(?:start\s+transaction|commit|rollback|end)(?!\w)/ (/transaction|work|tran/)? ('to' /savepoint/? Id)? | /(?:savepoint|release)(?!\w)/ Id+ | 'set' /(?:local|session)(?=\s)/? Any ('.' Any)* (/to|=/ (Expr | 'on' | 'default') (',' Expr)* | Any+ | Expr)
    | 'comment' 'on' /\w+(?:\s+view)?/ DropName ('on' Name)? 'is' (Str | 'null') | /(?:analyze|analyse|vacuum|reindex|refresh\s+materialized\s+view)(?!\w)/ AlterTok* | /explain(?!\w)/ ('(' Opt (',' Opt)* ')')? /analyze(?!\w)/? /verbose(?!\w)/? Stmt | 'do' (/language\s+\w+/)? Str (/language\s+\w+/)? | /call|exec(?:ute)?/ Name ('(' Args? ')' | Args)? | /use(?!\w)/ Id | /lock\s+table/ Name /in\s+[\w\s]+mode/ | 'copy' Name NameList? /from|to/ (Str | /stdin|stdout/) AlterTok*

Insert ~= With? 'insert' 'into' Name ('as' Id)? NameList? (/overriding\s+\w+\s+value/)? ('default' 'values' | Query) Conflict? Returning?
Conflict ~= /on\s+conflict/ ('(' IndexCol (',' IndexCol)* ')' ('where' Expr)? | /on\s+constraint/ Id)? 'do' ('nothing' | 'update' 'set' SetItem (',' SetItem)* ('where' Expr)?)
Returning ~= 'returning' Item (',' Item)*
SetItem ~= (NameList | Name ('[' Expr ']')?) '=' (Expr | 'default')
Update ~= With? 'update' 'only'? Name ('as'? !/set(?!\w)/ Id)? 'set' SetItem (',' SetItem)* ('from' Source (',' Source)*)? ('where' Expr)? Returning?
Delete ~= With? 'delete' 'from' 'only'? Name ('as'? Id)? ('using' Source (',' Source)*)? ('where' Expr)? Returning?
Merge ~= With? 'merge' 'into' Name ('as'? Id)? 'using' Source 'on' Expr ('when' 'not'? 'matched' (/by\s+\w+/)? ('and' Expr)? 'then' ('update' 'set' SetItem (',' SetItem)* | 'insert' NameList? 'values' '(' Args ')' | 'delete' | 'do' 'nothing'))+

With ~= 'with' 'recursive'? Cte (',' Cte)*
Cte ~= Id NameList? 'as' (/(?:not\s+)?materialized/)? '(' Stmt ')'
Query = With? Term (/union|intersect|except/ /all|distinct/? Term)* ('order' 'by' Order (',' Order)*)? Tail*
Tail ~= 'limit' ('all' | Expr) | 'offset' Expr /rows?(?!\w)/? | /fetch\s+(?:first|next)/ Expr? /rows?\s+(?:only|with\s+ties)/ | 'for' /(?:no\s+key\s+)?update|(?:key\s+)?share/ ('of' Name)? (/nowait|skip\s+locked/)?
Term = Select | '(' Query ')' | 'values' Row (',' Row)* | 'table' Name
Row ~= '(' Val (',' Val)* ')'
Val ~= 'default' | Expr
Select ~= 'select' (/all(?!\w)/ | 'distinct' ('on' '(' Args ')')? )? ('top' (Num | '(' Expr ')'))? (Item (',' Item)*)? ('into' Name)? ('from' Source (',' Source)*)? ('where' Expr)? ('group' 'by' Group (',' Group)*)? ('having' Expr)? ('window' Id 'as' Over (',' Id 'as' Over)*)?
Item ~= '*' | Expr ('as' (Any | Str) | Id)?
Group ~= /rollup|cube|grouping\s+sets/ '(' (Group (',' Group)*)? ')' | '(' ')' | Expr
Source = Table1 (Join Table1 ('on' Expr | 'using' NameList)?)*
Join ~= /(?:natural\s+)?(?:(?:inner|cross|(?:left|right|full)(?:\s+outer)?)\s+)?join(?!\w)/
Table1 = 'lateral'? ('(' Query ')' | '(' Source ')' | 'rows' 'from' '(' Args ')' | Name ('(' Args? ')')? /with\s+ordinality/?) Alias? (/tablesample/ Id '(' Args ')')?
Alias ~= 'as' Any ColAlias? | !/(?:set|on|where|when|offset|tablesample|window|fetch|returning)(?!\w)/ Id ColAlias?
ColAlias ~= '(' Id DataType? (',' Id DataType?)* ')'
Order ~= Expr (/asc(?!\w)|desc(?!\w)/ | 'using' Op)? (/nulls\s+(?:first|last)/)?

Expr = Not (/and(?!\w)|or(?!\w)/ Not)*
Not ~= /not(?!\w)/* Comp
Comp ~= Add Test*
Test ~= 'is' 'not'? (/null|true|false|unknown|json|document|normalized/ | 'distinct' 'from' Add) | /isnull|notnull/ | 'not'? ('between' /symmetric/? Add 'and' Add | 'in' '(' (Query | Args) ')' | 'in' Add | /like|ilike|similar\s+to|rlike|regexp/ Add ('escape' Add)?)
    | Op (/any|some|all/ '(' (Query | Expr) ')' | Add) | /overlaps/ Add
Op ~= /operator\s*\(\s*[\w.]*[^\s)\w]+\s*\)|(?!--|\/\*)(?:(?!--|\/\*)[+*\/<>=~!@#%^&|?-])+/
Add = Unary ((/at\s+time\s+zone|collate/ (Unary | Name)) | !/=/ Op !/any\s*\(|some\s*\(|all\s*\(/ Unary)*
Unary = /[+\-~@]+/ Unary | Primary (/::/ DataType | '[' Expr? (':' Expr?)? ']' | '.' (Any | '*'))*
Primary = Case | Cast | 'exists' '(' Query ')' | 'array' ('[' Args? ']' | '(' Query ')') | /row(?=\s*\()/ '(' Args? ')' | Special | Func | Str | /(?:date|time|timestamp|interval|timestamptz)(?=\s*')/ Str /(?:year|month|day|hour|minute|second)(?:\s+to\s+\w+)?(?!\w)/? | Num | '(' (Query | Args) ')' | /(?:null|true|false|default|current_\w+|localtime\w*|session_user|user)(?!\w)/ | Name ~/\.\s*\*/ | Name | /[$:@]\w+|\$\d+|\?(?!\w)/ | '*'
Case ~= 'case' Expr? ('when' Expr 'then' Expr)+ ('else' Expr)? 'end'
Cast ~= /(?:try_)?cast(?!\w)/ '(' Expr 'as' DataType ')'
Special ~= 'extract' '(' Any 'from' Expr ')' | 'position' '(' Add 'in' Add ')' | 'substring' '(' Expr ('from' Expr)? ('for' Expr)? ')' | 'trim' '(' /leading|trailing|both/? Expr? ('from' Expr)? ')' | 'overlay' '(' Expr 'placing' Expr 'from' Expr ('for' Expr)? ')'
Func = !/(?:values|exists|array)(?!\w)/ (Name | /(?:left|right|user|any|all|some|unique|check|default)(?=\s*\()/) '(' (/distinct|all(?=\s)/? (Arg (',' Arg)*)? ('order' 'by' Order (',' Order)*)?) ')' (/within\s+group/ '(' 'order' 'by' Order (',' Order)* ')')? (/filter(?!\w)/ '(' 'where' Expr ')')? (/(?:ignore|respect)\s+nulls/)? ('over' (Over | Id))?
Arg ~= (Id /=>|:=/)? ('variadic'? Expr | Query)
Over ~= '(' (!/(?:partition|rows|range|groups)(?!\w)/ Id)? ('partition' 'by' Args)? ('order' 'by' Order (',' Order)*)? (/(?:rows|range|groups)(?!\w)/ AlterTok+)? ')'
Args = Expr (',' Expr)*
"""


def build(language: str) -> Grammar:
    text = TEXT.replace("RESERVED", _RESERVED.replace(" ", "|")).replace("SKIPTEXT", SKIP.replace("/", "\\/"))
    return Grammar(text, SKIP, flags=re.I)
