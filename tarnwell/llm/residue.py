"""Problem 9: template residue, filler and error pages in place of content."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..session import Scratch
from .syntax import spread

#: A text in place of a mark that is longer than this is no value of the slot.
VALUE_CHARS = 60
#: Words of a template's longest piece by which other sentences are aligned with it.
ALIGNED_BY = 4
#: A sentence with fewer words of its own beside its slots is no template.
LEAST_WORDS = 2
#: A line of candidate pages is page boilerplate if so many of them have it and this share of all records with it are such pages.
PAGES, PURE = 3, 0.8

# The forms in which template engines and people mark a value that is still missing.
_NAME = r"[A-Za-z][\w.\- ]{0,38}"
PLACEHOLDERS = re.compile(
    rf"""
      \{{\{{\{{?\s*{_NAME}\s*\}}\}}\}}?            # mustache, handlebars
    | [$\#]\{{\s*{_NAME}\s*\}}                     # shell, template strings, Ruby
    | <%[=-]?\s*{_NAME}\s*%>                       # ERB, EJS
    | %\({_NAME}\)[sd]                             # printf by name
    | %%{_NAME}%%
    | @@{_NAME}@@
    | (?<![\w_])__(?!init__|main__|name__|file__|all__|doc__)[A-Za-z][A-Za-z0-9_.]*?__(?![\w_])
    | \$[A-Za-z][A-Za-z0-9_.]{{2,}}\$
    | \[\[\s*{_NAME}\s*\]\]
    | (?<![\w$#{{])\{{{_NAME}\}}
    | \[(?:insert|your|enter|add|fill\s+in|todo|tbd|placeholder)\b[^\]\n]{{0,60}}\](?!\()
    | \[[A-Z][A-Z _]{{2,40}}\](?!\()
    | <(?:your|insert|enter|my)[-_ ][^<>\n]{{1,40}}>
    | <[^<>\n]{{1,40}}\s(?:goes\ here|here)>
    | &lt;[^&<>\n]{{1,40}}&gt;
    | \((?:fill\s+in|insert|enter)\s[^()\n]{{1,40}}\)
    | \bTBD\s\([^()\n]{{1,40}}\)
    | \bTODO:\s+(?:describe|add|write|fill\s+in|insert)\s+(?:the\s+)?[\w. -]{{1,40}}?(?=[,;]|\.?\s*$|\.\s|\s(?:has|was|to|by|bởi|unter|et)\b)
    | (?<!\S)_{{4,}}(?!\S)
    """,
    re.X | re.I,
)

# How people write about placeholders, in place of leaving one.
TALKS = re.compile(
    r"""\b(?:(?:of|in)\ the\ form|(?:is|are|gets?|be)\ (?:replaced|substituted|expanded|interpolated)|stands?\ for|expands?\ to|placeholders?|template\ (?:variables?|syntax|marks?)
    |(?:in|von)\ der\ form|(?:wird|werden)\ (?:ersetzt|eingesetzt)|steht\ für|platzhalter|de\ la\ forme|(?:est|sont)\ remplacée?s?|tient\ lieu\ de
    |có\ dạng|theo\ dạng|(?:được|sẽ)\ thay)\b""",
    re.X | re.I,
)

# The usual dummy Latin, keyboard runs and instructions left by page builders.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "vitae sapien massa justo urna orci arcu felis lectus tellus risus nibh quam porta dapibus vero turpis mauris nunc odio augue metus neque purus diam erat leo ligula pellentesque viverra vestibulum".split()
)
_ONLY_LATIN = LATIN - frozenset("in et ex do ut id est sit sed sunt ea non do ad massa".split())  # the others are words of living languages, too
FILLER = re.compile(
    r"""\b(?:(?:blah|asdf|qwer|zxcv|qwerty|foo\ bar\ baz)(?:\s+(?:blah|asdf|qwer|zxcv|qwerty|xx+))+
    | x{4,}(?:\s+x{3,})+
    | (?:your|the)\s+(?:content|text|copy)\s+(?:will\s+appear|goes|comes)\s+(?:in\s+this\s+place|here)
    | text\s+goes\s+here
    | (?:sample|dummy|example|placeholder)\s+(?:paragraph|text|heading|content|title)\b(?=[,.]|\s*$|\s+(?:replace|text|your|write|sample|blah|asdf|placeholder|xx))
    | write\s+(?:a|one|two|three|some)(?:\s+or\s+\w+)?\s+(?:sentences?|paragraphs?|words)\s+about
    | replace\s+(?:this|before\s+publishing)
    | (?:beispieltext|blindtext|platzhaltertext|texte\s+d['’]exemple|texte\s+de\s+remplissage|văn\s+bản\s+mẫu|nội\s+dung\s+mẫu))""",
    re.X | re.I,
)

# What servers, gateways and script loaders say, as the beginning or the whole of a line.
ERROR = re.compile(
    r"""^(?:(?:HTTP|Error|Fehler|Erreur|Lỗi|Status)?\s*[:/]?\s*[45]\d\d\b\s*:?\s*(?:$|[-–.:]|(?:not\ found|forbidden|gone|unauthori[sz]ed|bad\ (?:gateway|request)|service\ unavailable|gateway\ time-?out|internal\ server\ error|too\ many\ requests|method\ not\ allowed|cette\ page|die\ seite|không))
    | (?:not\ found|forbidden|gone|unauthori[sz]ed|bad\ gateway|service\ unavailable|gateway\ time-?out|internal\ server\ error)\s*(?:$|[-–.:])
    | (?:oops|unexpected\ (?:failure|error)|an\ error\ (?:has\ )?occurred)\W*$
    | (?:something|sorry|oops|unexpected\ (?:failure|error))\b.{0,40}?(?:wrong|did\ not\ work|broke|failure|error|our\ side)
    | (?:page|request|access|service|server|site)\s+(?:is\s+)?(?:unavailable|blocked|denied|down\b|busy|not\ (?:available|reachable))
    | [\w.-]+\ is\ not\ reachable
    | application\ error
    | (?:access|permission)\ denied
    | your\ (?:session|login)\ (?:has\ )?(?:ended|expired)
    | too\ many\ requests
    | (?:we|the\ server)\ (?:cannot|can't|could\ not|couldn't)\ (?:find|serve|open|load)\ (?:that|this|the)\ page
    | the\ page\ (?:you\ asked\ for|you\ requested|cannot|could\ not)
    | (?:service|site|wiki|portal|system)\ is\ (?:down|under|in|offline)
    | (?:\S+\ )?(?:this\ \w+\ (?:needs|requires)|javascript\ (?:must|is|has\ to)|(?:please\ )?(?:enable|activate|turn\ on|allow)\ (?:javascript|scripts?|cookies)|scripts?\ (?:are|is)\ (?:switched\ off|disabled|blocked))
    | your\ browser\ (?:is|does|blocks|has)
    | checking\ that\ you|checking\ your\ browser|verify(?:ing)?\ (?:that\ )?you\ are
    | (?:der\ dienst|die\ seite|der\ server)\ (?:ist|wurde|antwortet)\ .{0,30}(?:nicht|zurzeit|gewartet|gefunden|überlastet)
    | bitte\ (?:schalten|aktivieren|erlauben|melden)\ sie
    | (?:skripte|javascript)\ (?:sind|ist|wird|muss)
    | zugriff\ verweigert|zugang\ verweigert
    | (?:wartungsarbeiten|wegen\ wartung)
    | (?:le\ service|le\ site|le\ serveur|la\ page)\ (?:est|n'est|ne)\b
    | (?:les\ scripts|javascript)\ (?:sont|est|doit)
    | (?:veuillez\ )?active[rz]\ javascript
    | accès\ (?:refusé|interdit)
    | trang\ (?:này|bạn)\ (?:cần|yêu|không)
    | máy\ chủ\ (?:đang|không)
    | bạn\ không\ có\ quyền|truy\ cập\ bị\ từ\ chối
    | trình\ duyệt\ (?:của\ bạn\ )?(?:đang|không|đã)
    | (?:hệ\ thống|dịch\ vụ|trang)\ (?:đang|tạm)\ (?:bảo\ trì|ngừng|ngưng)
    | phiên\ (?:làm\ việc|đăng\ nhập))""",
    re.X | re.I,
)
# Lines that frame a page or go with an error: navigation, references, traces, advice.
FRAME = re.compile(
    r"""^(?:skip\ to\ content|back\ to\ top|☰.*|©.*|(?:[\w ]+\s[|·»]\s)+[\w ]+|copyright\ .*|all\ rights\ reserved.*
    | (?:ref|reference|trace|request|incident|error)?\s*(?:id|ref|code|no)\.?\s*:?\s*[\w-]*\d[\w-]*|(?:référence|vorgang|mã)\s+[\w-]+
    | [^\W\d_]+(?:\ id)?\s*:?\s[\w-]*\d[\w-]*
    | timestamp\b.*|[\w-]*\s?proxy\b.{0,24}|proxy/\w+|loading\W*
    | at\ [\w.$<>]+\ \(.*\)|at\ [\w./-]+:\d+.*
    | (?:please\ )?(?:try|reload|go|log|sign|contact|wait|come|check|turn)\b.{0,60}
    | our\ team\b.*|(?:it\ may|you\ do\ not|you\ lack|your\ login|the\ (?:link|address|host|upstream|server|database|page)\b|an\ unhandled|we\ took)\b.{0,80}
    | (?:vui\ lòng|hãy|bitte|veuillez)\b.{0,60})$""",
    re.X | re.I,
)

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
_CODE = re.compile(r"`[^`\n]+`")
_LEAD = re.compile(r"^(?:\s|[*+\-•>#|]|\d+[.)]\s|\[[ xX]\]\s|//|\d\d:\d\d\s)+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_]|[\[{<$%@(&_#])|\s[–—]\s")
_MASK = re.compile(r"(?<![\w.-])[\w.-]*/[\w./-]+|\b[A-Z]{2,}-\d+\b|\b[0-9a-f]{8,}\b|\b\w*\d[\w.:]*\b|\b[a-z]+(?:_[a-z]+)+\b|\b[a-z]+(?:[A-Z][a-z]+)+\b|\b(?:[A-Z][a-z]+){2,}\b|\b[a-z]+-[a-z]+\b")
# What varies between records of a template, as whole words: what stands where a value is missing, values, and names of variables.
_MISSING = re.compile(r"(?:n/a|tbd|tba|null|undefined|x{3,}|\?{3,}|\.{4,}|_{3,})", re.I)
_VALUE = re.compile(r"[^\s@]+@[\w-]+(?:\.[\w-]+)+|\S*[/\d]\S*|[a-z]+-[a-z]+")
_NAME_FORM = re.compile(r"[a-z]+(?:_[a-z]+)+|[A-Za-z][a-z]+(?:[A-Z][a-z]+)+|[A-Z]+(?:_[A-Z]+)+|[A-Z]{4,}")
_EDGES = re.compile(r"([\"'(\[{<«„“‚‘*]*)(.*?)([.,;:!?)\]}>»”’\"'*…]*)", re.S)
MARK, MISSING, VALUE, NAME, IDENTIFIER, CAPITAL = range(6)
# Words for what records are filled with, in names that people give to such fields.
FIELD_WORDS = frozenset(
    "account address amount approver assignee author birthday branch city client company component contact contractor country currency customer date day deadline department description email employee environment firstname fullname "
    "greeting hostname invoice language lastname location manager month name number order owner password person phone price product project quantity reason recipient region reporter repository sender service signature state status "
    "street subject summary surname team tenant ticket time title token total url user username vendor version week year zip".split()
)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class _Words(dict):
    """(what is before, kind, text, what is after) of words seen before; kind is None for a word of the template."""

    def __missing__(self, word: str) -> tuple[str, int | None, str, str]:
        if len(self) > 300_000:
            self.clear()
        before, core, after = _EDGES.fullmatch(word).groups()
        whole = word.rstrip(",;:!)")
        if "\x02" in word:
            x = (word[: word.index("\x02")], MARK, "\x02", word[word.rindex("\x02") + 1 :])
        elif word in (",", ";") or _MISSING.fullmatch(whole):
            x = ("", MISSING, whole, word if word in (",", ";") else word[len(whole) :])
        elif _MISSING.fullmatch(core):
            x = (before, MISSING, core, after)
        elif _NAME_FORM.fullmatch(core):
            field = {y.casefold() for y in _PARTS.findall(core)} & FIELD_WORDS
            x = (before, NAME if field else IDENTIFIER, core, after)
        elif _VALUE.fullmatch(core):
            x = (before, VALUE, core, after)
        else:
            x = (before, CAPITAL if core[:1].isupper() else None, core, after)
        self[word] = x
        return x


_WORDS = _Words()


def skeleton(unit: str) -> tuple[int, list[tuple[int, int, int]]]:
    """The hash of a unit's template, with a slot for each part that varies, and (slot, kind, hash) of what fills them.

    Capitals within a sentence are values; neighbouring ones fill one slot together.
    """
    out: list[str] = []
    fills: list[list] = []
    begins, joins = True, False
    for word in unit.split():
        before, kind, text, after = _WORDS[word]
        if kind is None or kind == CAPITAL and begins:
            out.append(word.casefold())
            joins = False
        elif kind == CAPITAL and joins and not before:
            fills[-1][1] += " " + text
            out[-1] += after
            joins = not after
        else:
            fills.append([VALUE if kind == CAPITAL else kind, text])
            out.append(before + "\x03" + after)
            joins = kind == CAPITAL and not after
        begins = after[-1:] in (".", "!", "?", ":")
    slots_only = len(out) - len(fills) < LEAST_WORDS
    return _hash(" ".join(out)), [] if slots_only else [(i, kind, _hash(text)) for i, (kind, text) in enumerate(fills)]


def units(text: str) -> list[str]:
    """The sentences of a text outside fenced and inline code, without list, quote and heading marks."""
    out = []
    for line in _FENCE.sub("\x00\n", text).splitlines():
        line = _CODE.sub("\x01", line)
        bare = _LEAD.sub("", line).strip()
        if bare:
            out += [u for u in (x.strip() for x in _SENTENCE.split(bare)) if u]
    return out


def slots(unit: str) -> tuple[str, list[str]]:
    """The template of a unit and what stands in its marked slots."""
    fills = []

    def take(m: re.Match) -> str:
        if m[0][0] == "[" and m[0][1] != "[" and m[0].upper() != m[0] and not re.match(r"\[(?:insert|your|enter|add|fill|todo|tbd|placeholder)\b", m[0], re.I):
            return m[0]  # ordinary text in brackets
        fills.append(m[0])
        return "\x02"

    shape = PLACEHOLDERS.sub(take, unit)
    return (_masked(shape), fills) if fills else ("", [])


def _masked(shape: str) -> str:
    return re.sub(r"\s+", " ", _MASK.sub("\x03", shape)).casefold()


def aligned(template: str) -> tuple[str, list[str]]:
    """The words by which sentences meet a template, and for each slot the form of those that hold a value in it."""
    pieces = template.split("\x02")
    words = [re.findall(r"\w+", re.sub(r"^\w+" * (k > 0) + "|" * (0 < k < len(pieces) - 1) + r"\w+$" * (k < len(pieces) - 1), "", x)) for k, x in enumerate(pieces)]
    key = " ".join(max(words, key=len)[:ALIGNED_BY])
    literal = [re.sub(r"([^\w\s\x03])", r"\\\1", x) for x in pieces]
    value = lambda k, slot: "" if k == 0 else f"[^\x02]{{1,{VALUE_CHARS}}}" if k - 1 == slot else f".{{1,{VALUE_CHARS}}}"
    return key, ["(?s)^" + "".join(value(k, slot) + x for k, x in enumerate(literal)) + "$" for slot in range(len(pieces) - 1)]


def word_runs(shape: str) -> list[str]:
    ws = re.findall(r"\w+", shape)
    return sorted({" ".join(ws[i : i + n]) for n in range(1, ALIGNED_BY + 1) for i in range(len(ws) - n + 1)})


_FILLER_HINTS = ("blah", "asdf", "qwer", "zxcv", "foo bar baz", "xxxx", "will appear", "goes here", "comes here", "in this place", "sample", "dummy", "example", "placeholder", "write", "replace", "texte", "blindtext", "văn", "mẫu")
_MARK_HINTS = ("{", "[", "<", "$", "%", "@@", "__", "&lt;", "(fill", "(insert", "(enter", "tbd", "todo:")
_TALK_HINTS = ("e form", "replaced", "substituted", "expanded", "interpolated", "stand", "expands", "placeholder", "template", "r form", "ersetzt", "eingesetzt", "steht", "platzhalter", "la forme", "remplac", "tient lieu", "dạng", "thay")
_LETTERS = re.compile(r"[^\W\d_]+")


def has_filler(unit: str, latin: bool = True) -> bool:
    low = unit.casefold()
    if any(x in low for x in _FILLER_HINTS) and FILLER.search(unit) and not re.search(r"[\"“„«'][^\"”“»']{0,60}(?:lorem|blah|asdf|text goes here|sample|placeholder)", unit, re.I):
        return True
    ws = _LETTERS.findall(low) if latin else ()
    return len(ws) >= 5 and sum(w in LATIN for w in ws) >= 0.7 * len(ws)


def page_lines(text: str, all_units: list[str]) -> list[int] | None:
    """Numbers of the units that are neither errors nor page frames; None if no unit is an error. A text with fenced code is no page."""
    heading = re.match(r"\s*#\s+(\S+)\s*$", text.lstrip("﻿\n ").split("\n", 1)[0])
    rest, seen = [], False
    for i, u in enumerate(all_units):
        u = u.strip(" .\t")
        if not u or i == 0 and heading and u == heading[1]:
            continue
        if ERROR.match(u):
            seen = True
        else:
            rest.append((i, u))
    return [i for i, u in rest if not FRAME.match(u)] if seen else None


def _hash(text: str) -> int:
    """A hash that fits in 64 bits with a sign."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        columns: dict[str, list] = {c: [] for c in ("found", "talk", "filler", "at", "slot", "kind", "fill", "shapes", "page")}
        for text in b["text"]:
            us, low = units(text), text.casefold()
            marked, talking = any(x in low for x in _MARK_HINTS), any(x in low for x in _TALK_HINTS) and TALKS.search(text) is not None
            found, said, slots_, shapes = [], set(), set(), []
            for u in us:
                template, fills = slots(u) if marked else ("", [])
                if talking and TALKS.search(template if fills else u):
                    key, forms = aligned(template) if fills else ("", [])
                    found += [{"template": template, "slot": i, "fill": x, "key": key, "form": forms[i]} for i, x in enumerate(fills)]
                    said.add(template or _masked(u))
                else:
                    found += [{"template": template, "slot": i, "fill": x, "key": None, "form": None} for i, x in enumerate(fills)]
                shape, parts = skeleton(PLACEHOLDERS.sub("\x02", u) if fills else u)
                shapes.append(shape)
                slots_ |= {(shape, *x) for x in parts}
            hinted, latin = any(x in low for x in _FILLER_HINTS), not _ONLY_LATIN.isdisjoint(_LETTERS.findall(low))
            fenced = "\x00" in us
            page = None if fenced else page_lines(text, us)
            columns["found"].append(found)
            columns["talk"].append(sorted(said))
            columns["filler"].append((hinted or latin) and any(has_filler(u, latin) for u in us))
            for name, values in zip(("at", "slot", "kind", "fill"), zip(*sorted(slots_)) if slots_ else ((),) * 4):
                columns[name].append(values)
            columns["shapes"].append([] if fenced else sorted(set(shapes)))
            columns["page"].append(None if page is None else sorted({shapes[i] for i in page}))
        yield pd.DataFrame({"doc_id": b["doc_id"], **columns})


_SCAN = """doc_id bigint, found array<struct<template: string, slot: int, fill: string, key: string, form: string>>, talk array<string>, filler boolean,
    at array<bigint>, slot array<int>, kind array<int>, fill array<bigint>, shapes array<bigint>, page array<bigint>"""


def _bare(scan: DataFrame) -> DataFrame:
    """doc_id of records with a bare name, default or blank in a slot that other records of the template fill.

    Records are aligned by the template of each sentence. A slot is induced from what its records hold: it needs two
    different values, and twice as many values as identifiers, names and gaps, or it is a place for identifiers.
    """
    slot = scan.select("doc_id", F.inline(F.arrays_zip(F.col("at").alias("shape"), "slot", "kind", "fill")))
    empty = slot.where(F.col("kind").isin(NAME, MISSING))
    value = F.col("kind") == VALUE
    held = slot.groupBy("shape", "slot").agg(F.count_if(value).alias("values"), F.count_if(~value).alias("others"), F.min(F.when(value, F.col("fill"))).alias("a"), F.max(F.when(value, F.col("fill"))).alias("b"))
    induced = held.where("a <> b and values >= 2 * others").select("shape", "slot")
    induced = induced.join(empty.select("shape", "slot").distinct(), ["shape", "slot"], "left_semi")
    return salted_join(empty, induced, ["shape", "slot"], "left_semi", spread=F.col("doc_id")).select("doc_id")


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, unfilled, filler, error_page): each document with at least one of the three.

    Method: the sentences outside code are cut into a template and what stands in its slots, be it a mark, a value, a
    name or nothing, and records of the same template are aligned over the whole corpus. A slot that others fill with
    values is unfilled in a record that holds the name of a field, a default or a blank there. A slot that still holds
    a template engine's mark is unfilled, unless it is a constant: no record has another text there and the wording
    talks about placeholders (TALKS), however many records there are. Filler is dummy Latin, keyboard runs and
    instructions of page builders. An error page consists of nothing but errors, notices and page frames; lines beside
    them count as frame if PAGES such pages repeat them and hardly any other record has them, however long the page is.

    Defined cases: NULL and empty texts, and NULL ids, give no row; each row of documents counts by its doc_id,
    a repeated one once; texts are read whole.
    """
    docs = spread(documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "text"))
    scan = Scratch(documents.sparkSession, "residue").save(docs.mapInPandas(_scan, _SCAN), "scan")
    slot = scan.select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.*")
    same = slot.where("key is not null").groupBy("template", "slot").agg(F.min("fill").alias("a"), F.max("fill").alias("b"), F.min("key").alias("key"), F.min("form").alias("form"))
    same = same.where("a = b").select("template", "slot", "key", "form")
    said = scan.select(F.explode("talk").alias("shape")).distinct().select("shape", F.explode(F.udf(lambda x: word_runs(x), "array<string>")("shape")).alias("key"))
    filled = said.join(same, "key").where(F.rlike("shape", F.col("form"))).select("template", "slot").distinct()
    same = same.join(filled, ["template", "slot"], "left_anti").select("template", "slot")
    unfilled = salted_join(slot, same, ["template", "slot"], "left_anti").select("doc_id", F.lit("unfilled").alias("kind"))
    filler = scan.where("filler").select("doc_id", F.lit("filler").alias("kind"))
    bare = _bare(scan).select("doc_id", F.lit("unfilled").alias("kind"))
    whole = scan.where(F.size("page") == 0).select("doc_id", F.lit("error_page").alias("kind"))
    more = scan.where(F.size("page") > 0).select("doc_id", F.explode("page").alias("line"))
    lines = scan.select(F.col("page").isNotNull().alias("error"), F.explode("shapes").alias("line")).groupBy("line").agg(F.count_if("error").alias("pages"), F.count(F.lit(1)).alias("n"))
    repeated = lines.where((F.col("pages") >= PAGES) & (F.col("pages") >= PURE * F.col("n"))).select("line", F.lit(1).alias("known"))
    known = salted_join(more, repeated, ["line"], "left").groupBy("doc_id").agg(F.min(F.coalesce("known", F.lit(0))).alias("all_known"))
    framed = known.where("all_known = 1").select("doc_id", F.lit("error_page").alias("kind"))
    flag = lambda k: F.max(F.col("kind") == k).alias(k)
    return unfilled.unionByName(bare).unionByName(filler).unionByName(whole).unionByName(framed).groupBy("doc_id").agg(flag("unfilled"), flag("filler"), flag("error_page"))
