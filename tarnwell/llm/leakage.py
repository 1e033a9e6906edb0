"""Problem 7: evaluation texts leaking into training text."""

from __future__ import annotations

import base64
import html
import quopri
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import unquote

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .syntax import spread

#: Words in a fingerprinted gram, and grams in a window: any shared span of GRAM + WINDOW - 1 words shares a fingerprint.
GRAM, WINDOW = 4, 3
#: Words in a gram of the extension.
STEP = 3
#: Least part of an item's words that a document repeats, in order and in one stretch. Leaks repeat four tenths or more,
#: give or take a few words; a document that holds a fifth and happens to share short runs besides comes to a third.
LEAST = 0.37
#: Bytes of item texts that are indexed and sent to the executors at once; larger sets of items are searched block by block.
BLOCK_BYTES = 8 << 20

_INLINE = re.compile(r"</?(?:b|i|u|em|strong|code|span|wbr|mark|font|a|small|sub|sup)(?:\s[^<>]*+)?/?>", re.I)
_TAG = re.compile(r"""</?[a-zA-Z][\w:-]*+(?:\s++(?:[\w:@.-]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>]++))?+|/(?=>)))*+\s*+/?>|<!--[\s\S]*?-->|<![a-zA-Z][^<>]*+>|<[a-zA-Z][^<>]{0,400}>""")
_ENCODED = re.compile(r"[A-Za-z0-9+/_-]{24}")
_PREFIX = re.compile(r"(?m)^[>#*|\s]+|^//+\s*")
_BASE64 = re.compile(r"(?:[A-Za-z0-9+/_-]{20,}\s{0,2})*[A-Za-z0-9+/_-]{24,}={0,2}")
_HEX = re.compile(r"(?:[0-9a-fA-F]{2}){12,}")
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = regex.compile(r"\p{Cf}+")


def words(text: str, depth: int = 0) -> list[str]:
    """The words of a text without its markup, escapes, invisible characters and case.

    What is encoded in base64, hexadecimal or quoted-printable anywhere in the text is decoded and put after it, up to
    three times over.
    """
    if "\\" in text:
        text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)
        if '\\"' in text or "\\n" in text:
            text = re.sub(r"\\[nrt](?![a-z]\w*[/\\.])", " ", text)
    if text.count("%") > 2 and len(re.findall(r"%[0-9a-fA-F]{2}", text)) > 2:
        text = unquote(text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    pieces = _decoded(text) if _ENCODED.search(text) else []
    if text.count("=") > 2 and len(re.findall(r"=(?:[0-9A-F]{2}|\r?\n)", text)) > 2:
        pieces.append(quopri.decodestring(text.encode("utf-8", "surrogatepass")).decode("utf-8", "replace"))
    more = [w for piece in pieces for w in words(piece, depth + 1)] if depth < 3 else []
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.casefold()) + more


def _decoded(text: str) -> list[str]:
    out = []
    for m in _BASE64.finditer(_PREFIX.sub("", text)):
        piece = re.sub(r"\s", "", m[0])
        try:
            raw = bytes.fromhex(piece) if _HEX.fullmatch(piece) else base64.b64decode(piece.translate({45: 43, 95: 47}), validate=True)
            found = raw.decode("utf-8")
        except ValueError:
            continue
        if found.isprintable() or "\n" in found:
            out.append(found)
    return out


def grams(ws: list[str], n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words."""
    if len(ws) < n:
        return np.empty(0, np.uint64)
    return _runs(hashes(ws), n)


class _Hashes(dict):
    """Hashes of words seen before."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()


def hashes(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, ws), np.uint64, len(ws))


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)] + np.uint64(1)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash (the rightmost of equal ones) of each window; of a shorter text its least."""
    if len(hashes) == 0:
        return np.empty(0, np.int64)
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))])
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], axis=1))


def covered(item: list[str], doc: list[str], enough: float = 1.0) -> float:
    """The part of the item's words that doc repeats in their order within one stretch, by runs of STEP words or more.

    Stretches are tried in order of the item's grams in them, until one covers enough or no other can cover more.
    """
    n = len(item)
    step = min(STEP, n)
    if not n or len(doc) < step:
        return 0.0
    where: dict[tuple, list[int]] = {}
    for i in range(n - step + 1):
        where.setdefault(tuple(item[i : i + step]), []).append(i)
    hits = [(j, where[g]) for j, g in ((j, tuple(doc[j : j + step])) for j in range(len(doc) - step + 1)) if g in where]
    if not hits:
        return 0.0
    reach = int(1.5 * n) + 20
    single = lambda k: len(hits[k - 1][1]) == len(hits[k][1]) == 1 and hits[k][0] - hits[k - 1][0] == hits[k][1][0] - hits[k - 1][1][0] == 1
    held: dict[int, int] = {}
    matched = gaps = b = 0
    stretches = []
    for a in range(len(hits)):  # the stretch that begins with each hit, and the most that it can cover
        while b < len(hits) and hits[b][0] - hits[a][0] <= reach:
            at = hits[b][1]
            held[at[0]] = held.get(at[0], 0) + 1
            matched += held[at[0]] <= len(at)
            gaps += b > a and not single(b)
            b += 1
        if not stretches or b > stretches[-1][2]:  # else the last one holds all of it
            stretches.append((min(n, matched + (step - 1) * (gaps + 1)), a, b))
        at = hits[a][1]
        matched -= held[at[0]] <= len(at)
        held[at[0]] -= 1
        gaps -= a + 1 < b and not single(a + 1)
    best = 0
    for most, a, b in sorted(stretches, key=lambda x: (-x[0], x[1])):
        if most <= best or best >= enough * n:
            break
        best = max(best, _chain(hits[a:b], step))
    return best / n


def _chain(hits: list[tuple[int, list[int]]], step: int) -> int:
    """The most words of the item that a chain of hits, which goes on in both texts, covers; no word of either counts twice."""
    size = max(at[-1] for _, at in hits) + 2
    ending, tree = [0] * size, [0] * (size + 1)  # by place in the item; the greatest of all places up to one, as a Fenwick tree
    recent: list[tuple[int, list[int], list[int], list[int]]] = []  # hits that overlap with the next ones in the document
    best = 0
    for j, at in hits:
        while recent and recent[0][0] <= j - step:
            for i, most in zip(recent[0][1], recent[0][2]):
                if most > ending[i]:
                    ending[i], k = most, i + 1
                    while k <= size:
                        tree[k], k = max(tree[k], most), k + (k & -k)
            recent.pop(0)
        here = []
        for i in at:
            most, k = 0, i - step + 1
            while k > 0:
                most, k = max(most, tree[k]), k & (k - 1)
            most += step
            for back in range(1, min(step, i + 1)):
                if ending[i - back]:
                    most = max(most, ending[i - back] + back)
            for before, places, mosts, upto in recent:
                d = j - before
                k = bisect_right(places, i - d)
                if k:
                    most = max(most, upto[k - 1] + d)
                while k < len(places) and places[k] < i:
                    most, k = max(most, mosts[k] + i - places[k]), k + 1
            here.append(most)
        best = max(best, *here)
        recent.append((j, at, here, list(accumulate(here, max))))
    return best


class Items:
    """The winnowed fingerprints and the grams of some items, to look up those of a document all at once."""

    def __init__(self, rows: list[tuple[int, str]], least: float):
        self.ids, self.least = [r[0] for r in rows], least
        self.words = [words(r[1]) for r in rows]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.prints = {n: self._owned([self._print(w) if min(len(w), GRAM) == n else [] for w in self.words]) for n in range(1, GRAM + 1)}
        self.grams = {n: self._owned([grams(w, n) if min(len(w), STEP) == n else [] for w in self.words], True) for n in range(1, STEP + 1)}

    @staticmethod
    def _print(ws: list[str]) -> np.ndarray:
        h = grams(ws, min(len(ws), GRAM))
        return np.unique(h[winnow(h)])

    def _owned(self, per_item: list, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes in order, each with its item, or with its place among all words of all items."""
        h = np.concatenate([np.asarray(x, np.uint64) for x in per_item]) if per_item else np.empty(0, np.uint64)
        owner = np.concatenate([np.arange(len(x)) + self.start[i] if places else np.full(len(x), i) for i, x in enumerate(per_item)]).astype(np.int64) if per_item else np.empty(0, np.int64)
        order = np.argsort(h, kind="stable")
        return h[order], owner[order]

    @staticmethod
    def _met(table: tuple[np.ndarray, np.ndarray], found: np.ndarray) -> np.ndarray:
        """What the table holds of the hashes in found, which are distinct."""
        h, owner = table
        lo, hi = np.searchsorted(h, found, "left"), np.searchsorted(h, found, "right")
        some = hi > lo
        lo, n = lo[some], (hi - lo)[some]
        if not len(n):
            return owner[:0]
        return owner[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]

    def match(self, text: str) -> list[tuple[int, float]]:
        """(item_id, share) of the items of which the text repeats at least the least share."""
        ws = words(text)
        h = hashes(ws)
        shared = []
        for n, table in self.prints.items():
            if len(table[0]):
                g = _runs(h, n)
                shared.append(self._met(table, np.unique(g[winnow(g)] if n == GRAM else g)))
        candidates = np.unique(np.concatenate(shared)) if shared else []
        if not len(candidates):
            return []
        seen = np.zeros(int(self.start[-1]), bool)
        for n, table in self.grams.items():
            if len(table[0]):
                at = self._met(table, np.unique(_runs(h, n)))
                for k in range(n):
                    seen[at + k] = True
        most = np.add.reduceat(np.append(seen, False).astype(np.int64), self.start[:-1]) if len(self.lengths) else self.lengths
        out = []
        for i in candidates.tolist():
            if most[i] >= self.least * self.lengths[i]:  # words that the document holds in any order are the most it can repeat
                share = covered(self.words[i], ws)
                if share >= self.least:
                    out.append((self.ids[i], share))
        return out


def _blocks(items: DataFrame) -> list[list[tuple[int, str]]]:
    """The items, each (id, text) once, in blocks of about BLOCK_BYTES at most."""
    once = items.where(F.col("item_id").isNotNull() & (F.length("text") > 0)).select("item_id", "text").distinct()
    n = -(-(once.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    return [[tuple(r) for r in once.where(part == k).orderBy("item_id", "text").collect()] for k in range(n)]


def leaks(documents: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, share): documents that repeat at least that share of an item's words in one stretch.

    Method: winnowing. Of each window of WINDOW grams of GRAM words the least hash is kept, so any shared span of
    GRAM + WINDOW - 1 words is found by an equal fingerprint; pairs that share one are extended to the longest
    chain of equal runs in the same order. Texts are compared without markup, escapes, encodings, invisible
    characters, case and punctuation, whole and in any layout.

    The index of the items, a block of at most BLOCK_BYTES of their text at a time, is broadcast and the documents are
    read once a block, each text where it lies; no text is moved, and no fingerprint is left out however common.

    Defined cases: NULL and empty texts hold nothing; ids that occur with several texts are taken as they come; rows
    without id are ignored; an item shorter than a gram is looked up as a whole, by all runs of its length.
    """
    docs = spread(documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "text"))
    schema = "doc_id bigint, item_id bigint, share double"
    found = documents.sparkSession.createDataFrame([], schema)
    for block in _blocks(items):
        index = documents.sparkSession.sparkContext.broadcast(Items(block, least))

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = [(d, *m) for d, text in zip(b["doc_id"], b["text"]) for m in index.value.match(text)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "share"]).astype({"doc_id": "int64", "item_id": "int64", "share": "float64"})

        found = found.unionByName(docs.mapInPandas(search, schema))
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, n_documents, best_share): which items leaked, and into how many documents."""
    found = leaks(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.round(F.max("share"), 6).alias("best_share"))
    return found.join(items.select("item_id", "suite").distinct(), "item_id").select("item_id", "suite", "n_documents", "best_share")
