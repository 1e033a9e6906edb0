"""Problem 8: mixing sources to target weights."""

from __future__ import annotations

import base64
import random
import zlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .syntax import spread

#: A folder with byte_bpe_50k.tiktoken and the other public vocabularies; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how that vocabulary splits text before merging bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FAN_IN = 16
_DECIDED = "source string, doc_id bigint, n_tokens bigint, base int, p double, copies int, done boolean"


@cache
def _encoder(folder: str):
    import tiktoken

    with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens): the tokens of each whole text; 0 for NULL and empty ones."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizers).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": [sum(len(encode(t[i : i + 500_000])) for i in range(0, len(t), 500_000)) if isinstance(t, str) else 0 for t in b["text"]]})

    docs = spread(documents.where(F.col("doc_id").isNotNull()).select("doc_id", "source", "text"))
    return docs.mapInPandas(count, "doc_id bigint, source string, n_tokens bigint")


def plan(counts: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, n_documents, available, expected): one row per source of targets.

    expected is how often a document of the source is used on average. Without total_tokens the mix is the largest
    in which every source that has tokens reaches its share within its cap; a source without any can't. With it, a
    source whose share needs more than its cap gives all it may. Of several rows of a source the first by share and
    cap counts.
    """
    t = targets.where((F.col("target_share") > 0) & F.col("source").isNotNull()).groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("x")).select("source", "x.*")
    have = counts.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("available"))
    p = t.join(have, "source", "left").withColumns({"n_documents": F.coalesce("n_documents", F.lit(0)), "available": F.coalesce("available", F.lit(0))})
    if total_tokens is None:
        total = p.where((F.col("available") > 0) & (F.col("max_repeats") > 0)).agg(F.min(F.col("available") * F.col("max_repeats") / F.col("target_share"))).scalar()
    else:
        total = F.lit(float(total_tokens))
    wanted = F.col("target_share") * total / F.col("available")
    return p.withColumn("expected", F.when(F.col("available") > 0, F.least(wanted, F.greatest(F.col("max_repeats"), F.lit(0)).cast("double"))).otherwise(F.lit(0.0)))


def pivot(rows: list[list], last: bool, seed: int = 0) -> list[list]:
    """Rounds the fractions p of rows (source, doc_id, n_tokens, base, p, copies, done) of one source to 0 or 1.

    Pivotal rounding: of a pair of open rows, token mass moves from one to the other until one is 0 or 1; which way
    is drawn such that each p keeps its mean, and the mass of the pair stays as it is. The other row goes on to the
    next pair, so at most one row stays open; if last, it is rounded by a draw. Draws depend on ids alone.
    """
    open_row: list | None = None
    for row in rows:
        if row[6]:
            continue
        if row[2] <= 0 or row[4] <= 1e-12 or row[4] >= 1 - 1e-12:
            row[5], row[6] = (row[3] + (row[4] >= 0.5) if row[2] > 0 else 0), True
            continue
        if open_row is None:
            open_row = row
            continue
        a, b = open_row, row
        ma, mb = a[4] * a[2], b[4] * b[2]
        to_b, to_a = min(ma, (1 - b[4]) * b[2]), min(mb, (1 - a[4]) * a[2])
        if random.Random(zlib.crc32(f"{seed}:{a[1]}:{b[1]}:{a[4]:.12f}".encode())).random() * (to_a + to_b) < to_a:
            a[4], b[4] = (ma - to_b) / a[2], (mb + to_b) / b[2]
        else:
            a[4], b[4] = (ma + to_a) / a[2], (mb - to_a) / b[2]
        open_row = None
        for x in (a, b):
            if x[4] <= 1e-9 or x[4] >= 1 - 1e-9:
                x[5], x[6] = x[3] + (x[4] >= 0.5), True
            else:
                open_row = x
    if last and open_row is not None:
        open_row[5] = open_row[3] + (random.Random(zlib.crc32(f"{seed}:{open_row[1]}:last".encode())).random() < open_row[4])
        open_row[6] = True
    return rows


_COLUMNS = [c.split()[0] for c in _DECIDED.split(", ")]


def _leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    carried: dict[str, list] = {}
    for b in batches:
        by: dict[str, list] = {s: [r] for s, r in carried.items()}
        for row in b[_COLUMNS].values.tolist():
            by.setdefault(row[0], []).append(row)
        out = []
        carried = {}
        for source, rows in by.items():
            for row in pivot(rows, False):
                if row[6]:
                    out.append(row)
                else:
                    carried[source] = row
        yield pd.DataFrame(out, columns=_COLUMNS)
    yield pd.DataFrame(list(carried.values()), columns=_COLUMNS)


def _node(last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(pivot(rows.sort_values("doc_id")[_COLUMNS].values.tolist(), last), columns=_COLUMNS)
        return out.assign(node=rows["node"].iloc[0])

    return run


def copies(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizers: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(documents with (doc_id, source, n_tokens, copies), plan).

    Every document of a source gets the whole part of the expected number; the fractional parts are rounded by
    pivot() within each task, which leaves one open document a source, and these climb a tree of FAN_IN tasks a
    node, until one a source is left. So a source misses its share by less than one document, whatever its size.
    """
    scratch = Scratch(documents.sparkSession, "mixing")
    counts = scratch.save(token_counts(documents, tokenizers), "counts")
    sources = scratch.save(plan(counts, targets, total_tokens), "plan")
    wanted = sources.select("source", "expected")
    wanted = F.broadcast(wanted) if wanted.count() <= 100_000 else wanted
    base = F.floor(F.col("expected") + 1e-12).cast("int")
    start = counts.join(wanted, "source").select("source", "doc_id", "n_tokens", base.alias("base"), F.greatest(F.col("expected") - base, F.lit(0.0)).alias("p"), F.lit(0).alias("copies"), F.lit(False).alias("done"))
    leaves = scratch.save(start.mapInPandas(_leaf, _DECIDED).withColumn("node", F.spark_partition_id()), "leaves")
    done, left = leaves.where("done").drop("node"), leaves.where("not done")
    width = (leaves.agg(F.max("node")).first()[0] or 0) + 1
    k = 0
    while width > 1:
        width = -(-width // FAN_IN)
        left = left.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("int"))
        final = width == 1
        met = scratch.save(left.groupBy("source", "node").applyInPandas(_node(final), _DECIDED + ", node int"), f"round{k}")
        done, left = done.unionByName(met.where("done").drop("node")), met.where("not done")
        k += 1
    if not k:
        done = done.unionByName(left.groupBy("source", "node").applyInPandas(_node(True), _DECIDED + ", node int").drop("node"))
    return done.select("doc_id", "source", "n_tokens", "copies"), sources


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the documents of the mix and how often each is used (once or more).

    Defined cases: documents without source, of a source without a target or without doc_id are left out; empty
    texts have no tokens and are not used; no document is used more than max_repeats times.
    """
    return copies(documents, targets, total_tokens, tokenizers)[0].where("copies > 0")


def shares(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(source, target_share, max_repeats, n_documents, available_tokens, used_documents, mix_tokens, reached_share)."""
    used, sources = copies(documents, targets, total_tokens, tokenizers)
    got = used.groupBy("source").agg(F.count_if(F.col("copies") > 0).alias("used_documents"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mix_tokens"))
    got = Scratch(documents.sparkSession, "shares").save(got, "got")
    total = got.agg(F.sum("mix_tokens")).scalar()
    r = sources.join(got, "source", "left").withColumns({"used_documents": F.coalesce("used_documents", F.lit(0)), "mix_tokens": F.coalesce("mix_tokens", F.lit(0))})
    return r.select("source", "target_share", "max_repeats", "n_documents", F.col("available").alias("available_tokens"), "used_documents", "mix_tokens", F.round(F.try_divide(F.col("mix_tokens"), total), 6).alias("reached_share"))
