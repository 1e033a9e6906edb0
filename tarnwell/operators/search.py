"""Ranked full-text, regular-expression and vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dice, is_test_path, split_case, tokens, trigram_buckets

#: Usual parameters of BM25.
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25(docs: DataFrame, query: list[str], prefix: bool = False) -> DataFrame:
    """(doc_id, score, n_terms) of documents (doc_id, text) with any of the terms; prefix also counts longer words.

    Lengths and term counts are taken in one pass over all documents; only counts of the query's terms are kept.
    """
    q = list(dict.fromkeys(t.lower() for t in query))
    words = F.col("words")
    hits = lambda t: F.size(F.filter(words, lambda w: w.startswith(t) if prefix else w == F.lit(t)))
    counted = docs.where("text is not null").select("doc_id", terms(F.col("text")).alias("words")).select("doc_id", F.size(words).alias("len"), *[hits(t).alias(f"t{i}") for i, t in enumerate(q)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(q))])
    hits_any = counted.where(" or ".join(f"t{i} > 0" for i in range(len(q))))
    x = hits_any.withColumn("one", F.lit(1)).join(F.broadcast(stats.withColumn("one", F.lit(1))), "one")  # stats is one row
    score = F.lit(0.0)
    for i in range(len(q)):
        idf = F.log(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        score = score + idf * F.col(f"t{i}") * (K1 + 1) / (F.col(f"t{i}") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    n_terms = sum((F.when(F.col(f"t{i}") > 0, 1).otherwise(0) for i in range(len(q))), F.lit(0))
    return x.select("doc_id", F.round(score, 6).alias("score"), n_terms.alias("n_terms"))


def search_docs(docs: DataFrame, query: list[str], most: int = 20, per_file: int = 1) -> DataFrame:
    """(doc_id, tier, score): all terms first (strict), then any (broad); at most per_file of a file; the best rows."""
    s = bm25(docs, query).withColumn("tier", F.when(F.col("n_terms") == len(set(query)), "strict").otherwise("broad")).join(docs.select("doc_id", "file_path"), "doc_id")
    order = [F.desc("tier"), F.desc("score"), F.col("doc_id")]
    s = s.withColumn("rn", F.row_number().over(Window.partitionBy(F.coalesce("file_path", F.col("doc_id").cast("string"))).orderBy(*order)))
    s = s if per_file <= 0 else s.where(F.col("rn") <= per_file)
    return s.orderBy(*order).limit(most).select("doc_id", "tier", "score")


def search_lines(docs: DataFrame, pattern: str, key: str, text: str, per_file: int = 0) -> DataFrame:
    """(key, line, n_hits, first): lines that match a regular expression, numbered from 1; whole texts."""
    lines = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\r?\n")).alias("p", "l")).where(F.col("l").rlike(pattern))
    r = lines.select(key, (F.col("p") + 1).alias("line"), F.regexp_count("l", F.lit(pattern)).alias("n_hits"), F.regexp_extract("l", pattern, 0).alias("first"))
    return r if per_file <= 0 else r.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("line"))).where(F.col("rn") <= per_file).drop("rn")


def search_matches(docs: DataFrame, pattern: str, key: str, text: str) -> DataFrame:
    """(key, line, match): every match of a regular expression within a line, lines numbered from 1; whole texts."""
    lines = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\r?\n")).alias("p", "l")).where(F.col("l").rlike(pattern))
    return lines.select(key, (F.col("p") + 1).alias("line"), F.explode(F.regexp_extract_all("l", F.lit(pattern), F.lit(0))).alias("match"))


def after_path(found: DataFrame, path: str, skip: int, most: int) -> DataFrame:
    """(path, line, n_hits, truncated) of search_lines() by path: the page of rows from path on, without its first skip
    rows; truncated says whether more follow."""
    rows = found.where(F.col("path") >= path).orderBy("path", "line").offset(skip).limit(most + 1)
    rows = rows.withColumn("rn", F.row_number().over(Window.orderBy("path", "line")))  # a page, most + 1 rows at most
    return rows.withColumn("truncated", F.max("rn").over(Window.partitionBy(F.lit(1))) > most).where(F.col("rn") <= most).drop("rn")


def symbol_candidates(symbols: DataFrame, name: str) -> DataFrame:
    """(repo_id, symbol_id, confidence): exact .96, prefix .88, contained .72; types and functions +.03, tests -.08; then
    less 0.01 a rank, 0.2 at most; within 0 and 1."""
    n, x = F.lower("name"), name.lower()
    base = F.when(n == x, 0.96).when(n.startswith(x), 0.88).when(n.contains(x), 0.72)
    kind = F.when(F.col("kind").isin("class", "interface", "function", "method"), 0.03).otherwise(0.0)
    c = symbols.withColumn("base", base + kind - F.when(is_test_path(F.col("file_path")), 0.08).otherwise(0.0)).where("base is not null")
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("base"), F.length("name"), "name", "symbol_id")) - 1
    return c.withColumn("r", rank).select("repo_id", "symbol_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("base") - F.least(F.col("r") * 0.01, F.lit(0.2)))), 6).alias("confidence"))


def symbol_search(symbols: DataFrame, query: list[str]) -> DataFrame:
    """(repo_id, symbol_id, matched): symbols with a word that begins with each of the terms."""
    t = tokens(F.col("name"))
    starts = lambda q: F.exists(t, lambda w: w.startswith(q))
    hit = [starts(q) for q in query]
    matched = sum((h.cast("int") for h in hit), F.lit(0))
    return symbols.withColumn("matched", matched).where(F.col("matched") == len(query)).select("repo_id", "symbol_id", "matched")


def knn(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest rows of each query row by Euclidean distance, exact, ties by id.

    A stated set of queries against all rows, in blocks: each pair of a block of queries and a block of rows is one
    matrix product that leaves k rows a query; those are ranked again at the end. The query itself is left out.
    """
    n_q, n_v = (max(1, -(-df.count() // block)) for df in (queries, vectors))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    q = queries.select(F.col("vec_id").alias("query_id"), "embedding", part(n_q).alias("qb")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))))
    v = vectors.select("vec_id", "embedding", part(n_v).alias("vb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("vec_id")
            ids, x = b["vec_id"].to_numpy(), np.stack(b["embedding"].to_numpy()).astype(float)
            for qid, e in zip(a["query_id"], a["embedding"]):
                dist = np.sqrt(((x - np.asarray(e, float)) ** 2).sum(axis=1))
                best = np.lexsort((ids, dist))[: k + 1]
                out += [(qid, int(ids[i]), float(dist[i])) for i in best if ids[i] != qid]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "distance"])

    found = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(near, "query_id bigint, vec_id bigint, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id", F.round("distance", 5).alias("distance"), "rank")


def vector_index(names: DataFrame, key: list[str]) -> DataFrame:
    """(key, bucket, weight) of (key, name): the trigram vectors of names, of length 1, without their zeros."""
    n = names.select(*key, F.explode(trigram_buckets(F.lower(split_case(F.col("name"))))).alias("bucket")).groupBy(*key, "bucket").agg(F.count(F.lit(1)).alias("n"))
    norm = n.groupBy(*key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return n.join(norm, key).select(*key, "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def padded(found: DataFrame, names: DataFrame, asked: str, most: int, enough: int = 3) -> DataFrame:
    """(repo_id, symbol_id, how, distance): found as it is if it has enough rows; else those of names (repo_id, symbol_id,
    name) whose vectors are nearest to that of the word asked for are put after it (fuzzy), up to most in all; ties by
    repository and id."""
    n = found.count()
    if n >= enough or n >= most:
        return found
    keys = ["repo_id", "symbol_id"]
    query = vector_index(names.sparkSession.createDataFrame([(asked,)], "name string"), ["name"]).select("bucket", F.col("weight").alias("q"))
    index = vector_index(names, keys)
    shared = index.join(F.broadcast(query), "bucket", "left").groupBy(*keys).agg(F.sum(F.coalesce(F.col("weight") * F.col("q"), F.lit(0.0))).alias("dot"))  # query: the buckets of a word
    near = shared.join(found.select(*keys), keys, "left_anti").withColumn("distance", F.round(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("dot"))), 6))
    near = near.orderBy("distance", *keys).limit(most - n)
    return found.unionByName(near.select(*keys, F.lit("fuzzy").alias("how"), "distance"))


def nearest_headings(headings: DataFrame, asked: str, most: int = 10) -> DataFrame:
    """(doc_id, heading, score): bigram similarity to a heading or its beginning, 0.9 at least if it is contained."""
    h, a = F.lower("heading"), F.lit(asked.lower())
    score = F.greatest(dice(h, a), dice(F.substring(h, 1, len(asked) + 2), a), F.when(h.contains(asked.lower()), 0.9).otherwise(0.0))
    return headings.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "doc_id", "heading").limit(most).select("doc_id", "heading", "score")


def intent(texts: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """(doc_id, intent): the rule with most keywords in a text, ties by name, other without any."""
    w = terms(F.col("text"))
    hits = F.array(*[F.struct((-F.size(F.array_intersect(w, F.array(*map(F.lit, words))))).alias("n"), F.lit(name).alias("name")) for name, words in sorted(rules.items())])
    best = F.array_min(hits)
    return texts.where("text is not null").select("doc_id", F.when(best["n"] < 0, best["name"]).otherwise("other").alias("intent"))
