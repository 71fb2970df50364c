"""Lexical, semantic and fused search, and grouping by similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidewell.functions.vectors import mean_vector
from tidewell.plans.scratch import BROADCAST_BYTES, broadcast_if_small, row_bytes

K1, B = 1.2, 0.75
WORD = r"[\p{L}\p{N}]+"


def tokens(df: DataFrame, id_col: str, text: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), 0)
    return df.select(F.col(id_col).alias("article_id"), F.explode(words).alias("term"))


def bm25(articles: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, article_id, score): BM25 of every article that holds a query term.

    ``queries``: (query_id, term).  Every word carries its article's length, so that only
    postings of query terms are shuffled, and once: by article, so that counting words and
    summing weights need no further one.  The number of articles and their mean length come
    as one row.
    """
    words = F.regexp_extract_all(F.lower(F.col("content")), F.lit(WORD), 0)
    sized = articles.select("article_id", words.alias("words"))
    queries = broadcast_if_small(queries.distinct())
    terms = queries.select("term").distinct()
    few = row_bytes(terms) <= BROADCAST_BYTES
    held = sized.select("article_id", F.size("words").alias("size"), F.explode("words").alias("term")).join(F.broadcast(terms) if few else terms, "term", "left_semi")
    postings = held.repartition("article_id").groupBy("article_id", "size", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = F.broadcast(df) if few else df  # no more rows than there are terms
    whole = articles.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.regexp_count(F.lower(F.col("content")), F.lit(WORD))).alias("total"))
    average = F.greatest("total", F.lit(1)) / F.greatest("n", F.lit(1.0))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / average))
    scored = postings.join(df, "term").join(F.broadcast(whole)).select("article_id", "term", weight.alias("w"))
    return scored.join(queries, "term").groupBy("query_id", "article_id").agg(F.sum("w").alias("score"))


def rank_score(hits: DataFrame, limit: int) -> DataFrame:
    """Top hits per query with 1 - i/n as score (a single hit: 1)."""
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "article_id")
    top = hits.withColumn("i", F.row_number().over(best)).where(F.col("i") <= limit)
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return top.select("query_id", "article_id", (1.0 - (F.col("i") - 1) / n).alias("fts"))


#: Vectors of a block; every block of the one side meets every block of the other.
BLOCK = 10_000


def _matrix(lists: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: rows of that length and their unit vectors (zero vectors stay zero)."""
    lists = lists.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        x = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
        norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
        out[n] = rows, np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)
    return out


def _nearest(left: DataFrame, right: DataFrame, a: str, b: str, least: float, limit: int) -> DataFrame:
    """(a, b, cos): for every left vector the nearest right ones of each block, over a floor.

    Both sides are dealt into blocks and a pair of blocks is one matrix product; vectors of
    different lengths are not compared.  Callers take the best over all blocks.
    """
    n, m = left.count(), right.count()
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-m // BLOCK))
    own, other = F.pmod(F.xxhash64(a), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64(b), F.lit(parts)).cast("int")
    lefts = left.select(a, "vector", own.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    rights = right.select(b, "vector", other.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        ids, columns = y.column(b).to_numpy(), _matrix(y.column("vector"))
        for size, (rows, vectors) in _matrix(x.column("vector")).items():
            if size not in columns:
                continue
            others, matrix = columns[size]
            for at in range(0, len(rows), 512):
                cos = vectors[at : at + 512] @ matrix.T
                for r, line in zip(rows[at : at + 512], cos, strict=True):
                    hits = np.flatnonzero(line > least)
                    order = hits[np.lexsort((ids[others[hits]], -np.round(line[hits], 9)))[:limit]]
                    for c, v in zip(found, (np.full(len(order), r), others[order], line[order]), strict=True):
                        c.append(v)
        r, o, c = (np.concatenate(v) if v else np.zeros(0, kind) for v, kind in zip(found, (np.int64, np.int64, float), strict=True))
        return pa.table([x.column(a).take(pa.array(r, pa.int64())), y.column(b).take(pa.array(o, pa.int64())), pa.array(c, pa.float64())], names=[a, b, "cos"])

    return lefts.groupBy("block", "part").cogroup(rights.groupBy("block", "part")).applyInArrow(best, f"{a} long, {b} long, cos double")


def semantic(vectors: DataFrame, queries: DataFrame, least: float = 0.3, limit: int = 20) -> DataFrame:
    """(query_id, article_id, cos): nearest vectors of each query vector over a floor."""
    left = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    right = vectors.select(F.col("article_id").cast("long").alias("article_id"), F.col("embedding").cast("array<double>").alias("vector"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("cos", 9)), "article_id")
    near = _nearest(left, right, "query_id", "article_id", least, limit)
    return near.withColumn("i", F.row_number().over(best)).where(F.col("i") <= limit).drop("i")


def fuse(lexical: DataFrame, near: DataFrame, limit: int = 20) -> DataFrame:
    """Union of both hit lists; 0.6 lexical + 0.4 cosine where both found an article."""
    both = F.col("fts").isNotNull() & F.col("cos").isNotNull()
    score = F.when(both, 0.6 * F.col("fts") + 0.4 * F.col("cos")).otherwise(F.coalesce("fts", "cos"))
    kind = F.when(both, "both").when(F.col("fts").isNotNull(), "fts").otherwise("semantic")
    joined = lexical.join(near, ["query_id", "article_id"], "full_outer").select("query_id", "article_id", score.alias("score"), kind.alias("match_type"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "article_id")
    return joined.withColumn("i", F.row_number().over(best)).where(F.col("i") <= limit).drop("i")


def centroids(vectors: DataFrame, members: DataFrame) -> DataFrame:
    return mean_vector(vectors.join(members, "article_id"), "group_id")


def assign(vectors: DataFrame, cents: DataFrame, least: float = 0.75) -> DataFrame:
    """(article_id, group_id, cos): best centroid of every article, group null below ``least``."""
    left = vectors.select(F.col("article_id").cast("long").alias("article_id"), F.col("embedding").cast("array<double>").alias("vector"))
    right = cents.select(F.col("group_id").cast("long").alias("group_id"), F.col("centroid").cast("array<double>").alias("vector"))
    near = _nearest(left, right, "article_id", "group_id", -2.0, 1)
    best = near.groupBy("article_id").agg(F.max(F.struct(F.round("cos", 9).alias("cos"), (-F.col("group_id")).alias("g"))).alias("b"))
    return best.select("article_id", F.when(F.col("b.cos") >= least, -F.col("b.g")).alias("group_id"), F.col("b.cos").alias("cos"))
