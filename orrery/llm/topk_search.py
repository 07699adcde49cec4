"""Exact top-k search by tiled matrix products.

Candidates are dealt into shards, queries into blocks. A tile multiplies one block with one shard and keeps each query's
best k of that shard; the partial lists then meet in a tree, a bounded number of lists at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import durable

TOP = "query_row long, query_id long, vec_id long, score long"


@dataclass(frozen=True)
class Tiling:
    """k: results for each query. shard, block: rows of a tile's sides. fan_in: partial lists that meet in one task's group.

    A candidate is sent once to each block of queries and a query once to each shard, so larger sides mean fewer copies.
    """

    k: int = 20
    shard: int = 8192
    block: int = 8192
    fan_in: int = 16
    scale: int = 64


def usable(embedding: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True))


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest of each row, ties to the smaller column: a flag for each cell."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, [scores.shape[1] - k]]
    keep = scores > edge
    room = k - keep.sum(axis=1, keepdims=True)
    level = scores == edge
    rows = np.flatnonzero(level.sum(axis=1, keepdims=True) > room)
    if len(rows):
        level[rows] &= np.cumsum(level[rows], axis=1, dtype=np.int32) <= room[rows]
    return keep | level


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; by floats where no sum can leave their exact range."""
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    return (q @ c.T).astype(np.int64) if reach < 2**52 else q.astype(np.int64) @ c.astype(np.int64).T


def _tile(queries: pd.DataFrame, shard: pd.DataFrame, k: int, block: int) -> Iterator[pd.DataFrame]:
    shard, queries = shard.sort_values("vec_id", kind="stable"), queries.sort_values("query", kind="stable")
    # vectors of different lengths have no inner product
    lengths = {n: g for n, g in shard.groupby(shard.v.map(len))}
    for n, qs in queries.groupby(queries.qv.map(len)):
        if n not in lengths:
            continue
        ids, own_rows, c = lengths[n].vec_id.to_numpy(), lengths[n].row.to_numpy(), np.stack(lengths[n].v.to_numpy())
        for at in range(0, len(qs), 256):
            part = qs.iloc[at : at + 256]
            qid, rows = part["query"].to_numpy(), part["query_row"].to_numpy()
            scores = _product(np.stack(part.qv.to_numpy()), c)
            scores[rows[:, None] == own_rows[None, :]] = np.iinfo(np.int64).min
            r, col = np.nonzero(best(scores, k))
            own = scores[r, col] != np.iinfo(np.int64).min
            r, col = r[own], col[own]
            yield pd.DataFrame({"query_row": rows[r], "query_id": qid[r], "vec_id": ids[col], "score": scores[r, col]})


def _merge(k: int):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["query_row", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        return pdf[pdf.groupby("query_row").cumcount() < k]

    return merge


def top_k(vectors: DataFrame, is_query: Column, t: Tiling = Tiling()) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best other rows of vectors (vec_id, embedding).

    Components are floor(scale * x). Vectors that are null or hold null or non-finite components take no part, nor
    do rows without vec_id; vectors of another length than a query's are no candidates of it. Ties go to the smaller
    vec_id. Repeated rows of one vec_id are a candidate and, if so chosen, a query each, and candidates of one another. An
    empty table gives an empty table; columns besides the two are not read.
    """
    v = F.transform(F.col("embedding"), lambda x: F.floor(F.lit(float(t.scale)) * x.cast("double")).cast("double"))
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).first()
    shards, blocks = max(1, -(-n["n"] // t.shard)), max(1, -(-n["q"] // t.block))
    candidates = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = rows.filter("q").withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = list(_tile(a, b, t.k, t.block)) if len(a) and len(b) else []
        return pd.concat(out) if out else pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")

    def tiles(key, a, b):
        return tile(a, b).assign(shard=np.int32(key[1]), block=np.int32(key[0]))

    # both sides come from one table, so one of them takes other names
    queries = queries.select(F.col("block").alias("b"), F.col("shard").alias("s"), F.col("vec_id").alias("query"), F.col("row").alias("query_row"), F.col("v").alias("qv"))
    candidates = candidates.select("block", "shard", "vec_id", "row", "v")
    lists = queries.groupBy("b", "s").cogroup(candidates.groupBy("block", "shard")).applyInPandas(tiles, TOP + ", shard int, block int")
    merge = _merge(t.k)
    while shards > 1:
        shards = -(-shards // t.fan_in)
        lists = lists.withColumn("shard", (F.col("shard") / t.fan_in).cast("int"))
        lists = lists.groupBy("block", "shard").applyInPandas(lambda pdf: merge(pdf), TOP + ", shard int, block int")
    rank = F.struct((-F.col("score")).alias("s"), "vec_id")
    out = lists.groupBy("query_row", "query_id").agg(F.array_sort(F.collect_list(rank)).alias("top"))
    out = out.select("query_id", F.posexplode("top").alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
