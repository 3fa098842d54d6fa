"""Cosine search over float32 vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def score_of(distance: Column, tolerance: float = 1e-6) -> Column:
    """1 - d/2; distances within the tolerance of 0 or 2 snap to it, others outside [0, 2] fail the query."""
    snapped = F.when(F.abs(distance) <= tolerance, 0.0).when(F.abs(distance - 2) <= tolerance, 2.0).otherwise(distance)
    return F.when((snapped < 0) | (snapped > 2) | F.isnan(snapped), F.raise_error(F.lit("distance outside [0, 2]")).cast("double")).otherwise(1 - snapped / 2)


def scored(vectors: DataFrame, probe: list[float]) -> DataFrame:
    """vectors with their score against one query, to six decimals."""
    q = F.array(*[F.lit(float(x)) for x in probe])
    return vectors.withColumn("score", F.round(score_of(cosine_distance(F.col("embedding"), q)), 6))


def cosine_topk(vectors: DataFrame, probe: list[float], k: int) -> DataFrame:
    """rank, vec_id and score of the k nearest vectors; ties to the smaller id. Each task keeps k rows."""
    best = scored(vectors, probe).select("vec_id", "score").orderBy(F.desc("score"), "vec_id").limit(k)
    return best.select("vec_id", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).alias("rank"), "score")


def unit(values: pd.Series) -> np.ndarray:
    m = np.array(values.tolist())
    return m / np.sqrt((m * m).sum(1, keepdims=True))


#: Cells of a matrix of scores that are held at once, 8 MB of doubles.
CELLS = 1 << 20


def unit_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores to six decimals of unit vectors (rows of a, rows of b), by the rule of `score_of`."""
    d = 1 - a @ b.T
    d = np.where(np.abs(d) <= 1e-6, 0.0, np.where(np.abs(d - 2) <= 1e-6, 2.0, d))
    if not ((d >= 0) & (d <= 2)).all():
        raise ValueError("distance outside [0, 2]")
    return np.round(1 - d / 2, 6)


def block_best(score: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of each row of a block's scores, ties to the smaller id; what is -1 takes no part."""
    out = []
    for i in range(len(query_ids)):
        best = np.lexsort((ids, -score[i]))[:k]
        out.append((np.repeat(query_ids[i], len(best)), ids[best], score[i, best]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
    found = pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns))).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    return found[found["score"] >= 0]


def strips_best(queries: pd.DataFrame, vectors: pd.DataFrame, k: int, allowed: Callable[[int, int], np.ndarray] | None = None) -> pd.DataFrame:
    """The k best vectors (vec_id, v) of a block for each query (query_id, v) of a block, a strip of the scores at a time.

    allowed: of a range of queries, which vectors take part for each.
    """
    ids, query_ids, out = vectors["vec_id"].to_numpy(), queries["query_id"].to_numpy(), [block_best(np.empty((0, 0)), [], [], k)]
    if len(ids) and len(query_ids):
        a, b = unit(queries["v"]), unit(vectors["v"])
        step = max(1, CELLS // len(ids))
        for at in range(0, len(a), step):
            score = unit_scores(a[at : at + step], b)
            if allowed:
                score[~allowed(at, at + step)] = -1
            out.append(block_best(score, query_ids[at : at + step], ids, k))
    return pd.concat(out, ignore_index=True)


def k_best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query among those its blocks found."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")


FOUND = "query_id long, vec_id long, score double"


def cosine_topk_batch(vectors: DataFrame, queries: DataFrame, k: int, block: int = 16_384, query_block: int = 1024) -> DataFrame:
    """query_id, vec_id and score of the k nearest of each query, for any number of queries.

    Vectors and queries are dealt over blocks; a task takes a block of each, multiplies their matrices strip by strip and keeps k rows a
    query. Scores are rounded to six decimals before ties go to the smaller id.
    """
    n, n_queries = vectors.count(), queries.count()
    deal = lambda c, many: F.pmod(F.xxhash64(c), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    shards, parts = max(1, -(-n // block)), max(1, -(-n_queries // query_block))
    rows = vectors.select(deal("vec_id", shards).alias("shard"), every(parts).alias("part"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    asked = queries.select(every(shards).alias("shard"), deal("vec_id", parts).alias("part"), F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))

    def nearest(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return strips_best(q, c, k)

    return k_best(asked.groupBy("shard", "part").cogroup(rows.groupBy("shard", "part")).applyInPandas(nearest, FOUND), k)
