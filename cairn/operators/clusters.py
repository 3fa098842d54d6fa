"""Exact nearest vectors by clusters: the triangle inequality of angles skips those that can't hold one of the k nearest.

Vectors are written by the nearest of some pivots and by rings, steps of the angle to it. A query first searches the rings
that come nearest to it, until they hold k rows; the k-th score then rules out every ring whose bound is worse. All else is
searched, so the result is that of a search of all rows. How much is skipped depends on the data: rows without clusters in
many dimensions skip nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.search import FOUND, k_best, strips_best, unit
from cairn.session import discard, materialize

#: A ring's width in radians: 32 rings from 0 to pi.
STEP = math.pi / 32
#: What a cluster's number is multiplied by in the code of a ring.
RINGS = 64
#: What a bound is widened by, in scores: rounding to six decimals, the snapping of distances, and errors of the angles.
SLACK = 4e-6


@dataclass
class Clusters:
    """Vectors by cluster, and for each cluster and ring (256 x 33 at most) the count of rows and their least and greatest angle."""

    rows: DataFrame
    pivots: np.ndarray
    cells: pd.DataFrame


def assigned(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vectors with the number of the nearest pivot, the angle to it and its ring."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("cluster int, angle double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        cosine = unit(v) @ sent.value.T if len(v) else np.empty((0, len(sent.value)))
        if not np.isfinite(cosine).all():
            raise ValueError("a vector without a direction")
        return pd.DataFrame({"cluster": cosine.argmax(1).astype("int32"), "angle": np.arccos(np.clip(cosine.max(1), -1, 1))})

    near = vectors.withColumn("near", nearest(F.col("v"))).select("*", "near.*").drop("near")
    return near.withColumn("ring", F.floor(F.col("angle") / STEP).cast("int"))


def fitted(vectors: DataFrame, n: int, pivots: int, rounds: int, fit_rows: int) -> np.ndarray:
    """Pivots by rounds of means over about fit_rows rows, chosen by hash; the first ones are those of the least hashes.

    The sample decides how much is skipped, never what is found. Of the sums only pivots x dimensions reach the driver.
    """
    some = materialize(vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n)) < fit_rows), "cluster-fit")
    at = unit(some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).toPandas()["v"])
    for _ in range(rounds):
        parts = assigned(some, at).select("cluster", F.posexplode("v").alias("i", "x"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("square"))
        sums = parts.groupBy("cluster", "i").agg(F.sum(F.col("x") / F.sqrt("square")).alias("total")).toPandas()
        at = at.copy()
        for cluster, rows in sums.groupby("cluster"):
            mean = rows.sort_values("i")["total"].to_numpy()
            if np.linalg.norm(mean) > 0:
                at[cluster] = mean / np.linalg.norm(mean)
    discard(some)
    return at


def clustered(vectors: DataFrame, pivots: int = 256, rounds: int = 3, fit_rows: int = 100_000) -> Clusters:
    """Write vectors (vec_id, embedding) by cluster, ring by ring; a hot cluster is cut into several files by ranges of hashes.

    There are as many pivots as the square root of the rows, up to `pivots` (256 at most). No rows give no clusters; a vector of zeros fails.
    """
    spark = vectors.sparkSession
    all_rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = all_rows.count()
    if not n:
        return Clusters(all_rows.withColumns({"cluster": F.lit(0), "angle": F.lit(0.0), "ring": F.lit(0)}), np.empty((0, 0)), pd.DataFrame(columns=["cluster", "ring", "n", "low", "high"]))
    at = fitted(all_rows, n, min(pivots, 256, math.isqrt(n)), rounds, fit_rows)
    near = materialize(assigned(all_rows, at), "cluster-rows")
    cells = near.groupBy("cluster", "ring").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).toPandas()
    path = f"{near.inputFiles()[0].rpartition('/')[0]}-by-cluster"
    near.repartitionByRange("cluster", "ring", F.xxhash64("vec_id")).sortWithinPartitions("cluster", "ring").write.partitionBy("cluster").parquet(path)
    rows = spark.read.schema(near.schema).parquet(path)
    discard(near)
    return Clusters(rows, at, cells)


def visits(clusters: Clusters, queries: DataFrame, k: int) -> DataFrame:
    """The rings that each query searches: query_id, v, cluster, rings, and the count of rows in them.

    Without a column `seen` those are the rings that come nearest, until they hold k rows; with it (the codes of the rings
    searched) all others whose bound reaches `worst`, the k-th score found there, null if there are fewer.
    """
    sent = queries.sparkSession.sparkContext.broadcast((clusters.pivots, clusters.cells))
    again = "seen" in queries.columns

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, cells = sent.value
        cluster, ring, size = (cells[c].to_numpy(np.int64) for c in ("cluster", "ring", "n"))
        code = cluster * RINGS + ring
        low, high = cells["low"].to_numpy(float), cells["high"].to_numpy(float)
        for batch in batches:
            out = []
            if len(batch) and len(cells):
                angle = np.arccos(np.clip(unit(batch["v"]) @ pivots.T, -1, 1))[:, cluster]
                least = np.maximum(0, np.maximum(angle - high, low - angle))
                for i, (query, v) in enumerate(zip(batch["query_id"], batch["v"])):
                    if again:
                        taken, worst = np.flatnonzero(~np.isin(code, batch["seen"].iloc[i])), batch["worst"].iloc[i]
                        if not pd.isna(worst):
                            taken = taken[(1 + np.cos(least[i, taken])) / 2 + SLACK >= worst]
                    else:
                        order = np.lexsort((ring, cluster, angle[i], least[i]))
                        taken = order[: np.searchsorted(np.cumsum(size[order]), k) + 1]
                    for c in np.unique(cluster[taken]):
                        here = taken[cluster[taken] == c]
                        out.append((query, v, c, ring[here].tolist(), int(size[here].sum())))
            yield pd.DataFrame(out, columns=["query_id", "v", "cluster", "rings", "n"])

    return queries.mapInPandas(choose, "query_id long, v array<double>, cluster int, rings array<int>, n long")


def searched(clusters: Clusters, visited: DataFrame, k: int, block: int, query_block: int) -> DataFrame:
    """The k best rows of each query and block of those it visits. A cluster's rows and queries are dealt over blocks; only its files are read."""
    spark = visited.sparkSession
    sizes = clusters.cells.groupby("cluster")["n"].sum()
    counts = visited.groupBy("cluster").count().toPandas()
    if not len(counts):
        return spark.createDataFrame([], FOUND)
    deals = [(int(c), max(1, -(-int(sizes[c]) // block)), max(1, -(-int(m) // query_block))) for c, m in zip(counts["cluster"], counts["count"])]
    deal = F.broadcast(spark.createDataFrame(deals, "cluster int, shards int, parts int"))  # a row a pivot, 256 at most
    wanted = F.broadcast(visited.select("cluster", F.explode("rings").alias("ring")).distinct())  # 256 x 33 rows at most
    number = lambda c, many: F.pmod(F.xxhash64(c), F.col(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    there = clusters.rows.filter(F.col("cluster").isin([d[0] for d in deals])).join(wanted, ["cluster", "ring"], "left_semi")
    rows = there.join(deal, "cluster").select("cluster", number("vec_id", "shards").alias("shard"), every("parts").alias("part"), "vec_id", "v", "ring")
    asked = visited.join(deal, "cluster").select("cluster", every("shards").alias("shard"), number("query_id", "parts").alias("part"), "query_id", "v", "rings")

    def nearest(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        allowed = lambda at, to: np.stack([np.isin(c["ring"], rings) for rings in q["rings"].iloc[at:to]])
        return strips_best(q, c, k, allowed)

    keys = ["cluster", "shard", "part"]
    return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(nearest, FOUND)


def clustered_topk(clusters: Clusters, queries: DataFrame, k: int, block: int = 16_384, query_block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """The rows of `cosine_topk_batch`, and for each query the count of rows compared; the others were skipped.

    Queries are (vec_id, embedding) with distinct ids.
    """
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
    first = materialize(visits(clusters, asked, k), "cluster-first")
    found = materialize(k_best(searched(clusters, first, k, block, query_block), k), "cluster-found")
    worst = found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("worst"))
    seen = first.groupBy("query_id").agg(F.flatten(F.collect_list(F.transform("rings", lambda r: F.col("cluster") * RINGS + r))).alias("seen"))  # 256 x 33 at most
    rest = materialize(visits(clusters, asked.join(seen, "query_id").join(worst, "query_id", "left"), k), "cluster-rest")
    best = k_best(found.unionByName(searched(clusters, rest, k, block, query_block)), k)
    return best, first.unionByName(rest).groupBy("query_id").agg(F.sum("n").alias("compared"))
