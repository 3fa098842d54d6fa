"""Exact top-k search by inner product, with MaxScore bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1
NONE = -(1 << 62)


def maxscore(queries: np.ndarray, query_ids: np.ndarray, postings: np.ndarray, ids: np.ndarray, k: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, id, score) of the k best rows of one shard for every query, exactly; scores must fit 62 bits.

    Terms are components; postings[t] are the components t of all rows. Shifted by the shard's least (or, for a negative
    query weight, largest) value, each adds between 0 and its bound |q| * range to a score. Sorted by bound, the essential
    terms of a query are those before the remaining bounds fall under what a row lacks for the k-th score so far. Each block of
    rows is scored on the essential postings; the others are probed for those rows alone that can still compete.
    """
    d, n = postings.shape
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(postings).max(initial=0)) * max(d, 1)
    exact = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    slack = most * 2**-40  # of the bounds, which are sums in double
    q, lo, hi = queries.astype(exact), postings.min(1), postings.max(1)
    bound = np.abs(queries).astype(float) * (hi - lo)  # of each query and term
    base = np.where(queries > 0, queries.astype(float) * lo, queries.astype(float) * hi)
    term = np.argsort(-bound.max(0), kind="stable")
    q, bound, base, postings = q[:, term], bound[:, term], base[:, term], postings[term].astype(exact)
    # rest[:, t]: the most that terms t and later can add to a score.
    rest = np.concatenate([np.cumsum((bound + base)[:, ::-1], 1)[:, ::-1], np.zeros((len(q), 1))], 1) + slack
    base_sums = np.concatenate([np.zeros((len(q), 1)), np.cumsum(base, 1)], 1)
    best_s = np.full((len(q), 0), 0, dtype=np.int64)
    best_i = np.zeros((len(q), 0), dtype=np.int64)
    for at in range(0, n, block):
        part, part_ids = postings[:, at : at + block], ids[at : at + block]
        if best_s.shape[1] < k:
            score = (q @ part).astype(np.int64)
            alive = np.ones_like(score, dtype=bool)
        else:
            least = best_s[:, -1].astype(np.float64)
            # Rows with nothing above the base on the terms before t stay under the k-th score: t and later are non-essential.
            # One cut serves all queries of the block, so that the essential part is one product of matrices: it is taken
            # where nine of ten queries have theirs. `alive` goes by each query's own bounds, so the rest lose nothing.
            under = (base_sums + rest < least[:, None]).mean(0) >= 0.9
            essential = int(np.argmax(under)) if under.any() else d
            some = q[:, :essential] @ part[:essential]
            alive = some + rest[:, essential, None] >= least[:, None]
            qi, ri = np.nonzero(alive)
            score = np.zeros(alive.shape, dtype=np.int64)
            if len(qi) * 4 > alive.size:
                score = (some + q[:, essential:] @ part[essential:]).astype(np.int64)
            elif len(qi):
                for c in range(0, len(qi), 1 << 18):
                    i, j = qi[c : c + (1 << 18)], ri[c : c + (1 << 18)]
                    score[i, j] = (some[i, j] + np.einsum("ij,ji->i", q[i, essential:], part[essential:, j])).astype(np.int64)
        alive &= query_ids[:, None] != part_ids[None, :]
        # Of this block, at most k rows a query go on; ties at the k-th score stay, to be cut by id below.
        for i in np.flatnonzero(alive.any(1)):
            j = np.flatnonzero(alive[i])
            if best_s.shape[1] >= k:
                j = j[score[i, j] >= best_s[i, -1]]
            if len(j) > 4 * k:
                cut = np.partition(score[i, j], len(j) - k)[len(j) - k]
                j = j[score[i, j] >= cut]
            s = np.concatenate([best_s[i][best_i[i] >= NONE], score[i, j]]) if best_s.shape[1] else score[i, j]
            v = np.concatenate([best_i[i][best_i[i] >= NONE], part_ids[j]]) if best_s.shape[1] else part_ids[j]
            o = np.lexsort((v, -s))[:k]
            if best_s.shape[1] < k:
                best_s = np.pad(best_s, ((0, 0), (0, k - best_s.shape[1])), constant_values=NONE)
                best_i = np.pad(best_i, ((0, 0), (0, k - best_i.shape[1])), constant_values=2 * NONE + 1)
            best_s[i, :], best_i[i, :] = NONE, 2 * NONE + 1
            best_s[i, : len(o)], best_i[i, : len(o)] = s[o], v[o]
    qi, pos = np.nonzero(best_i >= NONE)
    return qi, best_i[qi, pos], best_s[qi, pos]


def wide_scores(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query position, id, score) of the k best rows, in Python's integers, for components of any size."""
    whole = lambda m: [[int(x) for x in v] for v in m]
    q, r, out = whole(queries), whole(rows), []
    for i, a in enumerate(q):
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), int(v)) for b, v in zip(r, ids, strict=True) if v != query_ids[i])
        out += [(i, v, -s) for s, v in scored[:k]]
    return out


def held(score: int) -> tuple[int, str | None]:
    """A score as a long; one beyond, held at the end of the longs, has its digits beside it, in an order of strings."""
    if LONG_MIN < score < LONG_MAX:
        return score, None
    return (LONG_MAX, f"{score:0100d}") if score > 0 else (LONG_MIN, f"{10**100 + score:0100d}")


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id and `v` of the vectors that take part: those that aren't null and have no null or non-finite component."""
    v = vectors[vector_col]
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.lit(scale) * x.cast("double")) < float("inf")))
    return vectors.filter(usable & vectors[id_col].isNotNull()).select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v"))


def exact_topk(vectors: DataFrame, k: int = 20, query_modulus: int = 20, scale: float = 64.0, shard_rows: int = 65_536, group_queries: int = 16_384, query_block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest inner product for each query (ids divisible by query_modulus).

    Components are floor(scale * x). Rows are dealt over shards of about shard_rows by id, queries over parts of
    group_queries at most: a group is one shard and one part, of bounded size. It keeps k rows a query by MaxScore, and the
    shards' lists are merged by a window over each query: k rows from every shard, whatever the number of partitions. Where
    shards are few, more parts keep the cores busy.

    Own rows (of equal vec_id) are no candidates; ties go to the smaller vec_id. Scores are exact integers: in double
    where all sums stay under 2**53, else in 64 bits, and for vectors too large for that in Python's integers; the order is always
    that of the exact scores, and a score that no long can hold shows as the end of the longs. Vectors of other lengths count as
    padded by zeros. Empty table: no rows. Repeated queries: one list; repeated candidates: each row.
    """
    spark = vectors.sparkSession
    rows = usable_vectors(vectors, id_col, vector_col, scale)
    asked = rows.filter(F.pmod("vec_id", F.lit(query_modulus)) == 0).dropDuplicates(["vec_id"])
    n, n_asked = rows.count(), asked.count()
    shards = max(1, -(-n // shard_rows))
    spread = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    parts = max(1, -(-n_asked // group_queries), min(-(-n_asked // 256), spread))
    deal = lambda many, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    candidates = rows.select(deal(shards, 1).alias("shard"), every(parts).alias("part"), "vec_id", "v")
    asked = asked.select(every(shards).alias("shard"), deal(parts, 2).alias("part"), "vec_id", "v")

    def matrix(values, d: int) -> np.ndarray:
        """The components, whole numbers in double."""
        out = np.zeros((len(values), d))
        for i, x in enumerate(values):
            out[i, : len(x)] = np.floor(np.asarray(x, dtype=np.float64) * scale)
        return out

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(c):
            d = max(max(map(len, q["v"])), max(map(len, c["v"])), 1)
            # Long vectors first: they raise the k-th score early.
            body, ids = matrix(c["v"].to_numpy(), d), c["vec_id"].to_numpy()
            o = np.lexsort((ids, -np.abs(body).max(1), -np.square(body).sum(1)))
            body, ids = body[o], ids[o]
            heads, head_ids = matrix(q["v"].to_numpy(), d), q["vec_id"].to_numpy()
            # Two vectors under this in all components have a score under 2**53; by value, so that one huge vector slows no other.
            small = np.sqrt(2.0**53 / d) - 1
            row_size, query_size = np.abs(body).max(1), np.abs(heads).max(1)
            rows_of = {True: np.flatnonzero(row_size < small), False: np.flatnonzero(row_size >= small)}
            for queries_small in (True, False):
                asked_ = np.flatnonzero((query_size < small) == queries_small)
                for rows_small, some in rows_of.items():
                    if not len(asked_) or not len(some):
                        continue
                    largest = float(query_size[asked_].max()) * float(row_size[some].max()) * d
                    if largest >= 2.0**62:
                        out += [(int(head_ids[asked_[i]]), v, *held(s)) for i, v, s in wide_scores(heads[asked_], head_ids[asked_], body[some], ids[some], k)]
                        continue
                    postings = np.ascontiguousarray(body[some].T).astype(np.int64)
                    for at in range(0, len(asked_), query_block):
                        which = asked_[at : at + query_block]
                        qi, v, s = maxscore(heads[which].astype(np.int64), head_ids[which], postings, ids[some], k)
                        out += zip(head_ids[which][qi].tolist(), v.tolist(), s.tolist(), [None] * len(v), strict=True)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "digits"]).astype({"query_id": "int64", "vec_id": "int64", "score": "int64", "digits": "object"})

    lists = asked.groupBy("shard", "part").cogroup(candidates.groupBy("shard", "part")).applyInPandas(search, "query_id long, vec_id long, score long, digits string")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("digits"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
