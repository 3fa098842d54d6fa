"""Mixing sources to target weights by balanced (cube) sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import small_side
from cairn.llm.sharding import ranked
from cairn.session import discard, materialize

EPS = 1e-9
WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (sid from 0 in the order of the sources, n: size) with `target`: weights repeat, and what is above `most` times a
    size is shared out again.

    Each round fills the sources that are above their limit at the present unit; the driver holds sums alone.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("w", w).withColumn("limit", F.lit(most) * F.col("n"))
    total = sources.agg(F.sum("n")).first()[0] or 0
    unit, filled = 0.0, -1
    while True:
        full = F.col("w") * F.lit(unit) > F.col("limit")
        taken, open_w, now = sources.filter("n > 0").agg(F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("w"))), F.count_if(full)).first()
        if now == filled or not open_w:
            break
        filled, unit = now, (share * total - (taken or 0.0)) / open_w
    return sources.withColumn("target", F.when(F.col("n") > 0, F.least(F.col("limit"), F.col("w") * F.lit(unit))).otherwise(0.0)).drop("w", "limit")


def flight(pi: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Fast flight phase of the cube method with the constraints (size, 1).

    Three units have a null direction of the 2 x 3 constraint matrix: moving their probabilities along it keeps both totals
    of the expected sample, until one of them is 0 or 1 and leaves its place to the next unit. At most two stay between.
    """
    pi = pi.copy()
    hand: list[int] = []
    draws = rng.random(2 * len(pi) + 4)
    d = 0
    for nxt in [*range(len(pi)), -1]:
        if nxt >= 0:
            if EPS < pi[nxt] < 1 - EPS:
                hand.append(nxt)
        if len(hand) < 3:
            continue
        a, b, c = hand
        x, y, z = float(sizes[a]), float(sizes[b]), float(sizes[c])
        u = (y - z, z - x, x - y)  # cross product of (x, y, z) and (1, 1, 1)
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        p = (float(pi[a]), float(pi[b]), float(pi[c]))
        up = min(((1 - q) / v if v > 0 else -q / v) for q, v in zip(p, u, strict=True) if v)
        down = min((q / v if v > 0 else (q - 1) / v) for q, v in zip(p, u, strict=True) if v)
        step = up if draws[d] * (up + down) < down else -down
        d += 1
        kept = []
        for i, q, v in zip(hand, p, u, strict=True):
            q += step * v
            pi[i] = q = 0.0 if q < EPS else 1.0 if q > 1 - EPS else q
            if 0 < q < 1:
                kept.append(i)
        hand = kept
    return pi


RESERVE = 14


def reserve_of(pi: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Undecided units that sit out the last flight: RESERVE at most, spread over the sizes."""
    open_ = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
    open_ = open_[np.argsort(-sizes[open_], kind="stable")]
    return open_[np.unique(np.linspace(0, len(open_) - 1, RESERVE).astype(int))] if len(open_) else open_


def landing(pi: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Land what the flight left and the reserve, RESERVE + 2 units at most.

    Of all ways to round them, those are taken whose words, then whose documents, are nearest to the expected totals; the
    generator picks one of equals.
    """
    pi = pi.copy()
    left = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
    ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    words = np.abs(ways @ sizes[left] - (pi[left] * sizes[left]).sum())
    count = np.abs(ways.sum(1) - pi[left].sum())
    off = np.floor(words) * (len(left) + 2) + count
    best = np.flatnonzero(off <= off.min() + 1e-6)
    pi[left] = ways[int(best[rng.integers(len(best))])]
    return pi


def block_flight(seed: int, level: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sid, block, last = key
        pdf = pdf.sort_values(["size", "doc_id", "text_key", "nth"], ascending=[False, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
        rng = np.random.default_rng([seed, level, int(sid), int(block)])
        pi, sizes = pdf["pi"].to_numpy(float), pdf["size"].to_numpy(float)
        if last:
            kept = reserve_of(pi, sizes)
            flown = np.delete(np.arange(len(pi)), kept)
            pi[flown] = flight(pi[flown], sizes[flown], rng)
            pi = landing(pi, sizes, rng)
        else:
            pi = flight(pi, sizes, rng)
        pdf["pi"] = pi
        return pdf.drop(columns=["block", "last"])

    return run


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    block_rows: int = 2048,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Copies of every document, so that each source's words come near its target.

    A source with target t and size s asks for t/s copies of each document: floor(t/s) whole ones, and one more with the
    fractional probability. Blocks of about block_rows rows of one source run the flight phase apart from each other, large
    documents first; the two units at most that a block leaves go on to the next level, a thousandth of the rows, until a
    source is one block, which lands with a small reserve of documents. So a hot source is many blocks, and so are the rows of
    a frequent or null id: blocks are dealt by id, text and, for equal rows, their number. Sources are any number: a table
    that meets the rows by a join, sent to all tasks only where it is small.

    Columns: doc_id, text_key, size, source_size, target, copies, taken. Blocks and draws depend on the rows' values and seed
    alone. Null text: size 0; null source: a source of its own, last; repeated rows: sampled each, the same count in all
    runs; an empty table: no rows.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), F.xxhash64(text).alias("text_key"), word_count(docs[text_col]).alias("size"))
    # Equal rows are combined, and numbered when they part again.
    equal = materialize(rows.groupBy("doc_id", "source", "text_key", "size").agg(F.count("*").alias("times")), "mix-rows")
    found = materialize(equal.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("n"), F.sum("times").alias("rows")), "mix-sources")
    order = [F.col("source").isNull(), F.col("source")]
    numbered, n_sources = ranked(found, order, "mix-order")
    mix = source_targets(numbered.withColumnRenamed("__rank", "sid"), weights, share, most)
    mix = materialize(mix.select("sid", F.col("source").alias("m_source"), F.col("n").alias("source_size"), "rows", "target", F.when(F.col("n") > 0, F.col("target") / F.col("n")).otherwise(0.0).alias("rate")), "mix-targets")
    joined = equal.join(small_side(mix, n_sources), equal["source"].eqNullSafe(mix["m_source"]))
    whole = F.floor(F.col("rate") + EPS)
    open_ = joined.select(
        "doc_id", "text_key", "size", "sid", whole.cast("int").alias("whole"), F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("pi"), "source_size", "target", "rows",
        F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("nth"),
    )

    level, done = 0, []
    while True:
        blocks = F.ceil(F.col("rows") / block_rows)
        block = F.pmod(F.xxhash64("doc_id", "text_key", "nth", F.lit(seed + level)), blocks)
        schema = open_.schema
        out = materialize(open_.withColumn("block", block).withColumn("last", blocks == 1).groupBy("sid", "block", "last").applyInPandas(block_flight(seed, level), schema), f"mix-level{level}")
        settled = (F.col("pi") <= 0) | (F.col("pi") >= 1)
        done.append(out.filter(settled))
        counts = materialize(out.filter(~settled).groupBy("sid").agg(F.count("*").alias("rows")), "mix-counts")
        n_open = counts.count()
        if not n_open:
            break
        open_ = out.filter(~settled).drop("rows").join(small_side(counts, n_open), "sid").select(*schema.names)
        level += 1
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    discard(equal)
    copies = F.col("whole") + F.col("pi").cast("int")
    return result.select("doc_id", "text_key", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))
