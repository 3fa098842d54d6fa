"""Sharding along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.near_duplicates import joined_apart
from cairn.session import discard, materialize

BITS = 7


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with `bits` bits an axis (Skilling 2004), a vector operation over all points."""
    x = [a.astype(np.int64).copy() for a in axes]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | (((x[i] ^ t) >> b) & 1)
    return index


def ranked(rows: DataFrame, order: list[Column], tag: str) -> tuple[DataFrame, int]:
    """rows with `__rank`, their place (0, 1, ...) in the order, and how many there are.

    Rows are sorted by ranges and numbered within them; the driver holds a count for each range, no rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The range cuts are sampled anew by every job, so the sorted rows are written down before they are counted.
    ordered = materialize(ordered.withColumn("place", F.monotonically_increasing_id()), tag)
    part, within = F.shiftrightunsigned("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    counts = sorted(ordered.groupBy(part.alias("part")).count().collect())  # a row for each range partition
    total, starts = 0, {}
    for p, n in counts:
        starts[p], total = total, total + n
    offsets = rows.sparkSession.createDataFrame(list(starts.items()), "__part long, __start long")  # a row for each range partition
    placed = ordered.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return placed.withColumn("__rank", F.col("__start") + within).drop("place", "__part", "__start"), total


def hilbert_order(rows: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """Adds `curve`: each dimension quantised to 2**bits - 1 steps (0: null), then put on the curve.

    Strings are quantised by the rank of the distinct value over the whole column, so that each value has a step of its own,
    whatever its prefix; where values are more than the steps, there are more bits, as far as a long holds the curve, and
    neighbours share a step beyond that. Numbers are quantised by their logarithm over its range. An empty table or a
    constant dimension gets step 1.
    """
    kinds = dict(rows.dtypes)
    strings = [d for d in dimensions if kinds[d] == "string"]
    ranks = {d: ranked(rows.filter(F.col(d).isNotNull()).select(d).distinct(), [F.col(d)], "shard-values") for d in strings}
    bits = min(max([bits, *(n.bit_length() for _, n in ranks.values())]), 63 // len(dimensions))
    top = (1 << bits) - 2
    codes = {d: F.log1p(F.greatest(F.col(d).cast("double"), F.lit(0.0))) for d in dimensions if d not in ranks}
    ends = rows.agg(F.lit(1), *[f(c).alias(f"{n}_{d}") for d, c in codes.items() for n, f in (("lo", F.min), ("hi", F.max))]).first()
    steps = []
    for d in dimensions:
        if d in ranks:
            values, n = ranks[d]
            rows = rows.join(values.select(d, F.expr(f"__rank * {top} div {max(n - 1, 1)} + 1").alias(f"__step_{d}")), d, "left")
            steps.append(F.coalesce(f"__step_{d}", F.lit(0)).cast("long"))
            continue
        lo, hi = ends[f"lo_{d}"], ends[f"hi_{d}"]
        span = (hi - lo) if lo is not None and hi > lo else 1.0
        steps.append(F.coalesce(F.floor((codes[d] - F.lit(lo or 0.0)) / F.lit(span) * F.lit(float(top))).cast("long") + 1, F.lit(0)))

    @F.pandas_udf("long")
    def curve(points: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index([points[c].to_numpy() for c in points.columns], bits))

    return rows.withColumn("curve", curve(F.struct(*[s.alias(f"a{i}") for i, s in enumerate(steps)]))).drop(*[f"__step_{d}" for d in strings])


def hilbert_shards(docs: DataFrame, shards: int = 40, dimensions: tuple[str, ...] = ("lang", "source", "size"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard of every document: law `rows` (counts of any two shards differ by one at most).

    Documents are sorted by (curve, text hash, doc_id) and cut into equal runs, so that a shard covers a small box of
    (lang, source, size). All rows of a text take the least curve index of any of them, so equal texts are one run, whatever
    their lang or source: in one shard, or in neighbours where a cut splits them. Only narrow rows are sorted; the text stays in the scan.
    Columns: doc_id, size, text_crc32, curve, law, shard, slot, grown_shard. Null text: size 16, crc32 0, equal to the empty one; null lang or
    source: the lowest step; repeated rows: each takes a slot; an empty table: no rows.
    """
    text = docs[text_col]
    metadata = [docs[d].alias(d) for d in dimensions if d != "size"]
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"),
        F.monotonically_increasing_id().alias("node"),  # tells equal rows apart, so that a range of them can be cut
        *metadata,
    )
    rows = materialize(rows, "shard-rows")
    placed = materialize(hilbert_order(rows, list(dimensions)).select("doc_id", "size", "text_crc32", "text_key", "node", "curve"), "shard-curve")
    spread = placed.groupBy("text_key").agg(F.min("curve").alias("least"), F.max("curve").alias("most"), F.count("*").alias("n")).filter("least < most")
    spread = materialize(spread.select("text_key", "least", "n"), "shard-copies")
    together = joined_apart(placed, spread, ["text_key"], "left").withColumn("curve", F.coalesce("least", "curve")).drop("least", "n")
    order = [F.col("curve"), F.col("text_key"), F.col("doc_id").asc_nulls_last(), F.col("node")]
    ordered, total = ranked(together, order, "shard-order")
    discard(rows, placed)
    n = max(total, 1)
    shard = F.floor(F.expr("__rank * %d div %d" % (shards, n)))
    first = F.expr("(__shard * %d + %d) div %d" % (n, shards - 1, shards))
    return (
        ordered.withColumn("__shard", shard)
        .select("doc_id", "size", "text_crc32", "curve", F.lit("rows").alias("law"), F.col("__shard").cast("int").alias("shard"), (F.col("__rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, file_rows: int = 100_000) -> None:
    """Write the documents as one folder a shard, in files of file_rows slots each in order; rows meet by doc_id, unique here."""
    seats = assigned.select(F.col("doc_id").alias("__id"), "shard", "slot", F.expr(f"slot div {file_rows}").alias("__file"))
    (
        docs.join(seats, docs["doc_id"].eqNullSafe(F.col("__id")))
        .repartition("shard", "__file")
        .sortWithinPartitions("shard", "slot")
        .drop("__id", "__file")
        .write.partitionBy("shard")
        .parquet(path)
    )
