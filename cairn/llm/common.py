"""Helpers that several of these operators share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone, a null text as the empty one. Other columns, whatever their names, stay behind."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def text_key() -> Column:
    """With doc_id it tells rows of one id but different texts apart; rows equal in both get equal results."""
    return F.xxhash64("text")


def small_batches(spark: SparkSession, most: str = "1m") -> None:
    """Keep Arrow batches small by bytes, as texts can be long: a batch ends once it holds `most`; narrow rows still fill it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def small_side(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """The side of a join, sent to all tasks if its counted rows are few; else Spark shuffles, and splits hot keys."""
    return F.broadcast(df) if rows <= most else df


def key_bitmap(keys: DataFrame, most_bits: int = 1 << 26):
    """A test of NumPy arrays of hashes that is true for every hash in keys (one long column) and for few others.

    It only spares rows a shuffle; joins and sums decide. The bitmap's size goes by the count of keys, up to 8 MB, full use of
    which takes four million keys; a fuller bitmap spares less.
    """
    n = keys.count()
    bits = min(most_bits, max(1 << 10, 1 << int(16 * max(n, 1) - 1).bit_length()))
    slot = F.pmod(keys[keys.columns[0]], F.lit(bits))
    words = keys.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toPandas()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    sent = keys.sparkSession.sparkContext.broadcast(bitmap)

    def test(hashes: np.ndarray) -> np.ndarray:
        s = np.mod(hashes, bits)
        return (sent.value[s >> 6].view(np.uint64) >> (s & 63).astype(np.uint64)) & np.uint64(1) == 1

    return test


def among(keys: DataFrame, most_bits: int = 1 << 26):
    """The test of `key_bitmap` for columns."""
    known = key_bitmap(keys, most_bits)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(known(h.to_numpy(np.int64)))

    return test
