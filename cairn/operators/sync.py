"""Incremental synchronisation: which chunks are new, changed, unchanged or gone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sync_diff(current: DataFrame, stored: DataFrame, compatible: bool = True) -> DataFrame:
    """chunk_id and class of the full outer join of current and stored (chunk_id, content_hash).

    new, deleted, unchanged (equal hash) or updated. With another embedding identity or document version nothing stored is
    reused: common ids are updated.
    """
    c = current.select("chunk_id", F.col("content_hash").alias("now"))
    s = stored.select("chunk_id", F.col("content_hash").alias("was"))
    kind = (
        F.when(F.col("was").isNull(), "new")
        .when(F.col("now").isNull(), "deleted")
        .when((F.col("now") == F.col("was")) & F.lit(compatible), "unchanged")
        .otherwise("updated")
    )
    return c.join(s, "chunk_id", "full_outer").select("chunk_id", kind.alias("class"))


def sync_counters(diff: DataFrame) -> DataFrame:
    """One row: total, reused, embedded, inserted, updated and deleted chunks, and the status."""
    n = lambda *kinds: F.count_if(F.col("class").isin(*kinds))
    counts = diff.agg(
        n("new", "updated", "unchanged").alias("total_chunks"), n("unchanged").alias("reused_chunks"), n("new", "updated").alias("embedded_chunks"),
        n("new").alias("inserted_chunks"), n("updated").alias("updated_chunks"), n("deleted").alias("deleted_chunks"),
    )
    same = (F.col("embedded_chunks") == 0) & (F.col("deleted_chunks") == 0)
    return counts.withColumn("status", F.when(same, "unchanged").otherwise("success"))


def next_manifest(diff: DataFrame, stored: DataFrame, embedded: DataFrame) -> DataFrame:
    """The rows of the next generation: stored ones that are unchanged, and the embedded ones."""
    reused = stored.join(diff.filter("class = 'unchanged'").select("chunk_id"), "chunk_id", "left_semi")
    return reused.unionByName(embedded)
