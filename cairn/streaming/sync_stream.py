"""A stream of chunk events kept in step with a table of embedded chunks, beyond what a batch run needs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.operators.embed import Provider, embed

KEY = ["namespace", "chunk_id"]
EVENT = "namespace string, chunk_id string, version bigint, deleted boolean, content_hash string, relative_path string, text string"
CHANGE = f"{EVENT}, change string"
STATE = "version bigint, deleted boolean, content_hash string"
ORDER = ["version", "deleted", "content_hash"]


def winner(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The event of a chunk that stands after a micro-batch, if it changes what stood before; the state is its place in the order."""
    was, best = (tuple(state.get) if state.exists else None), None
    for rows in batches:
        last = rows.sort_values(ORDER).tail(1)
        if best is None or tuple(last[ORDER].iloc[0]) > tuple(best[ORDER].iloc[0]):
            best = last
    if best is None:
        return
    now = tuple(best[ORDER].iloc[0])
    if was is not None and now <= was:
        return
    state.update((int(now[0]), bool(now[1]), str(now[2])))
    stood = was is not None and not was[1]
    if now[1]:
        change = "deleted" if stood else None
    else:
        change = "new" if not stood else "updated" if now[2] != was[2] else None
    if change:
        yield best.assign(change=change)


def chunk_changes(events: DataFrame) -> DataFrame:
    """Events with `change`: new, updated or deleted; one row at most for each chunk in a micro-batch, none where nothing changes.

    events: the columns of EVENT. Of a chunk's events the one of the highest version stands, of equal versions a deletion, then
    the greatest hash, in whatever order and however often they come. A deletion stays in the state, so that a late event of
    an older version brings nothing back. Events without namespace, chunk_id or version are left out; a null `deleted` is false.
    State is kept by chunk: two numbers and a hash, shuffled by its key alone, so no namespace is one task.
    """
    whole = events.filter("namespace is not null and chunk_id is not null and version is not null")
    whole = whole.select(*KEY, "version", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("content_hash", F.lit("")).alias("content_hash"), "relative_path", "text")
    return whole.groupBy(*KEY).applyInPandasWithState(winner, CHANGE, STATE, "append", GroupStateTimeout.NoTimeout)


def follow(events: DataFrame, provider: Provider, folder: str, checkpoint: str) -> StreamingQuery:
    """Append every micro-batch's changes, new and updated chunks with their embedding, to a log of Parquet folders.

    One job set a micro-batch for all namespaces. A batch that is run again after a failure replaces its own folder.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            gone = batch.filter("change = 'deleted'").withColumn("embedding", F.lit(None).cast("array<float>"))
            kept = embed(batch.filter("change <> 'deleted'").withColumn("text", F.coalesce("text", F.lit(""))), provider)
            kept.unionByName(gone).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        finally:
            batch.unpersist()

    return chunk_changes(events).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that stand by the log of follow(): the last change of each, with its version, without the deleted."""
    log = spark.read.schema(f"{CHANGE}, embedding array<float>, batch bigint").parquet(folder)
    fields = [c for c in log.columns if c not in (*KEY, "batch")]
    last = log.groupBy(*KEY).agg(F.max_by(F.struct(*fields), "batch").alias("last")).select(*KEY, "last.*")
    return last.filter("change <> 'deleted'").drop("change", "deleted")
