"""Streams from files: inserts, updates, deletions, late and repeated events, and a restart from the checkpoint."""

import random

import pytest

from cairn.operators.embed import HashProvider
from cairn.operators.search import scored
from cairn.streaming.sync_stream import EVENT, follow, live_chunks


def put(spark, folder, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder)


def event(ns, chunk, version, text=None, deleted=False):
    return (ns, chunk, version, deleted, None if deleted else f"h-{text}", f"{chunk}.py", text)


def run(spark, source, tmp_path):
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    query = follow(stream, HashProvider(4), str(tmp_path / "log"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    return {(r["namespace"], r["chunk_id"]): r for r in live_chunks(spark, str(tmp_path / "log")).collect()}


def test_changes_over_a_restart(spark, tmp_path):
    source = str(tmp_path / "events")
    put(spark, source, [event("n", "a", 1, "one"), event("n", "b", 1, "two"), event("m", "a", 1, "other"), event(None, "a", 1, "x"), event("n", None, 1, "x"), event("n", "c", None, "x")])
    first = run(spark, source, tmp_path)
    assert {k: r["text"] for k, r in first.items()} == {("n", "a"): "one", ("n", "b"): "two", ("m", "a"): "other"}
    assert list(first["n", "a"]["embedding"]) == pytest.approx(HashProvider(4).embed_query("one"))
    put(spark, source, [event("n", "a", 3, "three"), event("n", "a", 2, "late"), event("n", "b", 2, deleted=True), event("m", "a", 2, "other")])
    put(spark, source, [event("n", "b", 1, "two"), event("n", "d", 5, deleted=True), event("n", "d", 5, "tie"), event("n", "e", 1, "")])
    second = run(spark, source, tmp_path)
    assert {k: r["text"] for k, r in second.items()} == {("n", "a"): "three", ("m", "a"): "other", ("n", "e"): ""}
    log = spark.read.parquet(str(tmp_path / "log"))
    assert sorted((r["namespace"], r["chunk_id"], r["change"]) for r in log.filter("batch > 0").collect()) == [("n", "a", "updated"), ("n", "b", "deleted"), ("n", "e", "new")]
    assert scored(live_chunks(spark, str(tmp_path / "log")), HashProvider(4).embed_query("three")).filter("chunk_id = 'a' and namespace = 'n'").first()["score"] == 1.0


def test_order_of_arrival_does_not_matter(spark, tmp_path):
    deal = random.Random(5)
    events = [event("n", f"c{deal.randrange(12)}", deal.randrange(6), None if gone else deal.choice("xyz"), gone) for gone in deal.choices([True, False], [1, 3], k=120)]
    best = {}
    for e in events:
        rank = (e[2], e[3], e[4] or "")
        if e[1] not in best or rank > best[e[1]][0]:
            best[e[1]] = (rank, e)
    for k in range(0, 120, 40):
        put(spark, str(tmp_path / "events"), events[k : k + 40])
    now = run(spark, str(tmp_path / "events"), tmp_path)
    assert {k[1]: r["text"] for k, r in now.items()} == {c: e[6] for c, (_, e) in best.items() if not e[3]}
    assert all(r["version"] <= best[k[1]][1][2] for k, r in now.items())  # that of the last change: equal content again is none
