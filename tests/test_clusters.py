"""Search by clusters against a search of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import clusters, search
from cairn.operators.embed import float32


def vectors_of(spark, m):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)], "vec_id long, embedding array<float>")


def rows_of(df):
    return sorted((r["query_id"], r["vec_id"], r["score"]) for r in df.collect())


def grouped(rng, n, dims, groups, spread, hot=0.0):
    """Vectors near some centres, a part of them near the first one."""
    centre = rng.normal(size=(groups, dims))
    which = np.where(rng.random(n) < hot, 0, rng.integers(0, groups, n))
    return centre[which] + spread * rng.normal(size=(n, dims))


@pytest.mark.parametrize("spread, hot, skips", [(0.05, 0.4, True), (0.3, 0.0, True), (3.0, 0.0, False)])
def test_same_rows_as_a_search_of_all(spark, spread, hot, skips):
    m = grouped(np.random.default_rng(7), 1500, 12, 15, spread, hot)
    m[100:130] = m[3]  # ties
    vectors = vectors_of(spark, m)
    queries = vectors.filter("vec_id % 50 = 0")
    best, compared = clusters.clustered_topk(clusters.clustered(vectors), queries, 10, block=128, query_block=4)
    assert rows_of(best) == rows_of(search.cosine_topk_batch(vectors, queries, 10))
    counts = [r["compared"] for r in compared.collect()]
    assert len(counts) == 30 and all(10 <= c <= 1500 for c in counts)
    if skips:
        assert sum(counts) < 0.5 * 30 * 1500


def test_few_rows_and_none(spark):
    vectors = vectors_of(spark, [[1, 0], [0, 1], [-1, 0], [2, 0]])
    best, compared = clusters.clustered_topk(clusters.clustered(vectors), vectors, 10)
    assert rows_of(best) == rows_of(search.cosine_topk_batch(vectors, vectors, 10)) and {r["compared"] for r in compared.collect()} == {4}
    none = vectors.filter("false")
    for rows, asked in ((none, vectors), (vectors, none)):
        assert rows_of(clusters.clustered_topk(clusters.clustered(rows), asked, 3)[0]) == []


def test_a_vector_without_a_direction_fails(spark):
    with pytest.raises(Exception, match="without a direction"):
        clusters.clustered(vectors_of(spark, [[1, 0], [0, 0], [0, 1], [1, 1]]))


def test_only_visited_clusters_are_read(spark):
    made = clusters.clustered(vectors_of(spark, grouped(np.random.default_rng(1), 400, 6, 8, 0.01)))
    visited = spark.createDataFrame([(0, [1.0] * 6, 3, [0], 1)], "query_id long, v array<double>, cluster int, rings array<int>, n long")
    plan = clusters.searched(made, visited, 1, 10, 10)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cluster" in plan
    assert {r["cluster"] for r in made.rows.select("cluster").distinct().collect()} == set(made.cells["cluster"])
    assert made.rows.count() == made.cells["n"].sum() == 400 == made.rows.select(F.count_distinct("vec_id")).first()[0]


def test_float32_never_overflows_in_silence(spark):
    of = lambda *x: spark.createDataFrame([(list(x),)], "v array<double>").select(float32(F.col("v")).alias("v")).first()["v"]
    assert of(1.5, float("inf"), None) == [1.5, float("inf"), None]
    assert of(3.4028235e38) == [pytest.approx(3.4028235e38)]
    with pytest.raises(Exception, match="beyond float32"):
        of(1e39)


def test_a_block_is_scored_by_strips(monkeypatch):
    """No matrix of all scores of a block is held, and strips give the same rows."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(5)
    m = rng.normal(size=(3000, 8))
    vectors = pd.DataFrame({"vec_id": np.arange(3000), "v": list(m)})
    queries = pd.DataFrame({"query_id": np.arange(1000), "v": list(m[:1000])})
    monkeypatch.setattr(search, "CELLS", 1 << 16)
    tracemalloc.start()
    found = search.strips_best(queries, vectors, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 3000 * 1000
    whole = search.block_best(search.unit_scores(search.unit(queries["v"]), search.unit(vectors["v"])), queries["query_id"].to_numpy(), vectors["vec_id"].to_numpy(), 3)
    assert found.values.tolist() == whole.values.tolist()
    some = search.strips_best(queries, vectors, 3, lambda at, to: np.tile(np.arange(3000) % 2 == 0, (min(to, 1000) - at, 1)))
    assert set(some["vec_id"] % 2) == {0} and len(some) == 3000
    assert not len(search.strips_best(queries[:0], vectors, 3)) and not len(search.strips_best(queries, vectors[:0], 3))
