"""The pipeline's stages on the smallest tables, each against what it must keep."""

import corpus_pipeline as p
import pytest
from pyspark.sql import functions as F

from cairn.llm import queries, quality, secret_scan
from cairn.session import materialize, table
from tests.llm import cases
from tests.llm.test_operators import brute_classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outs(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in p.STAGES:
        out.append(docs)
        docs = materialize(stage(spark, docs, SF), "test-stage")
    return [*out, docs]


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_columns(outs):
    assert all(df.columns == outs[0].columns and df.dtypes == outs[0].dtypes for df in outs[:-1])


def test_quality_keeps_the_accepted(spark, outs):
    rejected = {r["doc_id"] for r in quality.score_quality(outs[0], table(spark, SF, "labels")).filter("predicted = 0").collect()}
    assert rejected and rows(outs[1], *outs[0].columns) == [r for r in rows(outs[0], *outs[0].columns) if r[0] not in rejected]


def test_one_of_each_class_stays(outs):
    before = rows(outs[1], "doc_id", "text")
    kept = {c for _, c, _ in brute_classes(before)}
    assert len(kept) < len(before) and rows(outs[2], "doc_id", "text") == [r for r in before if r[0] in kept]


def test_secrets_are_masked(outs):
    assert rows(outs[3], "doc_id", "text", "n_chars") == [(i, t, len(t)) for i, t in ((i, secret_scan.redact(t)) for i, t in rows(outs[2], "doc_id", "text"))]
    assert not any(secret_scan.find_secrets(t) for (t,) in rows(outs[3], "text"))


def test_mix_takes_whole_documents(outs):
    before = rows(outs[3], "doc_id", "text")
    after = rows(outs[4], "doc_id", "text")
    assert set(after) <= set(before) and all(after.count(r) <= 2 for r in before)
    words = lambda x: sum(len(t.split()) for _, t in x)
    assert abs(words(after) - 1.5 * words(before)) < 0.05 * words(before)


def test_tokens_decode_to_the_text(outs):
    assert rows(outs[5], "doc_id", "decoded") == rows(outs[4], "doc_id", "text")


def test_run(spark, outs):
    assert rows(p.run(spark, SF), "doc_id", "n_tokens") == rows(outs[5], "doc_id", "n_tokens")
    assert "pipeline" in queries.QUERIES and p.ORACLE_SQL is None and [n for n, _ in p.STAGES][1] == "minhash_near_dedup"


@pytest.mark.parametrize("stage", [f for _, f in p.STAGES])
def test_stages_take_nulls_and_no_rows(spark, stage):
    docs = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "a b", None, None, None), (2, "", "en", "s", 0)], table(spark, SF, "documents").schema)
    stage(spark, docs, SF).collect()
    assert stage(spark, docs.limit(0), SF).collect() == []


def test_distinct_texts_of_null_and_repeated_ids_stay(spark, outs):
    a, b, c, d, e = (cases.prose(70 + k, 60) for k in range(5))
    given = [(1, a), (1, b), (2, b), (None, c), (None, d), (None, d), (None, e), (3, cases.edited(e, 1, 1)), (4, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t or "")) for k, (i, t) in enumerate(given)], outs[0].schema)
    kept = p.keep_distinct(spark, docs, SF)
    assert kept.dtypes == docs.dtypes
    assert sorted(rows_of(kept), key=repr) == sorted([(1, a), (1, b), (None, c), (None, d), given[7], (4, None)], key=repr)
    # Of one class and one id, the text of least key; other rows of the class go.
    near = spark.createDataFrame([(5, t, "en", "s", len(t)) for t in (a, cases.edited(a, 2, 1))], outs[0].schema)
    least = near.orderBy(F.xxhash64("text")).first()["text"]
    assert rows_of(p.keep_distinct(spark, near, SF)) == [(5, least)]


def test_mix_decides_each_row_of_an_id(spark, outs):
    given = [(k if k % 9 == 0 else None, cases.prose(100 + k, 20 + k % 7), "en", f"s{k % 2}", 1) for k in range(90)] + [(None, "[SECRET] same", None, "en", 1), (None, "[SECRET] same", "en", None, 1)]
    taken = rows_of(p.mix(spark, spark.createDataFrame(given, outs[0].schema), SF))
    size = lambda x: sum(len(t.split()) for _, t in x)
    assert all(taken.count(r) <= 2 for r in set(taken) if "same" not in r[1]) and taken.count((None, "[SECRET] same")) <= 4
    assert abs(size(taken) - 1.5 * size([r[:2] for r in given])) < 0.05 * size(taken)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]
