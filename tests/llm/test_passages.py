"""Passages of earlier documents against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import passages
from tests.llm import cases

LAST = (1 << 63) - 1


def kept_words(rows, window):
    """(doc_id, words, words left) of each row."""
    texts = [(LAST if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for (i, w), (doc_id, _) in zip(texts, rows, strict=True):
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((doc_id, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def check(spark, rows, window):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in passages.remove_passages(docs, window, texts_out=True).select("doc_id", "n_words", "n_removed", "kept", "kept_sha256").collect()]
    want = [(*r, hashlib.sha256(r[3].encode()).hexdigest()) for r in kept_words(rows, window)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return want


@pytest.mark.parametrize("period", passages.COVERS)
def test_covers(period):
    cover = passages.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_cases(spark):
    rows = [(r[0], r[1]) for r in cases.rows()]
    assert sum(w[2] for w in check(spark, rows, 50)) > 0


@pytest.mark.parametrize("window", [1, 8, 21, 50])
def test_shifted_copies(spark, window):
    """Passages at every offset against the cover, overlapping, edited, within a document and at its ends; a hot passage."""
    rng = random.Random(window)
    draw = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n)]
    base, hot = draw(150), draw(window + 7)
    rows = []
    for k in range(60):
        a = rng.randrange(80)
        piece = base[a : a + rng.randrange(window - 1, window + 40)]
        if piece and rng.random() < 0.4:
            piece[rng.randrange(len(piece))] = "edit"
        rows.append((rng.randrange(40) if k % 9 else None, " \t".join([*draw(rng.randrange(0, 40)), *piece, *draw(rng.randrange(0, 40))]) + "\n" * (k % 3)))
    rows += [(100 + k, " ".join([*draw(k % 35), *hot, *draw(k % 5)])) for k in range(60)]
    rows += [(200, " ".join(hot + ["x"] + hot)), (201, "y " * 300), (202, "z " * 300 + "y " * 90), (203, " ".join(hot)), (204, "w" * 5000 + " v" * 120), (205, "w" * 5000 + " v" * 120)]
    check(spark, rows, window)


def test_many_copies(spark):
    """Hot groups are dealt over tasks: more rows of one anchor than a task takes."""
    text = cases.prose(3, 70)
    got = passages.remove_passages(spark.range(2500).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))).agg(F.sum("n_removed"), F.sum("n_words")).first()
    assert tuple(got) == (2499 * 70, 2500 * 70)


def test_no_rows_and_other_columns(spark):
    assert passages.remove_passages(cases.empty(spark)).collect() == []
    clash = cases.table(spark).withColumn("doc", F.lit(1)).withColumn("h", F.lit("x")).withColumn("first", F.lit(None).cast("int"))
    assert passages.remove_passages(clash).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_hashes_of_words():
    raw = np.frombuffer(("a bb a " + "c" * 5000 + " bb " + "c" * 5000).encode(), np.uint8)
    for h in passages.word_hashes(raw, *passages.word_places(raw)):
        assert h[0] == h[2] and h[1] == h[4] and h[3] == h[5] and len(set(h.tolist())) == 3
