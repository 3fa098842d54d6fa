"""Collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.llm import collocations
from tests.llm import cases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mined(rows, least, share, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in often.items():
            for z in range(2, len(p)):
                for i in range(len(p) - z + 1):
                    inside[p[i : i + z]] = max(inside[p[i : i + z]], a)
        found = []
        for p, a in often.items():
            if 100 * inside[p] >= share * a:
                continue
            score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return out


def check(spark, rows, least=30, share=80, top=2000):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = [tuple(r) for r in collocations.mine_phrases(docs, least, share, top).collect()]
    want = mined(rows, least, share, top)
    assert sorted(got) == sorted(want)
    return want


def test_cases(spark):
    assert check(spark, [(r[2], r[1]) for r in cases.rows()], least=2)


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_of_any_length(spark, seed):
    """Overlaps, phrases across lines and pieces, ties, other alphabets, words with characters of no piece."""
    rng = random.Random(seed)
    words = ["a", "A", "b", "é", "É", "日本", "x-y", " ", "\x1c", "it's", "\x00"]
    ends = [" ", " ", " ", "  ", "\t", ".", "\n", "\r", "\x0b", ";", "! "]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(120)))) for _ in range(60)]
    rows += [("en", "the cat sat down. " * 40), ("en", "b b b b b b b " * 9), ("fr", None), ("fr", ""), (None, "x" * 100000 + " y" * 70)]
    assert 4 in {len(r[2].split(" ")) for r in check(spark, rows, least=5)}
    check(spark, rows, least=12, share=50, top=7)


def test_parts_of_a_stream():
    """Phrases across a cut are counted once."""
    rng = random.Random(3)
    text = " ".join(rng.choice(["aa", "b", "c.", "dd!"]) for _ in range(3000))
    every = lambda h: h == h
    totals = []
    for piece in (1 << 21, 5000, 97, 1):
        f = Counter()
        for part in collocations.word_streams(["en"], [text], piece):
            for phrases, n in (collocations.words_alone(*part), collocations.phrase_counts(*part, every), collocations.phrase_counts(*part, every, every)):
                f.update(dict(zip(phrases, [int(k) for k in n], strict=True)))
        totals.append({p: k for p, k in f.items() if k})
    assert all(t == totals[0] for t in totals) and max(len(p.split()) for p in totals[0]) == 4


def test_exact_beyond_64_bits(spark):
    big = 2**62
    phrases = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, f long")
    parts = spark.createDataFrame([("en", "a", big + 5), ("en", "b", big + 1)], "lang string, phrase string, f long")
    assert collocations.scored(phrases, parts).first()["score"] == 2000000 * big // (2 * big + 6)


def test_names_are_sparks(spark):
    got = spark.createDataFrame([("dé", "ab ç")], "lang string, phrase string").select(F.xxhash64("lang", F.lit("ab")), F.xxhash64("lang", F.lit("ç")), collocations.pair_names(F.col("phrase"))).first()
    a, b = collocations.names_of("dé", [b"ab", "ç".encode()]).tolist()
    assert tuple(x % 2**64 for x in got) == (a, b, a ^ b >> 1)


def test_no_rows_and_other_columns(spark):
    assert collocations.mine_phrases(cases.empty(spark)).collect() == []
    clash = cases.table(spark).selectExpr("*", "1 AS phrase", "2 AS f", "3 AS rank")
    assert collocations.mine_phrases(clash, least=2).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
