"""Spelling variants: words one edit apart, by an inverted index of positional q-grams with a count filter."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.near_duplicates import joined_apart
from cairn.session import discard, materialize

Q = 3
#: Words of one posting list that a task merges at once; longer lists are dealt by their words' one-deletion forms.
POSTINGS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, letters: int = 6, least: int = 5, noise: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: maximal runs of Latin letters, A-Z lower-cased, `noise` deletions applied, of `letters` letters and `least` occurrences."""
    run = F.explode(F.regexp_extract_all(docs[text_col], F.lit("([A-Za-zÀ-ÿ]+)"), F.lit(1)))
    rows = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), run.alias("run")).filter(F.length("run") >= letters)
    rows = rows.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.length("run").cast("long")).cast("int")
    gone = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = rows.select(F.when(h % noise == 0, gone).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def postings(words: DataFrame) -> DataFrame:
    """gram, side, at, node (the word): index entries of each word's rarest grams.

    One edit destroys Q grams at most, so of the grams that two near words keep the rarest is among the Q + 1 rarest of each,
    in one order of all grams. A gram before the edit keeps its place from the start, one behind it from the end: each
    place is entered from both sides.
    """
    grams = words.select("word", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("word") - Q + 1), lambda i: F.substr("word", i, F.lit(Q)))).alias("at", "gram"))
    held = grams.groupBy("word", "gram").agg(F.collect_list("at").alias("places"))
    held = materialize(held, "spelling-grams")
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    counts = materialize(counts, "spelling-gram-counts")
    ranked = joined_apart(held.withColumnRenamed("word", "node"), counts, ["gram"])
    rank = F.row_number().over(Window.partitionBy("node").orderBy("n", "gram"))
    rare = ranked.withColumn("rank", rank).filter(F.col("rank") <= Q + 1)
    start = rare.select("node", "gram", F.explode("places").alias("place"))
    return start.select("node", "gram", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("place").alias("at")), F.struct(F.lit(1).alias("side"), (F.length("node") - F.col("place")).alias("at")))).alias("p")).select("node", "gram", "p.*")


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(short, long, strict=False)) if x != y), len(short))
    return short[k + (len(a) == len(b)) :] == long[k + 1 :]


def near_pairs(words: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs of near words in one posting list: each word's grams' places are heap-merged, under a length and a position
    limit; pairs that share as many grams as one edit leaves, or more, are verified."""
    index: dict[str, list[tuple[int, int]]] = {}
    for k, w in enumerate(words):
        lists = [index.get(w[p : p + Q], ()) for p in range(len(w) - Q + 1)]
        merged = heapq.merge(*([(j, p) for j, at in entries if abs(at - p) <= 1 and abs(len(words[j]) - len(w)) <= 1] for p, entries in enumerate(lists)))
        for j, hits in groupby(merged, key=lambda e: e[0]):
            # A gram may meet its like at several places of one word: places count once.
            if len({p for _, p in hits}) >= max(len(w), len(words[j])) - 2 * Q + 1 and one_edit(w, words[j]):
                yield words[j], w
        for p in range(len(w) - Q + 1):
            index.setdefault(w[p : p + Q], []).append((k, p))


def pairs_of(lists: DataFrame) -> DataFrame:
    """a, b: near words in the given lists (a column words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sorted({tuple(sorted(p)) for words in b.column(0).to_pylist() for p in near_pairs(words)})
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], ["a", "b"])

    return lists.select("words").mapInArrow(run, "a string, b string")


def near_words(words: DataFrame, most: int = POSTINGS) -> DataFrame:
    """a < b, each pair of words one edit apart once; words of Q + 3 letters or more (shorter ones may keep no gram)."""
    key = ["gram", "side", "at"]
    index = materialize(postings(words), "spelling-index")
    sizes = materialize(index.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1"), "spelling-lists")
    met = materialize(joined_apart(index, sizes, key), "spelling-postings")
    # As many tasks as the session sets: lists are small in bytes and dear to merge, so Spark's coalescing by bytes would put them in one task.
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = met.filter(F.col("n") <= most).repartition(parts, *key).groupBy(*key).agg(F.collect_list("node").alias("words"))
    # Near words share a form that lacks one letter, or one is the other's: such lists hold a word or two for each letter and place.
    long = met.filter(F.col("n") > most).select("node").distinct()
    without = lambda i: F.concat(F.substr("node", F.lit(1), i), F.substr("node", i + 2))
    forms = F.array_distinct(F.concat(F.array("node"), F.transform(F.sequence(F.lit(0), F.length("node") - 1), without)))
    dealt = long.select("node", F.explode(forms).alias("form")).repartition(parts, "form").groupBy("form").agg(F.collect_list("node").alias("words")).filter(F.size("words") > 1)
    pairs = pairs_of(short).unionByName(pairs_of(dealt)).distinct()
    out = materialize(pairs, "spelling-pairs")
    discard(index, met)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to the last one, twice as far each round; counts grow fivefold a step, so rounds are few."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        at = materialize(at.join(further, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "spelling-roots")
        if at.filter("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")


def group_variants(docs: DataFrame, letters: int = 6, least: int = 5, noise: int = 199, times: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of a corpus with the spelling they are a variant of.

    Words are counted by Spark and near ones (one letter inserted, deleted or replaced) found in an inverted index of their
    rarest positional 3-grams: posting lists are merged by heap with a count of shared grams, and pairs verified. Lists of
    over POSTINGS words are dealt by one-deletion forms, exactly, so no list is merged whole and none is cut short.

    Columns: word, n, n_near (near words), form (the near word of largest n, ties to the smallest, if it has `times` times the
    word's n or more; else null), form_n, root (forms followed to the last; the word itself without one). A null text holds no words, a null doc_id
    counts as the empty string in the noise, repeated rows count each, an empty table gives no rows. Other columns, whatever their
    names, stay behind. letters: six or more, so that near words share a 3-gram.
    """
    if letters < 2 * Q:
        raise ValueError(f"words of under {2 * Q} letters may share no gram with a near word")
    words = materialize(word_counts(docs, letters, least, noise, id_col, text_col), "spelling-words")
    pairs = near_words(words)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), "n"), "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), F.col("b"))).alias("best"))
    known = words.join(near, "word", "left")
    enough = -F.col("best.m") >= times * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.b")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n"))
    known = materialize(known, "spelling-known")
    out = known.join(roots(known.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
