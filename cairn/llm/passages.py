"""Removal of passages that an earlier document has: hashes at the positions of a difference cover, then extension."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import among, key_bitmap, small_batches
from cairn.llm.near_duplicates import joined_apart
from cairn.session import discard, materialize

WINDOW = 50
#: Difference covers: every residue of the period is the difference of two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (1, 5, 11, 24, 25, 27)}
U = np.uint64
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_rng = np.random.default_rng(12)
#: Two families of hashes, each with a value for each byte and a multiplier.
LETTERS = _rng.integers(1, 2**63, (2, 256)).astype(U)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Longer words are hashed one by one.
LONG_WORD = 4096
POWERS = np.stack([np.multiply.accumulate(np.concatenate([[U(1)], np.full(LONG_WORD - 1, U(b))])) for b in BASES])


def cover_of(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors of a third of the window or more, with its cover."""
    period = max((p for p in COVERS if 3 * (window - p + 1) >= window), default=1)
    return period, COVERS.get(period, (0,))


def word_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in bytes of UTF-8."""
    edge = np.diff(np.concatenate([[True], BLANK[raw], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, at_once: int = 1 << 16) -> list[np.ndarray]:
    """Two 64-bit hashes of every word."""
    from xxhash import xxh3_64_intdigest

    out = [np.zeros(len(starts), U), np.zeros(len(starts), U)]
    short = np.flatnonzero(ends - starts <= LONG_WORD)
    for a in range(0, len(short), at_once):
        some = short[a : a + at_once]
        n = ends[some] - starts[some]
        head = np.cumsum(n) - n
        within = np.arange(n.sum()) - np.repeat(head, n)
        letters = raw[np.repeat(starts[some], n) + within]
        for family, h in enumerate(out):
            h[some] = mixed(np.add.reduceat(LETTERS[family][letters] * POWERS[family][within], head))
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        word = raw[starts[k] : ends[k]].tobytes()
        for family, h in enumerate(out):
            h[k] = xxh3_64_intdigest(word, family + 1)
    return out


def of_runs(h: np.ndarray, size: int, family: int) -> np.ndarray:
    """Hashes of all runs of `size` words, put together from those of powers of two."""
    base, n, out, have = BASES[family], 1, None, 0
    if len(h) < size:
        return np.zeros(0, U)
    while n <= size:
        if size & n:
            out = h if out is None else out[: len(out) - n] * U(pow(base, n, 2**64)) + h[have : have + len(out) - n]
            have += n
        if 2 * n <= size:
            h = h[: len(h) - n] * U(pow(base, n, 2**64)) + h[n:]
        n *= 2
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def anchors_of(raw: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(word positions, hashes, hashes of the words) of a text's anchors: runs of window - period + 1 words at positions of the cover."""
    period, cover = cover_of(window)
    starts, ends = word_places(raw)
    if len(starts) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    words = word_hashes(raw, starts, ends)
    h = signed(mixed(of_runs(words[0], window - period + 1, 0)))
    at = np.flatnonzero(np.isin(np.arange(period), cover)[np.arange(len(h)) % period])
    return at, h[at], words


def contexts_of(at: np.ndarray, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, context) of anchors at these positions: the windows that hold the anchor, and a hash of all
    their words with the anchor's place among them."""
    anchor = window - cover_of(window)[0] + 1
    first = np.maximum(at - (window - anchor), 0)
    wins = np.minimum(at, len(words) - window) - first + 1
    context = np.zeros(len(at), U)
    for n in np.unique(wins):
        some = np.flatnonzero(wins == n)
        context[some] = of_runs(words, int(n) + window - 1, 1)[first[some]]
    return first, wins, signed(mixed(context ^ mixed((at - first).astype(U) * U(257) + wins.astype(U))))


LAST = (1 << 63) - 1


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, doc (a null id comes after all others) and node, which with doc tells rows apart."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("doc_id", "text").alias("node"))


def all_anchors(rows: DataFrame, window: int) -> DataFrame:
    """h and doc of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, doc = [], []
            for t, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, h, _ = anchors_of(np.frombuffer(t.encode(), np.uint8), window)
                found.append(h)
                doc.append(np.full(len(h), d, np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(doc))], ["h", "doc"])

    return rows.select("text", "doc").mapInArrow(run, "h long, doc long")


def shared_anchors(rows: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """The anchors that may be in `shared`, with what extends them: h, ctx, doc, node, first, wins."""
    known = key_bitmap(shared.select("h"))
    names = ["h", "ctx", "doc", "node", "first", "wins"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, d, node in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                at, h, words = anchors_of(np.frombuffer(t.encode(), np.uint8), window)
                keep = np.flatnonzero(known(h)) if len(h) else at
                if len(keep):
                    first, wins, context = contexts_of(at[keep], words[1], window)
                    out.append((h[keep], context, np.full(len(keep), d, np.int64), np.full(len(keep), node, np.int64), first.astype(np.int32), wins.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    return rows.select("text", "doc", "node").mapInArrow(run, "h long, ctx long, doc long, node long, first int, wins int")


def runs_from(lists: pa.Array, k: int) -> list[tuple[int, int]]:
    """Runs of windows (first, behind the last) of row k's list of (first, wins), merged."""
    found = lists[k].values
    if found is None or not len(found):
        return []
    first, wins = (np.asarray(f) for f in found.flatten())
    order = np.argsort(first, kind="stable")
    first, behind = first[order].astype(np.int64), np.maximum.accumulate((first + wins)[order].astype(np.int64))
    head = np.concatenate([[0], np.flatnonzero(first[1:] > behind[:-1]) + 1])
    return list(zip(first[head].tolist(), behind[np.concatenate([head[1:] - 1, [len(first) - 1]])].tolist(), strict=True))


def listed_windows(have: DataFrame, window: int) -> DataFrame:
    """Every window of the listed runs of a text: wa, wb (128 bits that name its words), doc, node, first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (t, d, node) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "doc", "node")), strict=True)):
                raw = np.frombuffer(t.encode(), np.uint8)
                words = word_hashes(raw, *word_places(raw))
                at = np.concatenate([np.arange(a, z) for a, z in runs_from(b.column("list"), k)])
                wa, wb = (signed(of_runs(words[f], window, f)[at]) for f in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (wa, wb, np.full(len(at), d, np.int64), np.full(len(at), node, np.int64), at.astype(np.int32))], ["wa", "wb", "doc", "node", "first"])

    return have.select("text", "doc", "node", "list").mapInArrow(run, "wa long, wb long, doc long, node long, first int")


def listed(marks: DataFrame) -> DataFrame:
    """A row's marks in one list, which is a set: no longer than its text has windows."""
    return marks.groupBy("doc", "node").agg(F.collect_set(F.struct("first", "wins")).alias("list"))


def remove_passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", texts_out: bool = False) -> DataFrame:
    """Removes every word covered by a run of `window` words that also starts in a document of smaller doc_id.

    Runs of window - period + 1 words (anchors) are hashed at positions of a difference cover alone: 6 of 31. Two equal windows
    at any two positions have a common shift to positions of the cover, so they share an anchor at equal offsets, and
    nothing is lost. Anchors of several documents extend: the windows that hold an anchor together are its context. Of equal
    contexts all but those of the smallest doc_id are settled at once; only where an anchor has several contexts are the
    windows of the smallest documents compared one by one. No pairs are formed: each group gives its smallest doc_id, which
    its rows meet by joins that deal hot groups over tasks. Equality is that of 128 bits of hashes.

    Columns: doc_id, n_words, n_removed, kept_sha256; with texts_out also `kept`, the words left, joined by one space. Words
    are runs of bytes other than blanks (space, tab to carriage return). Null or empty text: no words. Rows of one doc_id are
    one document, so they don't lose words to each other; a null doc_id comes after all others, and null ones don't lose words
    to each other. An empty table: no rows. Other columns, whatever their names, stay behind.
    """
    small_batches(docs.sparkSession)
    rows = numbered(docs, id_col, text_col)
    shared = all_anchors(rows, window).groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("z"), F.count("*").alias("n"))
    shared = materialize(shared.filter("a < z").select("h", "n"), "passage-anchors")
    members = materialize(joined_apart(shared_anchors(rows, shared, window), shared, ["h"]).drop("n"), "passage-members")
    contexts = materialize(members.groupBy("h", "ctx").agg(F.min("doc").alias("least"), F.count("*").alias("n")), "passage-contexts")
    several = materialize(contexts.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "passage-several")
    open_ = joined_apart(contexts.drop("n").withColumnRenamed("ctx", "node"), several, ["h"]).select("h", F.col("node").alias("ctx"), F.lit(True).alias("open"))
    contexts = materialize(contexts.join(open_, ["h", "ctx"], "left"), "passage-open")
    met = materialize(joined_apart(members, contexts, ["h", "ctx"]).filter("doc > least or open").selectExpr("doc", "node", "first", "wins", "doc > least as settled"), "passage-met")
    discard(members)

    lists = materialize(listed(met.filter("not settled")), "passage-lists")
    here = among(lists.select("node"))
    have = rows.filter(here("node")).join(lists, ["doc", "node"])
    windows = materialize(listed_windows(have, window), "passage-windows")
    earlier = windows.groupBy("wa", "wb").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("n")).filter("least < most").drop("most")
    earlier = materialize(earlier, "passage-earlier")
    late = joined_apart(windows, earlier, ["wa", "wb"]).filter("doc > least").select("doc", "node", "first", F.lit(1).alias("wins"))
    spans = materialize(listed(met.filter("settled").drop("settled").unionByName(late)), "passage-spans")
    discard(windows)

    marked = among(spans.select("node"))
    rows = rows.withColumn("maybe", marked("node"))
    kind = dict(rows.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, t in enumerate(b.column("text").to_pylist()):
                words = t.encode().split()
                left, at = [], 0
                for first, behind in runs_from(b.column("list"), k):
                    left += words[at:first]
                    at = max(at, behind + window - 1)
                left += words[at:]
                kept = b" ".join(left)
                out.append((len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode() if texts_out else None))
            n, gone, sha, kept = zip(*out, strict=True) if out else ((),) * 4
            columns = {"doc_id": b.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"kept": pa.array(kept, pa.string())} if texts_out else {}))

    changed = rows.filter("maybe").join(spans, ["doc", "node"], "left").select("doc_id", "text", "list")
    same = rows.filter("not maybe").select("doc_id", "text", F.lit(None).cast("array<struct<first:int,wins:int>>").alias("list"))
    return changed.unionByName(same).mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts_out)
