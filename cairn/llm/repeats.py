"""Removal of repeated passages with a logarithmic family of (sparse) suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import among, small_batches, texts
from cairn.session import discard, materialize

LENGTH = 200
#: Bytes of a suffix that its first block covers: shorter repeats, as of a common line, never reach the edges' comparison.
GRAM = 80
#: Windows in a cell of an edge.
CELL = 12
U = np.uint64
PIECE = 1 << 22
TABLE = np.random.default_rng(9).integers(1, 2**63, 256).astype(U)
BASE = 0x9E3779B97F4A7C15


def rolling(raw: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all strings of `size` bytes, put together from those of powers of two."""
    h, n, out, have = TABLE[raw], 1, None, 0
    while n <= size:
        if size & n:
            out = h if out is None else out[: len(out) - n] * U(pow(BASE, n, 2**64)) + h[have : have + len(out) - n]
            have += n
        if 2 * n <= size:
            h = h[: len(h) - n] * U(pow(BASE, n, 2**64)) + h[n:]
        n *= 2
    return out


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values, by running minima of blocks from both sides."""
    n = len(v)
    pad = np.full(-n % w, np.iinfo(U).max, U)
    blocks = np.concatenate([v, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def grams(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    return scramble(rolling(raw, gram)) if len(raw) >= gram else np.zeros(0, U)


def suffix_samples(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM, h: np.ndarray | None = None):
    """Sampled suffixes of texts laid end to end: (text, suffix start, first window, windows, key) as arrays.

    Each string of `length` bytes (window) names one of its suffixes, the one whose first `gram` bytes have the least hash,
    the leftmost of equals. That depends on the window's bytes alone: equal windows name suffixes at equal offsets, so
    repeats are found from the sampled suffixes and nothing is lost. A sampled suffix stands for a run of windows.
    """
    w = length - gram + 1
    if len(raw) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    h = grams(raw, gram) if h is None else h
    ranked = (h & ~U(0xFFFFFF)) | np.arange(len(h), dtype=U)
    least = sliding_min(ranked, w)
    span = np.maximum(ends - starts - length + 1, 0)
    text = np.repeat(np.arange(len(starts)), span)
    at = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span) + starts[text]
    if not len(at):
        return (at,) * 5
    name = (least[at] & U(0xFFFFFF)).astype(np.int64)
    new = np.flatnonzero((name[1:] != name[:-1]) | (text[1:] != text[:-1])) + 1
    head = np.concatenate([[0], new])
    count = np.diff(np.concatenate([head, [len(at)]]))
    return text[head], name[head], at[head], count, h[name[head]].view(np.int64)


ID = ["ta", "tb"]


def text_id() -> tuple[Column, Column]:
    """128 bits that name a text: rows of equal texts lose the same bytes, so they need no name of their own."""
    return F.xxhash64("text").alias("ta"), F.xxhash64(F.lit(9), "text").alias("tb")


SAMPLE = "ta long, tb long, key long, ctx long, first int, wins int, anchor short"


def sampled_suffixes(rows: DataFrame) -> DataFrame:
    """ta and tb (of text_id), key (name of the suffix's first block), ctx (name of all bytes of its windows), first, wins, anchor (where the suffix
    starts, from first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for b in batches:
            raws = [t.encode() for t in b.column(2).to_pylist()]
            pieces = []  # (row, offset, bytes): long texts in pieces that overlap by a window less one byte
            for k, r in enumerate(raws):
                pieces += [(k, o, r[o : o + PIECE + LENGTH - 1]) for o in range(0, max(len(r) - LENGTH + 1, 0), PIECE)]
            groups, size = [[]], 0
            for p in pieces:
                if size + len(p[2]) > 2 * PIECE and groups[-1]:
                    groups.append([])
                    size = 0
                groups[-1].append(p)
                size += len(p[2])
            for g in groups:
                if not g:
                    continue
                joined = b"".join(p[2] for p in g)
                ends = np.cumsum([len(p[2]) for p in g])
                starts = ends - [len(p[2]) for p in g]
                text, name, first, wins, key = suffix_samples(np.frombuffer(joined, np.uint8), starts, ends)
                if not len(text):
                    continue
                view = memoryview(joined)
                ctx = np.fromiter((xxh3_64_intdigest(view[a : a + n + LENGTH - 1]) for a, n in zip(first.tolist(), wins.tolist(), strict=True)), U, len(first)).view(np.int64)
                row = np.array([p[0] for p in g])[text]
                offset = np.array([p[1] for p in g])[text] - starts[text]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(key), pa.array(ctx), pa.array((first + offset).astype(np.int32)), pa.array(wins.astype(np.int32)), pa.array((name - first).astype(np.int16))],
                    [*ID, "key", "ctx", "first", "wins", "anchor"],
                )

    return rows.select(*ID, "text").mapInArrow(run, SAMPLE)


def merge_scan(arrays: list[DataFrame]) -> DataFrame:
    """Suffix arrays merged into one, in order, each distinct suffix once: key, ctx, n (places), fresh, lcp.

    Suffixes are compared block by block: the first GRAM bytes, then all others of the windows. A block is compared by its
    name, a 64-bit hash, so the order is lexicographic over blocks, and suffixes with a common prefix are neighbours as in any
    other alphabet's order. lcp is the longest common prefix with a neighbour: LENGTH (all) where a suffix has several places,
    GRAM where a neighbour has the same first block, else 0. The order is cut into ranges, also inside a first block that
    many suffixes share; what lies beyond the ends of a range isn't seen, so its end suffixes count as GRAM.
    """
    order = ["key", "ctx"]
    every = reduce(DataFrame.unionByName, [a.select(*order, "n", "fresh") for a in arrays])
    parts = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, ctx, n, fresh, before, after):
            lcp = np.where(n > 1, LENGTH, np.where(before | after, GRAM, 0)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ctx), pa.array(n.astype(np.int32)), pa.array(fresh), pa.array(lcp)], ["key", "ctx", "n", "fresh", "lcp"])

        held, before = None, np.array([True])  # the last suffix so far, and whether its first block is that of the one before
        for b in batches:
            if not b.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)]
            key, ctx, n, fresh = rows
            head = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])) + 1])
            n, fresh = np.add.reduceat(n.astype(np.int64), head), np.logical_or.reduceat(fresh, head)
            key, ctx = key[head], ctx[head]
            same = key[1:] == key[:-1]
            before = np.concatenate([before, same])
            if len(key) > 1:
                yield out(key[:-1], ctx[:-1], n[:-1], fresh[:-1], before[:-1], same)
            held, before = (key[-1:], ctx[-1:], np.minimum(n[-1:], 1 << 30), fresh[-1:]), before[-1:]
        if held is not None:
            yield out(*held, before, np.array([True]))

    ordered = every.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "key long, ctx long, n int, fresh boolean, lcp int")


class SuffixFamily:
    """Suffix arrays (levels) of the batches so far, each of twice as many batches as the next.

    A new batch's array is merge-scanned against every level for long matches. Levels as large as what has come since are
    merged with it in the same scan, so a suffix is written as often as the logarithm of the number of batches.
    """

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []  # rank and array
        self.found: list[DataFrame] = []

    def add(self, batch: DataFrame, last: bool = False) -> None:
        """Scan and add a batch. After the last one the levels are no longer needed: its merged array isn't written."""
        new = batch.groupBy("key", "ctx").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("n")).withColumn("fresh", F.lit(True))  # combined before the shuffle
        rank, merged = 0, []
        while self.levels and self.levels[-1][0] == rank:
            merged.append(self.levels.pop()[1])
            rank += 1
        old = lambda a: a.withColumn("fresh", F.lit(False))
        array = merge_scan([new, *map(old, merged)])
        if not last:
            array = materialize(array, "suffix-array")
        scans = [array, *(merge_scan([new if merged or last else array, old(level)]) for _, level in self.levels)]
        self.found += [materialize(s.filter("fresh and lcp > 0").select("key", "ctx", "lcp"), "suffix-matches") for s in scans]
        discard(*merged)
        if last:
            discard(*(a for _, a in self.levels))
            self.levels = []
        else:
            self.levels.append((rank, array))

    def repeated(self) -> DataFrame:
        """(key, ctx) of the suffixes with several places."""
        return self._of(f"lcp = {LENGTH}", "key", "ctx")

    def near(self) -> DataFrame:
        """Keys: first blocks that suffixes of several contexts may share."""
        return self._of("lcp > 0", "key")

    def _of(self, condition: str, *columns: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [f.filter(condition).select(*columns) for f in self.found]).distinct()


def edge_regions(near: DataFrame, samples: DataFrame, rows: DataFrame) -> DataFrame:
    """One place of each context of the given keys, with the bytes of its windows: key, ctx, once, ta, tb, first, wins, anchor, bytes."""
    test_key = among(near)
    place = [*ID, "first", "wins", "anchor"]
    # Places of one context are combined before they meet the keys, so that a passage of many documents is one row.
    alike = samples.filter(test_key("key")).groupBy("key", "ctx").agg((F.count("*") == 1).alias("once"), *[F.first(c).alias(c) for c in place])
    edge = materialize(alike.join(near, "key", "left_semi"), "suffix-edges")
    test = among(edge.select("ta"))
    lists = edge.groupBy(*ID).agg(F.collect_list(F.struct("key", "ctx", "once", "first", "wins", "anchor")).alias("list"))  # no more than the text has windows
    have = rows.filter(test("ta")).groupBy(*ID).agg(F.first("text").alias("text")).join(lists, ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (t, found) in enumerate(zip(b.column(2).to_pylist(), b.column(3), strict=True)):
                raw = t.encode()
                fields = found.values
                for at in range(0, len(fields), 1 << 14):
                    part = fields.slice(at, 1 << 14)
                    columns = dict(zip([f.name for f in part.type], part.flatten(), strict=True))
                    data = [raw[a : a + n + LENGTH - 1] for a, n in zip(columns["first"].to_pylist(), columns["wins"].to_pylist(), strict=True)]
                    take = pa.array(np.full(len(part), k))
                    yield pa.RecordBatch.from_arrays(
                        [columns["key"], columns["ctx"], columns["once"], b.column(0).take(take), b.column(1).take(take), columns["first"], columns["wins"], columns["anchor"], pa.array(data, pa.binary())],
                        ["key", "ctx", "once", *ID, "first", "wins", "anchor", "bytes"],
                    )

    regions = have.select(*ID, "text", "list").mapInArrow(run, "key long, ctx long, once boolean, ta long, tb long, first int, wins int, anchor short, bytes binary")
    regions = materialize(regions, "suffix-regions")
    discard(edge)
    return regions


def cells_of(anchor: int, wins: int) -> Iterator[tuple[int, int, int, bool]]:
    """(cell, least and largest offset, whether the run has all of it) of the cells that a run of windows meets.

    A window's offset is how far it begins before its suffix, 0 to LENGTH - GRAM. A cell holds CELL offsets.
    """
    least, most = anchor - wins + 1, anchor
    for cell in range(least // CELL, most // CELL + 1):
        lo, hi = cell * CELL, min(cell * CELL + CELL - 1, LENGTH - GRAM)
        yield cell, lo, hi, least <= lo and hi <= most


def edge_marks(regions: DataFrame) -> DataFrame:
    """Windows repeated at the edges of a match: ta, tb, first, wins. The regions' own folder is emptied.

    There suffixes share their first block, but their contexts differ. Equal windows begin at equal offsets, so windows are
    compared cell by cell: bytes that all windows of a cell hold (its core) and bytes that any of them holds (its hull). A
    core that no other context has rules the cell out; where all contexts with one core have one hull, all its windows are
    repeated; only the cells between are compared window by window. Places of contexts that occur twice are marked already.
    """
    from_bytes = "key long, ctx long, once boolean, ta long, tb long, cell short, core long, hull long, first int, wins int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as name

        for b in batches:
            at, cells, cores, hulls, firsts, counts = [], [], [], [], [], []
            for k, (first, wins, anchor, raw) in enumerate(zip(*(b.column(c).to_pylist() for c in ("first", "wins", "anchor", "bytes")), strict=True)):
                for cell, lo, hi, whole in cells_of(anchor, wins):
                    at.append(k)
                    cells.append(cell)
                    cores.append(name(raw[anchor - lo : anchor - hi + LENGTH]))
                    hulls.append(name(raw[anchor - hi : anchor - lo + LENGTH]) if whole else None)
                    firsts.append(first + anchor - hi)
                    counts.append(hi - lo + 1)
            if at:
                take = pa.array(at)
                signed = lambda x: pa.array(x, pa.uint64()).view(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("key").take(take), b.column("ctx").take(take), b.column("once").take(take), *(b.column(c).take(take) for c in ID), pa.array(cells, pa.int16()), signed(cores), signed(hulls), pa.array(firsts, pa.int32()), pa.array(counts, pa.int32())],
                    ["key", "ctx", "once", *ID, "cell", "core", "hull", "first", "wins"],
                )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as name

        for b in batches:
            at, hashes, firsts = [], [], []
            for k, (first, wins, anchor, raw, open_) in enumerate(zip(*(b.column(c).to_pylist() for c in ("first", "wins", "anchor", "bytes", "open")), strict=True)):
                for cell, lo, hi, _ in cells_of(anchor, wins):
                    if cell in open_:
                        for p in range(max(anchor - hi, 0), min(anchor - lo, wins - 1) + 1):
                            at.append(k)
                            hashes.append(name(raw[p : p + LENGTH]))
                            firsts.append(first + p)
            if at:
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column("key").take(take), pa.array(hashes, pa.uint64()).view(pa.int64()), b.column("once").take(take), *(b.column(c).take(take) for c in ID), pa.array(firsts, pa.int32())], ["key", "hash", "once", *ID, "first"])

    cells = materialize(regions.mapInArrow(cut, from_bytes), "suffix-cells")
    by = ["key", "cell", "core"]
    shared = cells.groupBy(*by).agg(F.count("*").alias("n"), F.count("hull").alias("whole"), F.min("hull").alias("a"), F.max("hull").alias("b")).filter("n > 1")
    shared = shared.select(*by, F.expr("whole = n and a = b").alias("settled"))
    met = materialize(cells.join(shared, by).select("key", "ctx", "once", *ID, "cell", "first", "wins", "settled"), "suffix-met")
    discard(cells)
    settled = met.filter("settled and once").select(*ID, "first", "wins")
    open_ = met.filter("not settled").groupBy("key", "ctx").agg(F.collect_set("cell").alias("open"))  # a region has eleven cells at most
    listed = materialize(regions.join(open_, ["key", "ctx"]).mapInArrow(windows, "key long, hash long, once boolean, ta long, tb long, first int"), "suffix-windows")
    discard(regions)
    twice = listed.groupBy("key", "hash").agg(F.count("*").alias("c")).filter("c > 1").select("key", "hash")
    found = listed.filter("once").join(twice, ["key", "hash"], "left_semi").select(*ID, "first", F.lit(1).alias("wins"))
    marks = materialize(settled.unionByName(found), "suffix-marks")
    discard(met, listed)
    return marks


def remove_repeats(docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text", texts_out: bool = False) -> DataFrame:
    """Removes every byte covered by a string of 200 bytes that starts anywhere else too, all copies alike.

    Texts come in `batches` batches by a hash. Each batch's sampled suffixes become a suffix array that is merge-scanned with
    the levels of the family. A suffix that two places share whole marks the windows it stands for; suffixes that share only
    their first block mark the windows that their contexts share. Equality is that of 128 bits of hashes.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with texts_out also `kept`, the bytes left. Null or empty text:
    no bytes. Repeated rows are repeats of each other; a text's marks are found and listed once, however many rows have it. An
    empty table: no rows. Texts are moved only where they hold marks or edges.
    """
    small_batches(docs.sparkSession)
    rows = texts(docs, id_col, text_col).select("*", *text_id())
    samples = materialize(sampled_suffixes(rows), "suffix-samples")
    family = SuffixFamily()
    batch = F.pmod(F.xxhash64(*ID), F.lit(batches))
    for k in range(batches):
        family.add(samples.filter(batch == k), last=k == batches - 1)
    repeated, near = materialize(family.repeated(), "suffix-repeated"), materialize(family.near(), "suffix-near")
    discard(*family.found)
    test = among(repeated.select(F.xxhash64("key", "ctx").alias("h")))
    whole = samples.filter(test(F.xxhash64("key", "ctx"))).join(repeated, ["key", "ctx"], "left_semi").select(*ID, "first", "wins")
    whole, regions = materialize(whole, "suffix-whole"), edge_regions(near, samples, rows)
    discard(samples, repeated, near)
    edges = edge_marks(regions)
    spans = whole.unionByName(edges).groupBy(*ID).agg(F.collect_set(F.struct("first", "wins")).alias("list"))  # a set: no more than the text has windows
    spans = materialize(spans, "suffix-spans")
    discard(whole, edges)
    marked = among(spans.select("ta"))
    rows = rows.withColumn("maybe", marked("ta"))
    kind = dict(rows.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = t.encode()
                runs: list[list[int]] = []
                for a, z in sorted((e["first"], e["first"] + e["wins"] + LENGTH - 1) for e in found or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], z)
                    else:
                        runs.append([a, z])
                at, kept = 0, []
                for a, z in runs:
                    kept.append(raw[at:a])
                    at = z
                left = b"".join([*kept, raw[at:]])
                out.append((len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left if texts_out else None))
            n, gone, spans_, sha, left = zip(*out, strict=True) if out else ((),) * 5
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans_, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts_out:
                columns.append(pa.array(left, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    cut_schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts_out
    changed = rows.filter("maybe").join(spans, ID, "left").select("doc_id", "text", "list").mapInArrow(cut, cut_schema)
    raw = F.col("text").cast("binary")
    same = rows.filter("not maybe").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), *([raw.alias("kept")] if texts_out else []))
    return changed.unionByName(same)
