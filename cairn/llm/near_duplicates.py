"""Near-duplicate classes of documents: BagMinHash signatures, banding, exact multiset overlap, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import among, small_batches, text_key, texts
from cairn.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS = 128
ROWS_PER_BAND = 4
U = np.uint64


def scramble(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser over uint64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the text's word shingles, and how often each occurs. Texts under `size` words are one shingle."""
    from xxhash import xxh3_64_intdigest as h

    words = np.fromiter(map(h, text.split()), U)
    n = max(1, len(words) - size + 1)
    value = np.full(n, len(words) if len(words) < size else size, U)
    for k in range(min(size, len(words))):
        value = scramble(value * U(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(value, return_counts=True)


def bag_signature(elements: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash (Ertl 2018): equal registers have probability the weighted Jaccard similarity of two bags.

    Each unit of weight carries a Poisson process of points, of rate 1 a register. Weights are cut hierarchically, into (0, 1],
    (1, 2], (2, 4], (4, 8] ...: a piece has one process for its whole length, given by (element, piece), whose points also have
    a height; those above the element's weight are thinned out. So bags see the same points where their weights overlap. A
    register keeps the first point that falls on it. Points are drawn in order, and no further than a time that fills all
    registers with near certainty; if one is still empty the time is doubled.
    """
    top = np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64)
    element = np.repeat(np.arange(len(elements)), top + 1)
    piece = np.arange(len(element)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    low = np.where(piece > 0, 1 << np.maximum(piece - 1, 0), 0)
    length = np.maximum(low, 1)
    seed = scramble(elements[element] + scramble(piece.astype(U) + U(0x51ED270B)))
    until = (np.log(registers) + 4) / weights.sum()
    while True:
        times, ids, where = [], [], []
        active, at, drawn = np.arange(len(seed)), np.zeros(len(seed)), 0
        while len(active):
            expected = registers * length[active].max() * until
            many = min(int(expected + 2 * np.sqrt(expected) + 2), max(2, 400_000 // len(active)))
            draw = scramble(seed[active, None] + U(0x9E3779B97F4A7C15) * (np.arange(drawn, drawn + many, dtype=U) + U(1)))
            gap = -np.log(((draw >> U(11)).astype(float) + 0.5) * 2.0**-53) / (registers * length[active])[:, None]
            t = at[active, None] + np.cumsum(gap, 1)
            i, j = np.nonzero(t <= until)
            second = scramble(draw[i, j])
            height = low[active][i] + ((second >> U(32)).astype(np.int64) * length[active][i] >> 32) + 1
            below = height <= weights[element[active][i]]
            times.append(t[i, j][below])
            ids.append(second[below])
            where.append((second[below] & U(0xFFFFFFFF)).astype(np.int64) * registers >> 32)
            at[active] = t[:, -1]
            drawn += many
            active = active[t[:, -1] <= until]
        times, ids, where = np.concatenate(times), np.concatenate(ids), np.concatenate(where)
        if len(np.unique(where)) == registers:
            break
        until *= 2
    order = np.argsort(-times, kind="stable")
    signature = np.zeros(registers, U)
    signature[where[order]] = ids[order]
    return signature


def bands_of(signature: np.ndarray, rows: int = ROWS_PER_BAND) -> np.ndarray:
    """A 64-bit key for each band of `rows` registers."""
    parts = signature.reshape(-1, rows)
    key = np.arange(len(parts), dtype=U)
    for k in range(rows):
        key = scramble(key * U(0x9E3779B97F4A7C15) + parts[:, k])
    return key.view(np.int64)


def multiset_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def bag_node() -> F.Column:
    """16 bytes that name a text by its words: texts that differ in white space alone share them."""
    return F.unhex(F.md5(F.trim(F.regexp_replace("text", r"\s+", " ")).cast("binary")))


def signed(rows: DataFrame) -> DataFrame:
    """node, weight and bands of each distinct bag. Every text is signed where it is read; only signatures are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight, bands = [], []
            for t in b.column(1).to_pylist():
                e, w = shingles(t)
                weight.append(int(w.sum()))
                bands.append(bands_of(bag_signature(e, w)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weight, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["node", "weight", "bands"])

    every = rows.select("node", "text").mapInArrow(run, "node binary, weight long, bands array<long>")
    return every.groupBy("node").agg(F.first("weight").alias("weight"), F.first("bands").alias("bands"))


def bags_of(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """node, elements and counts (packed arrays) of the given nodes, from the texts.

    A bitmap of bounded size keeps most other texts out of the shuffle; copies of a text are combined before it.
    """
    nodes = nodes.select("node").distinct()
    test = among(nodes.select(F.xxhash64("node").alias("h")))
    chosen = rows.filter(test(F.xxhash64("node"))).groupBy("node").agg(F.first("text").alias("text")).join(nodes, "node", "left_semi")

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([e.tobytes() for e, _ in found], pa.binary()), pa.array([w.astype(np.int32).tobytes() for _, w in found], pa.binary())], ["node", "elements", "counts"]
            )

    return materialize(chosen.mapInArrow(bag, "node binary, elements binary, counts binary"), "near-bags")


def joined_apart(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", least: int = 1024) -> DataFrame:
    """`many` (with a column node) joined to `few`, a written table with one row a key and n, the rows of `many` that have it.

    Rows of a hot key are dealt over several tasks of about equal shares, and the key's row goes to each. Hot is a key with
    over `least` rows and over a 2**14th of all, so no more than 2**14 keys are hot and broadcast, at any size.
    """
    share = max(least, (few.agg(F.sum("n")).first()[0] or 0) >> 14)
    tasks = F.ceil(F.col("n") / share).cast("int")
    hot = few.filter(F.col("n") > share).select(*keys, tasks.alias("__tasks"))
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("__task", F.pmod(F.xxhash64("node"), F.coalesce("__tasks", F.lit(1))).cast("int")).drop("__tasks")
    every = few.withColumn("__task", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > share, tasks).otherwise(1) - 1)))
    return dealt.join(every.hint("merge"), [*keys, "__task"], how).drop("__task")


def similar_pairs(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity is the threshold or more; exact, from the texts.

    Pairs meet their bags by two joins, which Spark splits where a text has many pairs.
    """
    bags = bags_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), rows)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            out = []
            for ea, ca, eb, cb in zip(*(batch.column(k).to_pylist() for k in ("ea", "ca", "eb", "cb")), strict=True):
                if last[0] != ea:
                    last = (ea, (np.frombuffer(ea, U), np.frombuffer(ca, np.int32)))
                out.append(multiset_jaccard(last[1], (np.frombuffer(eb, U), np.frombuffer(cb, np.int32))))
            s = pa.array(out, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), s], ["a", "b", "s"])

    left = bags.select(F.col("node").alias("a"), F.col("elements").alias("ea"), F.col("counts").alias("ca"))
    right = bags.select(F.col("node").alias("b"), F.col("elements").alias("eb"), F.col("counts").alias("cb"))
    scored = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "ea", "ca", "eb", "cb").mapInArrow(compare, "a binary, b binary, s double")
    return scored.filter(F.col("s") >= threshold)


def linking_pairs(nodes: list, roots: list, bags: list[tuple[np.ndarray, np.ndarray]], low: np.ndarray, high: np.ndarray, threshold: float) -> list[tuple]:
    """Links between rows `low` and rows `high` that join two roots: enough of them for the components, not all.

    Overlaps of one row with all others come from postings of its elements, so they cost the elements that rows share.
    """
    parent = {r: r for r in roots}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    at = np.concatenate([np.full(len(bags[j][0]), j) for j in high]) if len(high) else np.zeros(0, np.int64)
    elements = np.concatenate([bags[j][0] for j in high]) if len(high) else np.zeros(0, U)
    counts = np.concatenate([bags[j][1] for j in high]) if len(high) else np.zeros(0, np.int64)
    order = np.argsort(elements, kind="stable")
    elements, at, counts = elements[order], at[order], counts[order]
    total = np.array([b[1].sum() for b in bags])
    out = []
    for i in low:
        e, c = bags[i]
        lo, hi = np.searchsorted(elements, e, "left"), np.searchsorted(elements, e, "right")
        n = hi - lo
        where = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(at[where], np.minimum(counts[where], np.repeat(c, n)), len(bags))
        for j in np.flatnonzero(both >= threshold * (total[i] + total - both) - 1e-9):
            x, y = find(roots[i]), find(roots[j])
            if x != y and both[j] / (total[i] + total[j] - both[j]) >= threshold:
                parent[max(x, y)] = min(x, y)
                out.append((nodes[i], nodes[j]))
    return out


def slot_counts(bags: DataFrame, most_bits: int) -> np.ndarray:
    """How many bags hold an element of each slot (the leading bits of an element).

    Spark adds up and packs 4,096 numbers a row; 2**most_bits numbers at most reach the driver.
    """
    held = bags.agg(F.sum(F.expr("cast(length(elements) / 8 as long)"))).first()[0] or 0
    bits = min(most_bits, max(10, int(4 * held).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << bits, np.int64)
        for b in batches:
            for e in b.column(0).to_pylist():
                np.add.at(n, slots_of(np.frombuffer(e, U), bits), 1)
        for some in np.array_split(np.flatnonzero(n), 16):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["slot", "n"])

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(4096, np.int32)
        n[pdf["slot"].to_numpy() & 4095] = np.minimum(pdf["n"].to_numpy(), np.iinfo(np.int32).max)
        return pd.DataFrame({"page": [key[0]], "counts": [n.tobytes()]})

    added = bags.select("elements").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros((max(1, (1 << bits) >> 12), 4096), np.int32)
    for page, packed in added.groupBy(F.shiftright("slot", 12).alias("page")).applyInPandas(pack, "page long, counts binary").collect():
        counts[page] = np.frombuffer(packed, np.int32)
    return counts.ravel()[: 1 << bits]


def slots_of(elements: np.ndarray, bits: int) -> np.ndarray:
    return (elements >> U(64 - bits)).astype(np.int64)


def rare_elements(elements: np.ndarray, weights: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The first elements of a bag, rarest slots first, and which of them are among its shorter beginning.

    A pair at the threshold overlaps in t of the heavier bag and 2t / (1 + t) of the lighter one. What a beginning leaves
    over is less than that, so the lighter one's shorter beginning and the heavier one's beginning share an element.
    """
    n = counts[slots_of(elements, len(counts).bit_length() - 1)]
    order = np.lexsort((elements, n))
    before = np.cumsum(weights[order]) - weights[order]
    total = weights.sum()
    begins = (before <= total - np.ceil(threshold * total - 1e-9)) & (n[order] > 1)
    shorter = before <= total - np.ceil(2 * threshold / (1 + threshold) * total - 1e-9)
    return elements[order][begins], shorter[begins]


def kin(open_: DataFrame, bags: DataFrame, threshold: float, most_bits: int = 20) -> DataFrame:
    """Spokes (a, b) that join all nodes of a cluster which may be linked across components: those that share a rare element.

    Every node gives the first elements of its bag, rarest first; a cluster's nodes of one element form a star around the
    least that has it in its shorter beginning. Elements of one component alone are left out. Texts that share most of
    their words but are no near duplicates have beginnings of their own, so they fall apart here, at a cost that grows
    with their number. The counts behind the order fill 4 MB at most; where they mix elements up, fewer nodes fall apart.
    """
    sent = bags.sparkSession.sparkContext.broadcast(slot_counts(bags, most_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, found, shorter = [], [np.zeros(0, U)], [np.zeros(0, bool)]
            for node, e, c in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                some, short = rare_elements(np.frombuffer(e, U), np.frombuffer(c, np.int32), sent.value, threshold)
                nodes += [node] * len(some)
                found.append(some)
                shorter.append(short)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(shorter))], ["node", "element", "shorter"])

    begins = bags.select("node", "elements", "counts").mapInArrow(run, "node binary, element long, shorter boolean")
    marks = materialize(begins.join(open_.select("node", "cluster", "root"), "node"), "near-marks")
    stars = marks.groupBy("cluster", "element").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.when(F.col("shorter"), F.col("node"))).alias("leader"), F.count("*").alias("n"))
    stars = materialize(stars.filter("lo <> hi and leader is not null").select("cluster", "element", "leader", "n"), "near-stars")
    return joined_apart(marks, stars, ["cluster", "element"]).filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()


def links_between(open_: DataFrame, bags: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links (a, b) that join components of one cluster; open_: cluster, node, weight, root; bags: at least those of open_.

    A cluster is cut by weight, in steps of 1 / threshold (similar bags are in one step or the next), and a step into parts
    of about `block` nodes. A task takes two parts; two parts of the same single component are left out. Each task sends
    the links that its components need, fewer than its nodes.
    """
    step = F.floor(F.log(F.greatest("weight", F.lit(1)).cast("double")) / F.log(F.lit(1 / threshold))).cast("int")
    stepped = open_.withColumn("step", step)
    sizes = stepped.groupBy("cluster", "step").agg(F.count("*").alias("n"))
    dealt = stepped.join(sizes, ["cluster", "step"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("n") / block)).cast("int")).drop("n")
    dealt = materialize(dealt, "near-dealt")
    parts = dealt.groupBy("cluster", "step", "part").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    other = parts.select(F.col("cluster").alias("c2"), F.col("step").alias("step2"), F.col("part").alias("part2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    near = (F.col("cluster") == F.col("c2")) & F.col("step2").between(F.col("step"), F.col("step") + 1) & ((F.col("step2") > F.col("step")) | (F.col("part2") >= F.col("part")))
    one = (F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("lo2")) & (F.col("lo") == F.col("hi2"))
    tasks = parts.join(other, near & ~one).select("cluster", F.struct("step", "part", "step2", "part2").alias("task"))
    seats = tasks.select("cluster", "task", F.explode(F.array_distinct(F.array(F.struct(F.col("task.step").alias("step"), F.col("task.part").alias("part")), F.struct(F.col("task.step2").alias("step"), F.col("task.part2").alias("part"))))).alias("seat"))
    seats = seats.select("cluster", "task", F.col("seat.step").alias("step"), F.col("seat.part").alias("part"))
    seated = dealt.join(bags, "node").join(seats, ["cluster", "step", "part"]).select("cluster", "task.*", F.col("step").alias("own_step"), F.col("part").alias("own_part"), "node", "root", "elements", "counts")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, s1, p1, s2, p2 = key
        held = [(np.frombuffer(e, U), np.frombuffer(c, np.int32)) for e, c in zip(pdf["elements"], pdf["counts"], strict=True)]
        first = ((pdf["own_step"] == s1) & (pdf["own_part"] == p1)).to_numpy()
        second = ((pdf["own_step"] == s2) & (pdf["own_part"] == p2)).to_numpy()
        nodes, roots = [bytes(x) for x in pdf["node"]], [bytes(x) for x in pdf["root"]]
        found = linking_pairs(nodes, roots, held, np.flatnonzero(first), np.flatnonzero(second), threshold)
        return pd.DataFrame(found, columns=["a", "b"], dtype=object)

    return seated.groupBy("cluster", "step", "part", "step2", "part2").applyInPandas(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its connected component, for all nodes with an edge.

    In a round every node points to the least of itself and its neighbours; pointers jump to their end, and edges between
    trees go on as edges between their roots. Each tree has two nodes at least, so a round leaves half of them at most; a
    star is settled by one. Neighbours' least labels are combined before the shuffle; each step is written down.
    """
    left = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-edges")
    labels = None
    while True:
        both = left.select("a", "b").union(left.select("b", "a")).toDF("node", "other")
        up = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "near-up")
        while True:
            further = up.select(F.col("node").alias("root"), F.col("root").alias("far"))
            jumped = materialize(up.join(further, "root").select("node", "root", "far"), "near-up")
            moved = jumped.filter("root <> far").limit(1).count()
            up = jumped.select("node", F.col("far").alias("root"))
            if not moved:
                break
        if labels is None:
            labels = up
        else:
            further = up.select(F.col("node").alias("root"), F.col("root").alias("far"))
            labels = materialize(labels.join(further, "root", "left").select("node", F.coalesce("far", "root").alias("root")), "near-labels")
        ends = [up.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b")]
        met = left.join(ends[0], "a").join(ends[1], "b").filter("a_root <> b_root")
        left = materialize(met.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "near-edges")
        if not left.limit(1).count():
            return labels


def roots_of(rows: DataFrame, threshold: float, block: int) -> DataFrame:
    """node and root, the least node of its class, for the nodes that have a link; rows: doc_id, text, node."""
    nodes = materialize(signed(rows), "near-nodes")
    banded = nodes.select(F.explode("bands").alias("bucket"), "node")
    leaders = materialize(banded.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1"), "near-leaders")
    shared = materialize(joined_apart(banded, leaders, ["bucket"]), "near-buckets")
    stars = shared.filter(F.col("node") != F.col("leader")).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = materialize(similar_pairs(materialize(stars, "near-stars"), rows, threshold).select("a", "b"), "near-links")
    roots = components(links)

    placed = shared.filter("n > 2").join(roots, "node", "left").select("bucket", "leader", "node", F.coalesce("root", "node").alias("root"))
    split = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    split = materialize(split.select("bucket", "n"), "near-split")
    spokes = materialize(joined_apart(placed, split, ["bucket"], "left_semi").filter(F.col("node") != F.col("leader")).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "near-spokes")
    if spokes.limit(1).count():
        clusters = components(spokes).withColumnRenamed("root", "cluster")
        open_ = clusters.join(nodes.select("node", "weight"), "node").join(roots, "node", "left").select("cluster", "node", "weight", F.coalesce("root", "node").alias("root"))
        open_ = materialize(open_.join(open_.groupBy("cluster").agg(F.count("*").alias("n")), "cluster"), "near-open")
        bags = bags_of(open_.select("node"), rows)
        wide, open_ = open_.filter(F.col("n") > block).drop("n"), open_.filter(F.col("n") <= block).drop("n")
        if wide.limit(1).count():
            spokes = materialize(kin(wide, bags.join(wide.select("node"), "node", "left_semi"), threshold), "near-kin")
            if spokes.limit(1).count():
                closer = components(spokes).withColumnRenamed("root", "cluster")
                open_ = open_.unionByName(wide.drop("cluster").join(closer, "node"))
        more = materialize(links_between(open_, bags, threshold, block), "near-links")
        roots = components(links.unionByName(more))
    return roots


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (least doc_id of its class), class_size: classes of texts linked by similarity `threshold` or more.

    Similarity is the Jaccard similarity of the multisets of five-word shingles. Texts of equal words are one node. Nodes
    that share a band (four registers of 128: a pair at 0.8 shares none of 32 with probability 5e-8) are candidates. In
    a bucket all members are compared with its least one, which settles groups of copies at one comparison a member. Where
    a bucket then still spans several components, its members join a cluster. Clusters of more than `block` members fall
    apart into members that share one of their rarest shingles, as any link must. Clusters are compared in blocks of
    members of like weight, which send only the links that join components. So the classes are those of all candidate
    pairs, and no pair but such a link leaves a task.

    Null or empty text: the words of none, one class. Null doc_ids take part; a class of such rows alone has class_id null.
    Repeated rows: each its own row. An empty table: no rows.
    """
    small_batches(docs.sparkSession)
    rows = texts(docs, id_col, text_col).withColumn("node", bag_node())
    members = materialize(rows.select("doc_id", "node"), "near-members")
    placed = members.join(roots_of(rows, threshold, block), "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    classes = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return placed.join(classes, "root").select("doc_id", "class_id", "class_size")


def least_of_classes(docs: DataFrame, threshold: float = THRESHOLD, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text_key of the least row of each class of near_duplicates(), by doc_id (null last), then text_key."""
    small_batches(docs.sparkSession)
    rows = texts(docs, id_col, text_col).withColumn("node", bag_node())
    members = materialize(rows.select("doc_id", text_key().alias("text_key"), "node"), "near-members")
    placed = members.join(roots_of(rows, threshold, block), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least"))
    return least.select("least.doc_id", "least.text_key")
