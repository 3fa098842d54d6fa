"""Each operator against a brute-force version over the hard cases, and over no rows."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import bpe, fingerprints, licenses, mixing, near_duplicates, quality, queries, repeats, secret_scan, sharding, topk
from tests.llm import cases

sha = lambda s: hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()
key = lambda r: tuple((v is None, v) for v in r)


@pytest.fixture(scope="module")
def docs(spark):
    return cases.table(spark).persist()


@pytest.fixture(scope="module")
def texts():
    return [(r[0], r[1] or "") for r in cases.rows()]


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


# 1

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return out + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]


def test_secrets(docs, texts):
    rows = secret_scan.secret_spans(docs).collect()
    same([(r["doc_id"], *sorted((s["kind"], s["start"], s["end"]) for s in r["secrets"] if not s["kind"].startswith("entropy"))) for r in rows], [(i, *sorted(base_spans(t))) for i, t in texts])
    found = [t for (_, t) in texts if "aB3dE5fG7" in t][0]
    kinds = [(k, found[a:b]) for k, a, b, _ in secret_scan.find_secrets(found) if k.startswith("entropy")]
    assert kinds == [("entropy_base64", "aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1vW3")]


@pytest.mark.parametrize("seed", range(20))
def test_entropy_windows(seed):
    rng = random.Random(seed)
    s, w, least = "".join(rng.choice("abcdef0123"[: rng.randint(2, 10)]) for _ in range(rng.randint(1, 90))), rng.randint(2, 30), rng.uniform(0.5, 3)
    n = min(w, len(s))
    bits = [-sum(c / n * math.log2(c / n) for c in Counter(s[i : i + n]).values()) for i in range(len(s) - n + 1)]
    covered = {j for i, b in enumerate(bits) if b >= least - 1e-9 for j in range(i, i + n)}
    runs = secret_scan.windows_over(s, w, least)
    assert covered == {j for a, b, _ in runs for j in range(a, b)}
    assert all(x[2] == pytest.approx(max(bits[x[0] : x[1] - n + 1])) for x in runs)


def test_redaction(docs):
    rows = secret_scan.redact_secrets(docs)
    assert rows.columns == docs.columns
    got = {r["text"] for r in rows.collect()}
    assert "[SECRET]\" token:abc [SECRET] [SECRET]" in got and None in got and not any("hunter2hunter2" in (t or "") for t in got)


def test_placeholders_hide_only_their_windows():
    rng = random.Random(4)
    draw = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWabcdefghijklmnopqrstuvw0123456789+/") for _ in range(n))
    key = draw(40)
    spans = lambda t: [(a, b) for k, a, b, _ in secret_scan.find_secrets(t) if k == "entropy_base64"]
    path = f"config/sample/{key}"
    (span,) = spans(path)
    assert span[0] >= len("config/sample") and span[1] == len(path) and span[0] <= len("config/sample/")
    assert key not in secret_scan.redact(f"see {path} for it")
    long = draw(3000) + "XxXx" + draw(3000)
    hidden = set(range(len(long))) - {k for a, b in spans(long) for k in range(a, b)}
    assert set(range(3000, 3004)) <= hidden and len(hidden) < 0.02 * len(long)
    assert spans(f"a1B2c3-example-{draw(12)}") == [] and spans("your-key-dummy-xxxxxxxxxxxxxxxxxxxxxxxxx1") == []


# 2


def test_licenses(docs, texts):
    phrases = [(label, p.split()) for label, p in licenses.BASE]
    want = []
    for i, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = [(k, label) for label, p in phrases for k in range(len(w)) if w[k : k + len(p)] == p]
        ks = [k for k, _ in at]
        want.append((i, len(w), len(at), min(ks, default=None), max(ks, default=None), ",".join(sorted({x for _, x in at}))))
    rows = licenses.license_scan(docs).collect()
    same([tuple(r)[:6] for r in rows], want)
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in rows)
    inserted = [k for k, t in texts if t.startswith("Permission is hereby")][0]
    assert [r["labels"] for r in rows if r["doc_id"] == inserted] == ["mit"]  # two words are inserted: neighbouring diagonals are merged


def test_license_spans_are_verified(spark):
    whole = dict((label, text) for label, text, *_ in reversed(licenses.NOTICES))
    sentence = next(n[1] for n in licenses.NOTICES if n[1].endswith("documentation files"))
    grams = licenses.grams_of(sentence)
    gpl = next(n[1] for n in licenses.NOTICES if n[0] == "gpl")
    rows = [
        (1, " filler ".join(grams), ""),  # all k-grams, three of four words apart: no span of the template's length
        (2, " ".join(reversed(grams)), ""),
        (3, " filler ".join([" ".join(licenses.words_of(sentence)[:8]), " ".join(licenses.words_of(sentence)[8:])]), "mit"),
        (4, gpl, "gpl"), (5, gpl.replace("GNU General", "GNU Lesser General"), "lgpl"), (6, gpl.replace("GNU General", "GNU Affero General"), "agpl"),
        (7, "x y " + whole["bsd"] + " z", "bsd"), (8, whole["zlib"] + " and " + whole["isc"], "isc,zlib"),
        (9, "under the m\u0130t license \u212a UNDER THE MIT LICENSE", "mit"), (10, "licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "cc-by-nc"),
    ]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, x string")).collect()}
    assert {i: r["labels"] for i, r in got.items()} == {i: want for i, _, want in rows}
    assert (got[9]["n_base"], got[9]["first_word"], got[9]["n_words"]) == (1, 5, 9) and got[1]["score"] < 0.3 and got[7]["score"] == 1


# 3


def test_quality(spark):
    def text(k):
        t = cases.prose(k, 40 + k % 60)
        return t if k % 3 else [" ".join(w + "***" for w in t.split()), (t[:30] + " ") * 20, t.upper() + "!!"][k % 9 // 3]

    rows = [(k, text(k)) for k in range(600)]
    docs = spark.createDataFrame([*rows, (None, None), (3, ""), (3, rows[3][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(600)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    scored = quality.score_quality(docs, labels).collect()
    assert len(scored) == 603 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == cases.held_out(r["doc_id"]) for r in scored)
    right = [r["predicted"] == int(r["doc_id"] % 3 > 0) for r in scored if r["held_out"]]
    assert len(right) > 150 and np.mean(right) > 0.95
    flipped = labels.withColumn("quality", F.when(quality.is_held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    same([tuple(r) for r in quality.score_quality(docs, flipped).collect()], [tuple(r) for r in scored])  # held-out labels don't matter


def test_quality_of_few_labels_and_the_bound(spark):
    rows = [(k, cases.prose(k, 30) if k % 2 else "x! " * (k + 9)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = lambda ids: spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, quality int")
    right = lambda scored: np.mean([r["predicted"] == r["doc_id"] % 2 for r in scored.collect()])
    assert right(quality.score_quality(docs, labels(range(5)), all_labels=True)) > 0.9
    assert right(quality.score_quality(docs, labels(range(60)), all_labels=True, max_rows=20)) > 0.9


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r["score"], r["predicted"]) for r in quality.score_quality(docs, none).collect()} == {(0.5, 1)}


@pytest.mark.parametrize("seed", range(5))
def test_isotonic(seed):
    rng = np.random.default_rng(seed)
    n, p = rng.integers(1, 9, 12).astype(float), None
    p = rng.uniform(0, 1, 12) * n
    fit = quality.isotonic(n, p)
    y = p / n
    minmax = [max(min((n[a : b + 1] @ y[a : b + 1]) / n[a : b + 1].sum() for b in range(k, 12)) for a in range(k + 1)) for k in range(12)]
    assert fit == pytest.approx(minmax)


# 4


def targets_of(sizes):
    w = [[5.0, 2.0, 1.0][i % 3] for i in range(len(sizes))]
    target, left, open_ = [0.0] * len(sizes), 1.5 * sum(sizes), [i for i, n in enumerate(sizes) if n]
    while open_:
        unit = left / sum(w[i] for i in open_)
        full = [i for i in open_ if w[i] * unit > 2 * sizes[i]]
        for i in full or open_:
            target[i] = 2.0 * sizes[i] if full else w[i] * unit
            left -= target[i]
        open_ = [i for i in open_ if i not in full] if full else []
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100], [], [0, 0], [1000, 10, 500, 1000, 3], [1, 10**6, 5, 0, 70, 8, 9000, 2, 2, 2]])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(enumerate(sizes)), "sid long, n long")
    got = [r["target"] for r in mixing.source_targets(df).orderBy("sid").collect()]
    assert got == pytest.approx(targets_of(sizes))


def test_mixing_of_hot_and_repeated_rows(spark):
    """A third of the rows under a null id, one row many times, and more sources than are sent to all tasks."""
    rng = random.Random(6)
    rows = [(None if k % 3 == 0 else k, " ".join(["w"] * rng.randint(1, 40)), f"s{k % 2}") for k in range(600)] + [(7, "a b c", "s1")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, block_rows=32).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    want = targets_of([size["s0"], size["s1"]])
    for n, t in zip([size["s0"], size["s1"]], want):
        assert sum(r["taken"] for r in got if r["source_size"] == n) == pytest.approx(t, rel=0.01)
    assert len(got) == 900 and {r["taken"] for r in got if r["doc_id"] == 7 and r["size"] == 3} <= {0, 3, 6}
    many = spark.range(3000).select("id", F.lit("a b").alias("text"), F.concat(F.lit("s"), "id").alias("source")).withColumnRenamed("id", "doc_id")
    assert mixing.mix_sources(many).agg(F.sum("taken")).first()[0] == pytest.approx(1.5 * 6000, rel=0.4)


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    pi, size = rng.uniform(0, 1, 500), rng.integers(0, 900, 500).astype(float)
    out = mixing.flight(pi, size, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out @ size == pytest.approx(pi @ size) and out.sum() == pytest.approx(pi.sum())


@pytest.mark.parametrize("block", [2048, 8])
def test_mixing(docs, texts, block):
    rows = mixing.mix_sources(docs, block_rows=block).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    same([(r["doc_id"], r["size"]) for r in rows], [(i, words(t)) for i, t in texts])
    sizes, largest = defaultdict(int), defaultdict(int)
    for r in cases.rows():
        sizes[r[3]] += words(r[1] or "")
        largest[r[3]] = max(largest[r[3]], words(r[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = targets_of([sizes[s] for s in names])
    taken, got = Counter(), {}
    for r in rows:
        taken[r["source_size"]] += r["taken"]
        got[r["source_size"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s, t in zip(names, targets):
        assert got[sizes[s]] == pytest.approx(t) and abs(taken[sizes[s]] - t) <= max(0.005 * t, largest[s] / 2)
    same([tuple(r) for r in mixing.mix_sources(docs.repartition(3), block_rows=block).collect()], [tuple(r) for r in rows])


# 5


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe(docs, texts, library):
    want = []
    for i, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    path, pattern = queries.tokenizer()
    same([tuple(r) for r in bpe.encode_documents(docs, path, pattern, digests=True).collect()], want)
    full = bpe.encode_documents(docs, path, pattern, lexicon_words=[" the", "x"]).collect()
    same([(r["doc_id"], r["n_tokens"], sha(",".join(map(str, r["ids"]))), sha(r["decoded"])) for r in full], want)


def test_frequent_words(spark):
    docs = spark.createDataFrame([("b a, a",), ("b a a, c\nd",), (None,), ("",)], "text string")
    pattern = queries.tokenizer()[1]
    assert bpe.frequent_words(docs, pattern, 2) == [" a", ",", "a"] and bpe.frequent_words(docs, pattern) == [" a", " b", " c", " d", ",", "a", "b", "c", "d"]


@pytest.mark.parametrize("seed", range(3))
def test_bpe_of_white_space(library, seed):
    """Blanks, runs of white space and line ends in all orders: pieces between blanks are encoded apart only where that is right."""
    rng = random.Random(seed)
    codec = bpe.Codec(bpe.Vocabulary(*queries.tokenizer()), bpe.Lexicon(bpe.build_lexicon(bpe.Vocabulary(*queries.tokenizer()), [" ab"])))
    parts = [" ", " ", " ", "\n", "\t", "\u3000", "\x1c", "\x85", "ab", "c", "7", "'s", "'", "!", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    assert [codec.encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_words(library):
    import public_tokenizers

    v = bpe.Vocabulary(*queries.tokenizer())
    rng = random.Random(1)
    words = ["".join(rng.choice("abtheinougé日🎉 \n1!") for _ in range(rng.randint(1, 150))) for _ in range(200)] + ["a" * 5000, "ab" * 2000]
    codec = bpe.Codec(v, bpe.Lexicon(bpe.build_lexicon(v, [" the", " and", "é"])), recent=50)
    assert [codec.encode(w) for w in words] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    assert public_tokenizers.PATTERN == v.pattern


def test_automaton():
    words = {w.encode(): (k, k + 1) for k, w in enumerate(["tops", "tap", "taps", "top", "stops", "stop", "a"])}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    assert all(lexicon.get(w) == ids for w, ids in words.items())
    assert all(lexicon.get(w) is None for w in (b"", b"t", b"ta", b"topss", b"b", b"stopsx"))
    tails = {w[i:] for w in words for i in range(len(w) + 1)}
    rights = {frozenset(t[len(p) :] for t in words if t.startswith(p)) for p in {w[:i] for w in words for i in range(len(w) + 1)}}
    assert lexicon.n == len(rights) and tails  # minimal: a state for each set of continuations
    assert bpe.Lexicon(bpe.compile_lexicon({})).get(b"x") is None


# 6


def bag(t):
    w = t.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute_classes(texts):
    bags, root = [bag(t) for _, t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = sum((bags[a] & bags[b]).values())
        if both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
            root[max(find(a), find(b))] = min(find(a), find(b))
    members = defaultdict(list)
    for k in range(len(texts)):
        members[find(k)].append(k)
    out = []
    for k, (i, _) in enumerate(texts):
        m = members[find(k)]
        out.append((i, min((texts[x][0] for x in m if texts[x][0] is not None), default=None), len(m)))
    return out


def test_near_duplicates(docs, texts):
    rows = near_duplicates.near_duplicates(docs).collect()
    same([tuple(r) for r in rows], brute_classes(texts))


def test_near_duplicates_chain(spark):
    """A chain of edits and a group of copies: links that no common leader has are still found."""
    chain = [cases.prose(9, 200)]
    for k in range(12):
        chain.append(cases.edited(chain[-1], k, 3))
    rows = list(enumerate(chain + [cases.prose(10, 100)] * 40 + [cases.edited(cases.prose(10, 100), k, 1) for k in range(40)]))
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same([tuple(r) for r in got], brute_classes(rows))


def test_rare_elements_keep_all_links():
    rng = np.random.default_rng(5)
    base = np.sort(rng.integers(0, 1 << 63, 60).astype(np.uint64) * np.uint64(2))
    bags = []
    for _ in range(120):
        own = rng.integers(0, 1 << 63, 8).astype(np.uint64)
        e = np.unique(np.concatenate([rng.choice(base, rng.integers(40, 60), replace=False), own[: rng.integers(0, 8)]]))
        bags.append((e, rng.integers(1, 4, len(e)) if rng.random() < 0.3 else np.ones(len(e), np.int64)))
    for bits in (1, 6, 12):  # counts that mix all, some and few elements up
        counts = np.bincount(np.concatenate([near_duplicates.slots_of(e, bits) for e, _ in bags]), minlength=1 << bits)
        begins = [near_duplicates.rare_elements(e, w, counts, 0.8) for e, w in bags]
        linked = 0
        for (x, (a, sa)), (y, (b, sb)) in itertools.combinations(zip(bags, begins), 2):
            if near_duplicates.multiset_jaccard(x, y) >= 0.8:
                linked += 1
                light, heavy = (a[sa], b) if x[1].sum() <= y[1].sum() else (b[sb], a)
                assert np.intersect1d(light, heavy).size
        assert linked > 20


def test_alike_texts_fall_apart(spark):
    """Texts that share three quarters of their words: a bucket holds many, none is a near duplicate but the planted pairs."""
    def text(k):
        words = [f"shared{i}" for i in range(300)] + [f"own{k}x{i}" for i in range(45)]
        return " ".join(words)

    rows = [(k, text(k)) for k in range(400)] + [(1000 + k, text(k) + " end") for k in range(0, 400, 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicates(df, block=16).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}
    nodes = df.withColumn("node", near_duplicates.bag_node())
    bags = near_duplicates.bags_of(nodes, nodes)
    open_ = nodes.select(F.lit(b"c").alias("cluster"), "node", F.lit(341).cast("long").alias("weight"), F.col("node").alias("root"))
    assert near_duplicates.kin(open_, bags, 0.8).count() == 8


def test_joined_apart_equals_the_join(spark):
    many = spark.range(3000).selectExpr("id", "case when id % 3 > 0 then id % 200 else -1 end as k", "cast(cast(id as string) as binary) as node")
    few = many.groupBy("k").agg(F.min("id").alias("v"), F.count("*").alias("n")).filter("n > 2 and k % 5 <> 0")
    for how in ("inner", "left_semi"):
        want = many.join(few, "k", how).collect()
        for least in (1, 7, 5000):
            assert Counter(near_duplicates.joined_apart(many, few, ["k"], how, least).collect()) == Counter(want)
    assert near_duplicates.joined_apart(many, few.limit(0), ["k"]).count() == 0


def test_bag_signature_is_unbiased():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**63, 300).astype(np.uint64)
    a = rng.integers(0, 7, 300)
    b = np.where(rng.random(300) < 0.6, a, rng.integers(0, 20, 300))
    sign = lambda w: near_duplicates.bag_signature(e[w > 0], w[w > 0], 4096)
    assert (sign(a) == sign(b)).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


# 7


def test_fingerprints(docs, texts):
    rows = fingerprints.fingerprint_documents(docs).collect()
    assert len(rows) == len(texts)
    # Rows of one id are ordered by a hash of their text: follow the result's own order among them.
    order = sorted(range(len(texts)), key=lambda k: (texts[k][0] is None, -(texts[k][0] or 0)))
    by_id = defaultdict(list)
    for k in order:
        by_id[texts[k][0]].append(texts[k][1])
    groups = [list(g) for _, g in itertools.groupby([texts[k][0] for k in order])]
    nexts = {g[0]: set(by_id[g[0]]) | set(by_id[groups[(x + 1) % len(groups)][0]]) for x, g in enumerate(groups)}
    for r in rows:
        possible = {(len(t), sha(t[: len(t) - len(t) // 2] + n[: len(t) // 2])) for t in by_id[r["doc_id"]] for n in nexts[r["doc_id"]]}
        assert (r["n_chars"], r["edited_sha256"]) in possible
    single = {i: by_id[i][0] for i in by_id if len(by_id[i]) == 1}
    prints = {}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["doc_id"] in single:
            assert prints.setdefault(single[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    wide = [r for r in rows if r["n_chars"] > 100]
    assert np.mean([r["near_edited"] for r in wide]) > np.mean([r["near_next"] for r in wide]) + 0.1


def test_fingerprint_collisions(spark):
    """Collision rates are the generalised Jaccard similarity of the weights 1 + ln(count)."""
    a = cases.prose(20, 400)
    b = cases.edited(a, 5, 120)
    weights = lambda t: {w: 1 + math.log(c) for w, c in Counter(t.split()).items()}
    x, y = weights(a), weights(b)
    true = sum(min(x.get(w, 0), y.get(w, 0)) for w in x | y) / sum(max(x.get(w, 0), y.get(w, 0)) for w in x | y)
    rows = spark.createDataFrame([(1, a), (2, b)], "bucket int, text string")
    s = [r["signature"] for r in fingerprints.signatures(rows, ["bucket"], "text", 96).orderBy("bucket").collect()]
    assert np.mean([p == q for p, q in zip(*s)]) == pytest.approx(true, abs=0.17)


def test_likeness_at_the_querys_own_samples(spark):
    """near_next and near_edited against the exact generalised Jaccard similarity, with the number of samples that op7 takes."""
    texts = []
    for k in range(40):
        texts += [cases.prose(200 + k, 150), cases.edited(cases.prose(200 + k, 150), k, 30 + 2 * k)]
    weights = lambda t: {w: 1 + math.log(c) for w, c in Counter(t.split()).items()}

    def exact(a, b):
        x, y = weights(a), weights(b)
        return sum(min(x.get(w, 0), y.get(w, 0)) for w in x | y) / sum(max(x.get(w, 0), y.get(w, 0)) for w in x | y)

    rows = fingerprints.fingerprint_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    off = []
    for r in rows:
        own, after, half = texts[r["doc_id"]], texts[r["doc_id"] - 1], len(texts[r["doc_id"]]) // 2
        if r["doc_id"] % 2:
            off.append(r["near_next"] - exact(own, after))
        off.append(r["near_edited"] - exact(own, own[: len(own) - half] + after[:half]))
    assert len(off) == 120 and np.sqrt(np.mean(np.square(off))) < 0.08 and max(map(abs, off)) < 0.25 and abs(np.mean(off)) < 0.02


def test_single_document(spark):
    (r,) = fingerprints.fingerprint_documents(spark.createDataFrame([(4, "a b c d")], "doc_id long, text string")).collect()
    assert r["edited_sha256"] == sha("a b a b"[:4] + "a b") and r["near_next"] == 1


# 8


def brute_topk(rows, held=lambda s: s):
    f32 = lambda x: float(np.float32(x))
    good = [(i, [math.floor(64 * f32(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(f32(x)) for x in v)]
    want = []
    for q, a in {i: v for i, v in good if i % 20 == 0}.items():
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:20]
        want += [(q, k + 1, i, held(-s)) for k, (s, i) in enumerate(best)]
    return want


def test_topk(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 0.13) for _ in range(16)]) for k in range(400)]
    rows += [(400, None), (401, [float("nan")] * 16), (402, [None] * 16), (404, [float("inf")] * 16), (405, []), (440, rows[3][1]), (441, rows[3][1]), (20, rows[20][1]), (None, rows[1][1]), (443, rows[0][1][:9])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, shard int, v string")
    want = brute_topk(rows)
    same([tuple(r) for r in topk.exact_topk(df).collect()], want)
    same([tuple(r) for r in topk.exact_topk(df, shard_rows=30, group_queries=5, query_block=3).collect()], want)
    assert topk.exact_topk(df.limit(0)).collect() == []


@pytest.mark.parametrize("scale, least", [([0.1, 3e4, 1e5], 2**53), ([0.1, 3e5, 5e6, 2e7], 2**62), ([0.1, 1e9, 1e30], 2**63 - 1)])
def test_topk_of_large_components(spark, scale, least):
    """Scores in double, in 64 bits, in Python's integers, and beyond a long."""
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) * scale[k // 7 % len(scale)] for _ in range(768)]) for k in range(150)]
    rows += [(160, [3e6] + [0.0] * 767), (161, [5e6] + [0.0] * 767), (180, [1.0] + [0.0] * 767), (181, [scale[-1]] * 768), (182, [scale[-1]] * 768)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_topk(rows, lambda s: max(-(2**63), min(2**63 - 1, s)))
    assert any(abs(w[3]) >= least for w in want)
    same([tuple(r) for r in topk.exact_topk(df).collect()], want)
    same([tuple(r) for r in topk.exact_topk(df, shard_rows=40).collect()], want)


# 9


def brute_repeats(texts, n=200):
    raws = [t.encode() for _, t in texts]
    count = Counter(r[p : p + n] for r in raws for p in range(len(r) - n + 1))
    out = []
    for (i, _), r in zip(texts, raws):
        hit = np.zeros(len(r) + 1, bool)
        for p in range(len(r) - n + 1):
            if count[r[p : p + n]] > 1:
                hit[p : p + n] = True
        kept = bytes(b for b, h in zip(r, hit) if not h)
        out.append((i, len(r), int(hit.sum()), int((hit[1:] < hit[:-1]).sum()), sha(kept)))
    return out


def test_repeats(docs, texts):
    want = brute_repeats(texts)
    assert 0 < sum(w[2] for w in want) < sum(w[1] for w in want)
    same([tuple(r) for r in repeats.remove_repeats(docs).collect()], want)
    same([tuple(r) for r in repeats.remove_repeats(docs, batches=3).collect()], want)


@pytest.mark.parametrize("seed", range(2))
def test_repeats_at_edges(spark, seed):
    """Matches of all lengths about 200, two-sided, in several contexts, over several batches."""
    rng = random.Random(seed)
    draw = lambda n: "".join(rng.choice("abcdefgh ij") for _ in range(n))
    common = [draw(700) for _ in range(3)]
    texts = []
    for k in range(120):
        c = rng.choice(common)
        a = rng.randrange(0, 400)
        texts.append((k, draw(rng.randrange(0, 150)) + c[a : a + rng.choice([90, 150, 199, 200, 201, 219, 220, 260, 300])] + draw(rng.randrange(0, 150))))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for batches in ((1, 7), (4,))[seed % 2]:
        same([tuple(r) for r in repeats.remove_repeats(df, batches=batches).collect()], brute_repeats(texts))


def test_equal_rows_are_not_quadratic(spark):
    text = cases.prose(31, 3000)
    df = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    began = time.time()
    assert {tuple(r) for r in repeats.remove_repeats(df).collect()} == {(None, len(text.encode()), len(text.encode()), 1, sha(""))}
    assert time.time() - began < 20


def test_long_texts_are_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 500)
    texts = [(1, cases.prose(32, 900)), (2, cases.prose(33, 50) + cases.prose(32, 900)[1000:2600])]
    same([tuple(r) for r in repeats.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()], brute_repeats(texts))


def test_merge_scan(spark):
    """One order, equal suffixes as one, and the longest common prefix with a neighbour."""
    a, b = [(1, 5, 1, False), (1, 7, 1, False), (4, 4, 1, False), (9, 1, 2, False)], [(1, 7, 1, True), (2, 2, 1, True), (9, 3, 1, True)]
    schema = "key long, ctx long, n int, fresh boolean"
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    rows = [tuple(r) for r in repeats.merge_scan([spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)]).collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    g = repeats.GRAM  # the ends of a range count as if a neighbour shared the block
    assert rows == [(1, 5, 1, False, g), (1, 7, 2, True, 200), (2, 2, 1, True, 0), (4, 4, 1, False, 0), (9, 1, 2, False, 200), (9, 3, 1, True, g)]


@pytest.mark.parametrize("seed", range(4))
def test_suffix_samples(seed):
    rng = np.random.default_rng(seed)
    raw = rng.integers(97, 99 if seed % 2 else 120, 3000).astype(np.uint8)
    raw[1000:1600] = raw[100:700]
    text, name, first, wins, key_ = repeats.suffix_samples(raw, np.array([0, 1500]), np.array([1500, 3000]))
    where = {}
    for t, s, f, n in zip(text, name, first, wins):
        for p in range(f, f + n):
            assert (0, 1500)[t] <= p and p + 200 <= (1500, 3000)[t] and p <= s <= p + 200 - repeats.GRAM
            where[p] = s - p
    assert set(where) == {*range(1301), *range(1500, 2801)}
    offsets = defaultdict(set)
    for p, o in where.items():
        offsets[raw[p : p + 200].tobytes()].add(o)
    assert all(len(o) == 1 for o in offsets.values())  # equal windows name suffixes at equal offsets


def test_rolling():
    raw = np.frombuffer(b"abcabcabcd" * 50, np.uint8)
    for n in (1, 3, 8, 32, 200):
        h = repeats.rolling(raw, n)
        seen = {}
        assert len(h) == len(raw) - n + 1 and all(seen.setdefault(raw[i : i + n].tobytes(), x) == x for i, x in enumerate(h)) and len(set(h.tolist())) == len(seen)


# 10


def test_shards(docs, texts, tmp_path):
    rows = sharding.hilbert_shards(docs).collect()
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in rows], [(i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts])
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in rows)
    some = docs.filter("doc_id > 27").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source")
    sharding.write_shards(some, sharding.hilbert_shards(some, 4), str(tmp_path / "out"))
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == some.count() and {r[0] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


@pytest.mark.parametrize("names", [[*(f"src{k}" for k in range(20)), "hot"], [f"common/prefix/{k:02}" for k in range(20)]])
def test_shards_cover_few_sources(spark, names):
    rng = random.Random(8)
    # Texts differ, as equal ones go together whatever their source.
    rows = [(k, f"{k} " + "x" * int(math.exp(rng.uniform(3, 7))), rng.choice(["en", "de", "fr", None]), rng.choice(names)) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    steps = sharding.hilbert_order(df.select("source"), ["source"]).groupBy("curve").agg(F.countDistinct("source").alias("n")).collect()
    assert [r["n"] for r in steps] == [1] * len(names)  # each source has its own step
    source, held = {r[0]: r[3] for r in rows}, defaultdict(set)
    for r in sharding.hilbert_shards(df).collect():
        held[r["shard"]].add(source[r["doc_id"]])
    assert len(held) == 40 and np.mean([len(s) for s in held.values()]) < 0.5 * len(names)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 200])
def test_cuts_are_halved(spark, n):
    cuts = [f"{3 * k:04}" for k in range(n)]
    rows = spark.createDataFrame([(f"{k:04}",) for k in range(620)], "key string").select("key", fingerprints.range_of(cuts, F.col("key")).alias("r"))
    assert all(r["r"] == sum(c <= r["key"] for c in cuts) for r in rows.collect())


def test_equal_texts_are_one_run(spark):
    """Copies of any lang, source and id: one run of slots, in one shard or in neighbours."""
    rng = random.Random(10)
    texts = ["copy %d " % k * (k + 1) for k in range(30)] + [None, ""]
    rows = [(rng.randrange(900), rng.choice(texts) if k % 2 else f"text {k}", rng.choice(["en", "de", None]), rng.choice("abcdef")) for k in range(1500)]
    rows += [(5, "hot", "en", "a")] * 700
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = sorted(((r["shard"], r["slot"], r["size"], r["text_crc32"]) for r in sharding.hilbert_shards(df).collect()))
    runs = [k for k, _ in itertools.groupby(r[2:] for r in got)]
    assert len(runs) == len(set(runs)) and len(got) == len(rows)


def test_many_strings_have_steps_of_their_own(spark):
    df = spark.createDataFrame([(f"source-{k % 1000:04}" if k % 7 else None,) for k in range(3000)], "source string")
    got = sharding.hilbert_order(df, ["source"]).distinct().collect()
    assert len({r["curve"] for r in got}) == len(got) == len({r["source"] for r in got}) == 1001
    assert [r["source"] for r in sorted(got, key=lambda r: r["curve"])] == [None, *(f"source-{k:04}" for k in range(1000))]


@pytest.mark.parametrize("n, bits", [(2, 4), (3, 2), (3, 3)])
def test_hilbert(n, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=n)))
    index = sharding.hilbert_index([points[:, k] for k in range(n)], bits)
    assert sorted(index) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(1) == 1).all()


# no rows


@pytest.mark.parametrize(
    "operator",
    [
        secret_scan.secret_spans, licenses.license_scan, lambda d: quality.score_quality(d, d.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")), mixing.mix_sources,
        lambda d: bpe.encode_documents(d, *queries.tokenizer()), near_duplicates.near_duplicates, fingerprints.fingerprint_documents, repeats.remove_repeats, sharding.hilbert_shards,
    ],
)
def test_no_rows(spark, operator):
    assert operator(cases.empty(spark)).collect() == []
