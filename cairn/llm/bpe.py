"""Byte-level BPE encoding and decoding with a transducer lexicon."""

from __future__ import annotations

import gc
import hashlib
import itertools
import json
import mmap
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import small_batches, texts


NEVER = 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, the others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = itertools.count(0x100)
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


def by_length(words: list[bytes], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, bytes padded to a matrix, lengths) of the words of up to `most` bytes, in groups of like length."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    at = 0
    for width in (4, 6, 8, 10, 12, 16, 24, 32, 64, 128, 256):
        some = np.flatnonzero((at < length) & (length <= min(width, most)))
        if len(some):
            raw = b"".join([words[k].ljust(width, b"\0") for k in some.tolist()])
            yield some, np.frombuffer(raw, np.uint8).reshape(-1, width), length[some]
        at = width


class Vocabulary:
    """Ids, merges and added tokens of a tokenizer file, as bytes."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda s: bytes(back[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.bits = max(self.ids.values()).bit_length()
        #: Left id and right id, packed, to the rank and the merged id, packed.
        self.merges = {self.ids[raw(a)] << self.bits | self.ids[raw(b)]: rank << self.bits | self.ids[raw(a) + raw(b)] for rank, (a, b) in enumerate(pairs)}
        #: The same as sorted arrays.
        self.pairs = np.array(sorted(self.merges), np.int64)
        self.merged = np.array([self.merges[p] for p in self.pairs.tolist()], np.int64)
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.bytes = {i: t for t, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.pattern = pattern

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << self.bits | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[at] == pair) & (left >= 0) & (right >= 0), self.merged[at], NEVER)

    def merge_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """merge() of many words at once: each step merges the first best pair of every word that has one."""
        out: list = [None] * len(words)
        for some, raw, length in by_length(words, 64):
            n, width = raw.shape
            ids = np.where(np.arange(width) < length[:, None], np.array(self.single)[raw], -1)
            ranks = np.concatenate([self.ranks(ids[:, :-1], ids[:, 1:]), np.full((n, 1), NEVER)], 1)
            place, at = np.arange(width), np.arange(n)
            done = np.full((n, width), -1)
            while len(at):
                j = ranks.argmin(1)
                rows = np.arange(len(at))
                best = ranks[rows, j]
                end = best == NEVER
                done[at[end]] = ids[end]
                at, j, best, ids, ranks = at[~end], j[~end], best[~end], ids[~end], ranks[~end]
                rows = np.arange(len(at))
                ids[rows, j] = best & ((1 << self.bits) - 1)
                ids = np.take_along_axis(ids, np.minimum(place + (place > j[:, None]), width - 1), 1)
                ids[:, -1] = -1
                ranks = np.take_along_axis(ranks, np.minimum(place + (place >= j[:, None]), width - 1), 1)
                ranks[:, -1] = NEVER
                ranks[rows, j] = self.ranks(ids[rows, j], ids[rows, np.minimum(j + 1, width - 1)])
                inner = np.flatnonzero(j)
                ranks[inner, j[inner] - 1] = self.ranks(ids[inner, j[inner] - 1], ids[inner, j[inner]])
            size = (done >= 0).sum(1)
            for k, i, m in zip(some.tolist(), done.tolist(), size.tolist(), strict=True):
                out[k] = tuple(i[:m])
        return [self.merge(w) if i is None else i for w, i in zip(words, out, strict=True)]

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of a word: the leftmost pair of lowest rank merges, until no pair has a rank."""
        ids = list(map(self.single.__getitem__, word))
        get, bits, mask = self.merges.get, self.bits, (1 << self.bits) - 1
        if len(ids) > 100:
            return self._merge_long(ids)
        ranks = [get(a << bits | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            new = ids[i] = best & mask
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << bits | new, NEVER)
            if i < len(ranks):
                ranks[i] = get(new << bits | ids[i + 1], NEVER)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same over a heap of pairs, in n log n, for very long words."""
        import heapq

        n, merges, bits = len(ids), self.merges, self.bits
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(merges[p], i, p) for i, p in enumerate(a << bits | b for a, b in zip(ids, ids[1:], strict=False)) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] << bits | ids[j] != pair:
                continue
            ids[i], alive[j], after[i] = merges[pair] & (1 << bits) - 1, False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else -1
                if y >= 0 and (p := ids[x] << bits | ids[y]) in merges:
                    heapq.heappush(heap, (merges[p], x, p))
        return tuple(x for x, a in zip(ids, alive, strict=True) if a)


class Builder:
    """Minimal acyclic transducer of sorted words (Daciuk et al. 2000); the output of a word is its row in a list of ids.

    A transition carries how many words lie before it under its state, so the sum along a path is the word's rank: outputs
    stay out of the states, and equal suffixes share them whatever their words' ids.
    """

    def __init__(self):
        self.states: list[tuple[bool, list[tuple[int, int]]]] = []
        self.register: dict = {}

    def freeze(self, node) -> int:
        key = (node[0], tuple(node[1]))
        if key not in self.register:
            self.register[key] = len(self.states)
            self.states.append(key)
        return self.register[key]

    def build(self, words: list[bytes]) -> int:
        path = [[False, []]]  # nodes along the last word, each final flag and transitions
        last = b""
        for w in words:
            same = len(os.path.commonprefix([last, w]))
            self.fold(path, last, same)
            path += [[False, []] for _ in w[same:]]
            path[-1][0] = True
            last = w
        self.fold(path, last, 0)
        return self.freeze(path[0])

    def fold(self, path, word: bytes, to: int) -> None:
        while len(path) - 1 > to:
            node = path.pop()
            path[-1][1].append((word[len(path) - 1], self.freeze(node)))


def compile_lexicon(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """The automaton and the ids as one block of 64-bit little-endian numbers, to be memory-mapped.

    Layout: count of states, root, words, transitions; then, of the transitions in the order of (state, byte), 256 * state + byte,
    the words before and the target; each state's final flag; where each word's ids start (and one past); ids.
    """
    order = sorted(w for w in words if w)
    b = Builder()
    root = b.build(order)
    below: list[int] = []
    for final, arcs in b.states:  # targets are frozen before their parents
        below.append(int(final) + sum(below[t] for _, t in arcs))
    keys, before, targets = [], [], []
    for state, (final, arcs) in enumerate(b.states):
        seen = int(final)
        for byte, t in arcs:
            keys.append(256 * state + byte)
            before.append(seen)
            targets.append(t)
            seen += below[t]
    at, ids = [0], []
    for w in order:
        ids += words[w]
        at.append(len(ids))
    numbers = [len(b.states), root, len(order), len(keys), *keys, *before, *targets, *(int(f) for f, _ in b.states), *at, *ids]
    return np.array(numbers, "<i8").tobytes()


class Lexicon:
    """Lookup in a memory-mapped automaton."""

    def __init__(self, block: bytes):
        with tempfile.NamedTemporaryFile() as f:  # its pages stay mapped after the name has gone
            f.write(block)
            f.flush()
            numbers = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), "<i8")
        self.n, self.root, self.words, arcs = numbers[:4].tolist()
        self.keys, self.before, self.target, self.final, self.at, self.ids = np.split(numbers[4:], np.cumsum([arcs, arcs, arcs, self.n, self.words + 1]))

    def get_many(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        """The ids of each word, None for those that the automaton doesn't know; a step follows one byte of every word."""
        out: list = [None] * len(words)
        for some, raw, length in by_length(words, 256) if len(self.keys) else ():
            state, rank, alive = np.full(len(some), self.root), np.zeros(len(some), np.int64), np.arange(len(some))
            for pos in range(raw.shape[1]):
                alive = alive[length[alive] > pos]
                key = 256 * state[alive] + raw[alive, pos]
                arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                known = self.keys[arc] == key
                state[alive[~known]] = -1
                alive, arc = alive[known], arc[known]
                rank[alive] += self.before[arc]
                state[alive] = self.target[arc]
            for k in np.flatnonzero((state >= 0) & (self.final[state] == 1)):
                out[some[k]] = tuple(self.ids[self.at[rank[k]] : self.at[rank[k] + 1]].tolist())
        return out

    def get(self, word: bytes) -> tuple[int, ...] | None:
        return self.get_many([word])[0]


class Codec:
    """Encoding and decoding of one worker: lexicon first, exact merges for the rest, recent words remembered."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, recent: int = 1 << 18):
        self.v, self.lexicon, self.recent = vocabulary, lexicon, recent
        self.split = regex.compile(vocabulary.pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) or r"(?!)")
        self.memo: dict[str, tuple[int, ...]] = {}
        self.text_of_id = {i: str(i) for i in vocabulary.bytes}
        self.asked = self.found = 0

    def learn(self, words: Iterable[str]) -> None:
        """Put the ids of all words into the memo: the distinct new ones are looked up, and the rest merged, at once."""
        new = list(set(words) - self.memo.keys())
        if len(self.memo) + len(new) > self.recent:
            self.memo.clear()
            new = list(set(words))
        raw = [w.encode() for w in new]
        ids = self.lexicon.get_many(raw)
        unseen = [k for k, i in enumerate(ids) if i is None]
        self.asked, self.found = self.asked + len(ids), self.found + len(ids) - len(unseen)
        for k, i in zip(unseen, self.v.merge_many([raw[k] for k in unseen]), strict=True):
            ids[k] = i
        self.memo.update(zip(new, ids, strict=True))

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        parts = [self.parts(t) for t in texts]  # of each text, words and between them added tokens, as numbers
        words = [p for ps in parts for p in ps if isinstance(p, list)]
        self.learn(list(itertools.chain.from_iterable(words)))
        known = self.memo.__getitem__
        return [list(itertools.chain.from_iterable(itertools.chain.from_iterable(map(known, p)) if isinstance(p, list) else (p,) for p in ps)) for ps in parts]

    def parts(self, text: str) -> list:
        out: list = []
        at = 0
        for m in self.special.finditer(text):
            out += [self.split(text[at : m.start()]), self.v.special[m[0]]]
            at = m.end()
        return [*out, self.split(text[at:] if at else text)]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.v.bytes.__getitem__, ids)).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, pattern: str, most: int = 50_000, text_col: str = "text") -> list[str]:
    """Words of the `most` most frequent pieces between blanks and line ends of the whole table, counted by Spark; ties by code point.

    Pieces are combined before they are shuffled. The tokenizer's own pattern splits a piece, with and without a blank before
    it, into words.
    """
    pieces = docs.select(F.explode(F.split(F.coalesce(docs[text_col], F.lit("")), "[ \n]")).alias("piece"))
    top = pieces.filter("length(piece) between 1 and 64").groupBy("piece").count().orderBy(F.desc("count"), "piece").limit(most)
    split = regex.compile(pattern).findall
    return sorted({w for r in top.collect() for blank in ("", " ") for w in split(blank + r["piece"])})


def build_lexicon(vocabulary: Vocabulary, words: Iterable[str]) -> bytes:
    """Automaton of the given words that are one word under the pattern, with their ids."""
    split = regex.compile(vocabulary.pattern).findall
    raw = [w.encode() for w in words if split(w) == [w]]
    return compile_lexicon(dict(zip(raw, vocabulary.merge_many(raw), strict=True)))


def encode_documents(docs: DataFrame, tokenizer_path: str, pattern: str, lexicon_words: list[str] | None = None, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text and the text decoded from them; one row in, one row out.

    lexicon_words: the words of the automaton (bounded by the caller); None: the frequent ones of docs. Columns: doc_id,
    n_tokens, then ids and decoded, or with digests=True their sha256 (ids in decimal, joined by commas). Null or empty
    text: no ids. The string of an added token in a text is that token. Words of any length are merged exactly. Repeated rows:
    each its own row. An empty table: no rows.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    vocabulary = Vocabulary(tokenizer_path, pattern)
    words = frequent_words(docs, pattern, text_col=text_col) if lexicon_words is None else lexicon_words
    sent = spark.sparkContext.broadcast((vocabulary, build_lexicon(vocabulary, words)))  # bounded by the vocabulary and the word list

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, block = sent.value
        codec = Codec(v, Lexicon(block))
        gc.disable()  # millions of words and no cycles: the collector would only search them
        name = codec.text_of_id.__getitem__
        try:
            for batch in batches:
                ns, ids_out, texts_out = [], [], []
                for ids in codec.encode_many(batch.column(1).to_pylist()):
                    back = codec.decode(ids)
                    ns.append(len(ids))
                    ids_out.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest() if digests else ids)
                    texts_out.append(hashlib.sha256(back.encode()).hexdigest() if digests else back)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ns, pa.int64()), pa.array(ids_out, pa.string() if digests else pa.list_(pa.int32())), pa.array(texts_out, pa.string())],
                    ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))],
                )
        finally:
            gc.enable()

    rows = texts(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    out = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, {out}")
