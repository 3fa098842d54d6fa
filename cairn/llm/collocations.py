"""Mining of collocations with position bitmaps of words: shift, AND and popcount, summed over shards."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import key_bitmap, small_batches, small_side
from cairn.session import discard, materialize

#: Positions that one container of a bitmap holds.
BITS = 16
LONGEST = 4
#: Bytes of text that are turned into bitmaps at once, and containers that are extended at once.
PIECE = 1 << 21
AT_ONCE = 1 << 17
#: A byte that UTF-8 never has stands for the end of a piece.
END = b"\xff"
LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + END * 10)


def word_streams(langs: list[str], texts: list[str], piece: int = PIECE) -> Iterator[tuple[str, list[bytes], int]]:
    """(lang, words with END between pieces, words that the part before it has too), a few MB at a time.

    A part begins with the last words of the one before it, so that phrases across the cut are seen.
    """
    by_lang: dict[str, list[bytes]] = {}
    for lang, t in zip(langs, texts, strict=True):
        by_lang.setdefault(lang, []).append(t.encode().translate(LETTERS))
    for lang, raws in by_lang.items():
        raw, at, carry = END.join(raws), 0, []
        while at < len(raw):
            cut = at + piece
            if cut < len(raw):
                cut = max(raw.rfind(b" ", at, cut), raw.rfind(END, at, cut)) + 1 or min(x for x in (raw.find(b" ", cut), raw.find(END, cut), len(raw)) if x >= 0)
            words = carry + raw[at:cut].replace(END, b" " + END + b" ").split()
            yield lang, words, len(carry)
            at, carry = cut, words[-(LONGEST - 1) :]


class Bitmaps:
    """Compressed position bitmaps of words: containers (word, block, bits), those without a bit left out, found by block."""

    def __init__(self, words: np.ndarray):
        """words: a number for each position, -1 where no bitmap is wanted (rare words, ends of pieces)."""
        at = np.flatnonzero(words >= 0)
        self.blocks = len(words) // BITS + 2
        code = words[at].astype(np.int64) * self.blocks + at // BITS
        order = np.argsort(code, kind="stable")
        head = heads(code[order])
        bit = (np.uint32(1) << (at % BITS).astype(np.uint32))[order]
        self.bits = np.bitwise_or.reduceat(bit, head) if len(head) else bit
        self.word, self.block = np.divmod(code[order][head], self.blocks)
        self.by_block = np.argsort(self.block, kind="stable")
        self.first = np.searchsorted(self.block[self.by_block], np.arange(self.blocks + 2))

    def extended(self, node: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Phrases with each word that follows: (node, word, block, bits of the last words), some containers at a time.

        A bitmap is shifted by one position, the bit that leaves a block goes to the next one, and ANDed with the bitmaps of
        the words that the block has. Positions without a word stop it: no phrase crosses the end of a piece.
        """
        for a in range(0, len(node), AT_ONCE):
            n_, b_, x_ = node[a : a + AT_ONCE], block[a : a + AT_ONCE], bits[a : a + AT_ONCE]
            up = np.concatenate([x_ << np.uint32(1) & np.uint32((1 << BITS) - 1), x_ >> np.uint32(BITS - 1)])
            some = np.flatnonzero(up)
            up, n_, b_ = up[some], np.concatenate([n_, n_])[some], np.concatenate([b_, b_ + 1])[some]
            count = self.first[b_ + 1] - self.first[b_]
            row = np.repeat(np.arange(len(b_)), count)
            other = self.by_block[np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + self.first[b_][row]]
            both = up[row] & self.bits[other]
            hit = np.flatnonzero(both)
            row = row[hit]
            yield n_[row], self.word[other[hit]], b_[row], both[hit]


def heads(ordered: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1]) if len(ordered) else np.zeros(0, np.int64)


def grouped(node: np.ndarray, word: np.ndarray, block: np.ndarray, bits: np.ndarray, width: int, carried: int) -> tuple[np.ndarray, ...]:
    """(parent, word, popcount) of each phrase, and its containers with the phrase's number: phrase, block, bits.

    The first `carried` positions were counted in the part before.
    """
    code = node.astype(np.int64) * width + word
    order = np.argsort(code, kind="stable")
    code, block, bits = code[order], block[order], bits[order]
    head = heads(code)
    own = np.where(block == 0, bits & ~np.uint32((1 << carried) - 1), bits)
    count = np.add.reduceat(np.bitwise_count(own).astype(np.int64), head) if len(head) else head
    phrase = np.repeat(np.arange(len(head)), np.diff(np.concatenate([head, [len(code)]])))
    return code[head] // width, code[head] % width, count, phrase, block, bits


def names_of(lang: str, words: list[bytes]) -> np.ndarray:
    """Spark's xxhash64(lang, word) of each word."""
    from xxhash import xxh64_intdigest

    seed = xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_names(phrase: Column, lang: Column | str = "lang") -> Column:
    """Of a pair of words, the hash of the first XOR half the hash of the second; see `phrase_counts`."""
    first, second = (F.xxhash64(lang, F.split(phrase, " ")[k]) for k in (0, 1))
    return first.bitwiseXOR(F.shiftrightunsigned(second, 1))


def phrase_counts(lang: str, words: list[bytes], carried: int, known_words, known_pairs=None) -> tuple[list[bytes], np.ndarray]:
    """Phrases of one part and their counts: pairs of known words, or, given the known pairs, phrases of three words up."""
    number: dict[bytes, int] = {}
    stream = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lexicon = list(number)
    names = names_of(lang, lexicon)
    good = known_words(names.view(np.int64)) if lexicon else np.zeros(0, bool)
    if END in number:
        good[number[END]] = False
    maps = Bitmaps(np.where(good[stream], stream, -1) if len(stream) else stream)
    width = len(lexicon) + 1
    parts = list(maps.extended(maps.word, maps.block, maps.bits))
    if not parts:
        return [], np.zeros(0, np.int64)
    first, second, count, phrase, block, bits = grouped(*(np.concatenate(c) for c in zip(*parts, strict=True)), width, carried)
    if known_pairs is None:
        return [lexicon[a] + b" " + lexicon[b] for a, b in zip(first.tolist(), second.tolist(), strict=True)], count
    sound = known_pairs((names[first] ^ (names[second] >> np.uint64(1))).view(np.int64))
    number_of_pair = np.cumsum(sound) - 1
    first, second = first[sound], second[sound]
    names_of_pairs = [lexicon[a] + b" " + lexicon[b] for a, b in zip(first.tolist(), second.tolist(), strict=True)]
    pairs = first * width + second  # in order, as phrases come ordered by their code
    out: list[bytes] = []
    counts = []
    keep = np.flatnonzero(sound[phrase])
    step = max(AT_ONCE // 8, 1)
    for a in range(0, len(keep), step):  # depth first: one group of pairs down to its longest phrases, then the next
        some = keep[a : a + step]
        node, last, text, blk, x = number_of_pair[phrase[some]], second, names_of_pairs, block[some], bits[some]
        for _ in range(LONGEST - 2):
            kids = [k for k in maps.extended(node, blk, x) if len(k[0])]
            if not kids:
                break
            n_, w_, b_, x_ = (np.concatenate(c) for c in zip(*kids, strict=True))
            code = last[n_] * width + w_
            at = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
            ok = np.flatnonzero(pairs[at] == code)
            parent, last, count, node, blk, x = grouped(n_[ok], w_[ok], b_[ok], x_[ok], width, carried)
            text = [text[p] + b" " + lexicon[w] for p, w in zip(parent.tolist(), last.tolist(), strict=True)]
            out += text
            counts.append(count)
    return out, np.concatenate(counts) if counts else np.zeros(0, np.int64)


def counted(rows: DataFrame, count) -> DataFrame:
    """lang, phrase, f: what `count` finds in each part, summed over all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, words, carried in word_streams(b.column(0).to_pylist(), b.column(1).to_pylist()):
                phrases, n = count(lang, words, carried)
                for a in range(0, len(phrases), 1 << 16):
                    some = phrases[a : a + (1 << 16)]
                    number = np.asarray(n[a : a + (1 << 16)], np.int64)
                    hit = np.flatnonzero(number)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit)), pa.array([some[k] for k in hit.tolist()], pa.binary()).cast(pa.string()), pa.array(number[hit])], ["lang", "phrase", "f"])

    return rows.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def words_alone(lang: str, words: list[bytes], carried: int) -> tuple[list[bytes], list[int]]:
    n = Counter(words[carried:])
    n.pop(END, None)
    return list(n), list(n.values())


def exact(column: Column | str) -> Column:
    return F.col(column).cast("decimal(20,0)") if isinstance(column, str) else column.cast("decimal(20,0)")


def scored(phrases: DataFrame, parts: DataFrame) -> DataFrame:
    """lang, phrase, f, with l, r and score of the lowest-scoring cut (of equals, that after fewest words)."""
    words = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", "f", F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select("*", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(words, F.col("k") + 1, F.size(words)), " ").alias("right"))
    for side in ("left", "right"):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(side[0])), ["lang", side])
    score = F.expr("cast(2000000 as decimal(10,0)) * cast(f as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.groupBy("lang", "phrase", "f").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "f", "cut.l", "cut.r", "cut.score")


def inner_phrases(phrases: DataFrame) -> DataFrame:
    """lang, phrase, most: for each shorter phrase within another, the largest count of those around it."""
    words = F.split("phrase", " ")
    sizes = F.sequence(F.lit(2), F.size(words) - 1)
    within = phrases.filter(F.size(words) > 2).select("lang", "f", words.alias("w"), F.explode(sizes).alias("size"))
    within = within.select("lang", "f", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    return within.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("f").alias("most"))


def mine_phrases(docs: DataFrame, least: int = 30, share: int = 80, top: int | None = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Collocations of 2 to 4 words with `least` occurrences or more, by lang; see the columns below.

    A part of the texts is a shard: each frequent word has a compressed bitmap of its positions, a phrase's bitmap is
    shifted by one and ANDed with a word's, its popcount is the shard's count. Shards are summed by Spark. Three passes:
    words; pairs of words that are frequent; phrases of three and four words, depth first from the frequent pairs, as long
    as each pair in them is frequent (all parts of a frequent phrase are). Frequent words and pairs reach the shards as
    bitmaps of hashes of 8 MB at most, which let others pass but lose none; the sums decide.

    Columns: lang (null: `und`), rank (score, then a descending, then phrase), phrase, a (count), l and r (counts of the two
    sides of the lowest-scoring cut), n (words of the lang), score = floor(2000000 a / (l + r)), in exact arithmetic. Phrases inside
    longer ones with `share` % of their count or more are left out. Null and empty texts hold no words; repeated rows count
    each; an empty table gives no rows. top=None gives all phrases. Other columns, whatever their names, stay behind.
    """
    small_batches(docs.sparkSession, "4m")
    rows = docs.select(F.coalesce(docs[lang_col], F.lit("und")).alias("lang"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    every = materialize(counted(rows, words_alone), "phrase-words")
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    name = F.xxhash64("lang", "phrase")
    often = F.col("f") >= least
    words = every.filter(often)
    known_words = key_bitmap(words.select(name))
    pairs = materialize(counted(rows, lambda *part: phrase_counts(*part, known_words)).filter(often), "phrase-pairs")
    known_pairs = key_bitmap(pairs.select(pair_names(F.col("phrase"))))
    longer = materialize(counted(rows, lambda *part: phrase_counts(*part, known_words, known_pairs)).filter(often), "phrase-longer")
    phrases = pairs.unionByName(longer)
    best = scored(phrases, words.unionByName(phrases)).join(inner_phrases(longer), ["lang", "phrase"], "left")
    kept = best.filter(~F.coalesce(100 * exact("most") >= share * exact("f"), F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
    langs = totals.count()
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)  # Spark keeps the best `top` of each task before the shuffle
    ranked = ranked.withColumn("rank", F.col("rank").cast("long"))
    out = materialize(ranked.join(small_side(totals, langs), "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score"), "phrase-ranked")
    discard(every, pairs, longer)
    return out
