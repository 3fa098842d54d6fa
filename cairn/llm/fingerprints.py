"""Document fingerprints by consistent weighted sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import texts
from cairn.session import materialize

SAMPLES = 48


def place_key() -> Column:
    """A string whose order is that of the documents: descending doc_id, null last, then a hash of the text."""
    digits = lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    return F.concat(F.when(F.col("doc_id").isNull(), "1").otherwise("0"), digits(F.bitwise_not(doc_id)), digits(F.col("text_hash")))


def range_of(cuts: list[str], key: Column) -> Column:
    """How many of the ordered cuts are at the key or before it, by halving: as many comparisons as the logarithm of the cuts."""
    if not cuts:
        return F.lit(0)
    known = F.lit(cuts)
    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"), key.alias("key"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        behind = (acc["low"] < acc["high"]) & (F.get(known, middle) <= acc["key"])
        return F.struct(F.when(behind, middle + 1).otherwise(acc["low"]).alias("low"), F.when(behind | (acc["low"] >= acc["high"]), acc["high"]).otherwise(middle).alias("high"), acc["key"].alias("key"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), start, halve, lambda acc: acc["low"])


def next_documents(rows: DataFrame, parts: int) -> DataFrame:
    """rows with `bucket`, `place` and `next_text`: the text of the next row by descending doc_id; after the last, the first.

    The rows' keys (narrow) are sorted by ranges; the first key of each range is a cut, so a bucket is a run of rows, also of
    those that share a null or frequent id. A row finds its bucket by halving the cuts, and a bucket is a task. The first row of a bucket is also
    sent, as a ghost, to the bucket before it, so that a window inside each bucket sees the next row. One shuffle of the texts.
    """
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    keys = materialize(rows.select(place_key().alias("key")), "fingerprint-keys")
    ranges = keys.repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("range")).agg(F.min("key").alias("key"))
    cuts = sorted(r["key"] for r in ranges.collect())  # one for each range partition
    many = max(len(cuts), 1)
    seat = lambda b, ghost: F.struct(b.cast("int").alias("bucket"), F.lit(ghost).alias("ghost"))
    dealt = rows.withColumn("key", place_key()).withColumn("upto", range_of(cuts, F.col("key")))
    own, before = F.col("upto") - 1, F.pmod(F.col("upto") - 2, F.lit(many))
    first = F.get(F.lit(cuts) if cuts else F.array().cast("array<string>"), own) == F.col("key")
    dealt = dealt.withColumn("b", F.explode(F.when(first, F.array(seat(own, False), seat(before, True))).otherwise(F.array(seat(own, False)))))
    order = Window.partitionBy("bucket").orderBy("ghost", "key", "doc_id")  # all columns, so that both uses read one shuffle
    dealt = dealt.select("doc_id", "text", "key", "b.bucket", "b.ghost").repartitionById(many, F.col("bucket"))
    return dealt.select("*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"))


def uniform(hash_: Column, shift: int, bits: int) -> Column:
    """A number in (0, 1) from some bits of a hash."""
    return (F.shiftrightunsigned(hash_, shift).bitwiseAND((1 << bits) - 1).cast("double") + 0.5) / float(1 << bits)


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """Sample k of a weighted term, packed: the rank -log of its priority above, what identifies (term, level) below.

    Ioffe's consistent weighted sampling: with r and c of Gamma(2, 1) and b uniform, all three given by (term, k) alone, the
    level is t = floor(ln w / r + b) and the least of ln c - r (t - b) - r wins. Two texts agree in a sample with probability
    the generalised Jaccard similarity of their weights.
    """
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.log(uniform(one, 0, 21) * uniform(one, 21, 21))
    log_c = F.log(-F.log(uniform(two, 0, 31) * uniform(two, 31, 31)))
    b = uniform(one, 42, 22)
    t = F.floor(log_weight / r + b)
    # Within (-60, 5) by the ranges of the draws: a rank of 31 bits.
    rank = F.floor((log_c - r * (t - b + 1.0) + 128.0) * float(1 << 23))
    return F.shiftleft(rank, 32).bitwiseOR(one.bitwiseXOR(t * F.lit(2654435761)).bitwiseAND(0xFFFFFFFF))


def signatures(rows: DataFrame, keys: list[str], text_col: str, samples: int) -> DataFrame:
    """keys and `signature`, an array of `samples` longs. Terms are the words between white space, weighted 1 + ln(count).

    The keys hold the partition column of rows, so that counting and sampling need no further shuffle; they are few and
    narrow, as the counts hold them once a term.
    """
    words = rows.select(*keys, F.explode(F.split(text_col, r"\s+")).alias("word")).select(*keys, F.xxhash64("word").alias("term"))
    terms = words.groupBy(*keys, "term").agg(F.log1p(F.log(F.count("*").cast("double"))).alias("log_weight"))
    least = terms.groupBy(*keys).agg(*[F.min(sample(F.col("term"), F.col("log_weight"), k)).alias(f"s{k}") for k in range(samples)])
    return least.select(*keys, F.array(*[F.col(f"s{k}") for k in range(samples)]).alias("signature"))


def likeness(a: Column, b: Column, samples: int) -> Column:
    return (F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / float(samples)).cast("double")


def fingerprint_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda s: F.lpad(F.lower(F.hex(s.bitwiseAND(0xFFFFFFFF))), 8, "0")), "")


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they are.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next document's text. Texts are
    dealt once, by ranges of doc_id; everything after that (next document, words, counts, samples) keeps this partitioning.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null text: empty. A text
    without words has the empty word as its one term, so empty texts are alike. Equal texts have equal fingerprints. A
    single document is its own next. Repeated rows and ids: each row has its own place, those of one id by a hash of the text;
    an empty table: no rows.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # a task counts the terms of all its texts at once
    half = "cast(floor(length(text) / 2) as int)"
    placed = next_documents(rows, parts).withColumn(
        "edited", F.expr(f"concat(substring(text, 1, length(text) - {half}), substring(coalesce(next_text, ''), 1, {half}))")
    )
    # Two steps a place: its text, then its edited text; so the next document's text is two steps on.
    both = placed.select("bucket", F.posexplode(F.array("text", "edited")).alias("which", "text"), "place").select("bucket", (2 * F.col("place") + F.col("which")).alias("step"), "text")
    order = Window.partitionBy("bucket").orderBy("step")
    signed = (
        signatures(both, ["bucket", "step"], "text", samples)
        .select("bucket", "step", F.col("signature").alias("own"), F.lead("signature", 1).over(order).alias("of_edited"), F.lead("signature", 2).over(order).alias("of_next"))
        .filter("step % 2 = 0")
        .select(
            "bucket",
            F.expr("cast(step div 2 as int)").alias("place"),
            fingerprint_text(F.col("own")).alias("fingerprint"),
            fingerprint_text(F.col("of_edited")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("of_edited"), samples).alias("near_edited"),
            likeness(F.col("own"), F.col("of_next"), samples).alias("near_next"),
        )
    )
    # The same shuffle of the texts serves both sides; ghosts have no row here.
    known = placed.filter(~F.col("ghost")).select("bucket", "place", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    return known.join(signed, ["bucket", "place"]).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
