"""A training corpus from raw documents: five stages, each written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, mixing, near_duplicates, quality, secret_scan
from cairn.llm.queries import tokenizer
from cairn.session import materialize, table



def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__key", F.xxhash64(F.coalesce("text", F.lit(""))))


def again(docs: DataFrame, decided: DataFrame, how: str = "left_semi") -> DataFrame:
    """The documents with their decision (doc_id, __key, ...)."""
    decided = decided.withColumnRenamed("doc_id", "__id").withColumnRenamed("__key", "__key2")
    return keyed(docs).join(decided, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__key2")), how).drop("__key", "__key2", "__id")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: a null text is scored as the empty one, of an id each text apart."""
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    rejected = scored.filter("predicted = 0").select("doc_id", F.col("text_key").alias("__key")).distinct()
    return again(docs, rejected, "left_anti")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of least doc_id (null last) and text key; of repeated rows, one."""
    kept = near_duplicates.least_of_classes(docs).withColumnRenamed("text_key", "__key")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = keyed(again(docs, kept)).groupBy("doc_id", "__key").agg(F.min(F.struct(*others, "text")).alias("__row"))
    return one.select("doc_id", "__row.*").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with secrets masked, and n_chars of the masked text."""
    masked = secret_scan.redact_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else masked


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: none, once or more. Ids may repeat: a decision goes by the whole row."""
    named = docs.withColumn("__row", F.concat_ws(":", "doc_id", F.xxhash64(*[x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))])))
    taken = mixing.mix_sources(named, id_col="__row").groupBy(F.col("doc_id").alias("__row")).agg(F.sum("copies").cast("int").alias("copies")).filter("copies > 0")
    # Equal rows are one row here, with the copies of all of them.
    return named.dropDuplicates(["__row"]).join(taken, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that the ids decode to; a null text has none and decodes to the empty one."""
    return bpe.encode_documents(docs, *tokenizer())


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", keep_distinct),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix),
    ("bpe_encoding", encode),
]
#: Fits, signatures and balanced samples have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
