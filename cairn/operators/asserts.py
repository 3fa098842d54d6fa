"""Contract checks as queries: each gives the rows that break a rule, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.paths import is_safe_path
from cairn.functions.text import byte_slice, content_hash
from cairn.operators.lines import line_table, with_locations, wrong_locations


class ContractViolated(Exception):
    pass


def require_none(violations: DataFrame, rule: str) -> None:
    """Fail with the rule's name and one example if there is any violation."""
    worst = violations.limit(1).collect()
    if worst:
        raise ContractViolated(f"{rule}: {worst[0].asDict()}")


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("times")).filter("times > 1")


def unsafe_paths(files: DataFrame, path: str = "relative_path") -> DataFrame:
    return files.filter(~is_safe_path(F.col(path)))


def overlapping(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Ranges that begin before the one before them ends."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    return ranges.withColumn("before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).filter("start < before")


def out_of_order(rows: DataFrame, by: list[str], position: str, key: str) -> DataFrame:
    """Rows whose key isn't above that of the row before them, by position."""
    order = Window.partitionBy(*by).orderBy(position)
    return rows.withColumn("before", F.lag(key).over(order)).filter(F.col(key) <= F.col("before"))


def wrong_slices(chunks: DataFrame, files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Chunks whose content or hash isn't what their range of the file gives."""
    source = files.select(*keys, F.col(content).alias("__source"))
    data = byte_slice(F.col("__source"), F.col("start"), F.col("end"))
    good = (data == F.col("content").cast("binary")) & (content_hash(data) == F.col("content_hash"))
    return chunks.join(source, keys, "left").filter(~F.coalesce(good, F.lit(False))).drop("__source")


def wrong_chunks(chunks: DataFrame, files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Chunks whose content, hash, or line and column of either end isn't what their range of the file gives."""
    return wrong_slices(chunks, files, keys, content).unionByName(wrong_locations(chunks, files, keys, content)).distinct()


#: The rules that a file's chunks must keep, by name.
CHUNK_RULES = ("repeated_id", "unsafe_path", "overlap", "wrong_slice", "wrong_location")


def judged(chunks: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """chunks with `broken`, the names of the rules that each breaks: every rule in one pass over the rows."""
    names = ("start_line", "start_column", "end_line", "end_column")
    held = chunks.select("*", *[F.col(c).alias(f"__{c}") for c in names]).drop(*names)
    rows = with_locations(held, line_table(files, keys), keys).join(files.select(*keys, F.col("content").alias("__source")), keys, "left")
    data = byte_slice(F.col("__source"), F.col("start"), F.col("end"))
    moved = F.lit(False)
    for c in names:
        moved = moved | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    before = F.max("end").over(Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    good = (data == F.col("content").cast("binary")) & (content_hash(data) == F.col("content_hash"))
    tests = {
        "repeated_id": F.count("*").over(Window.partitionBy("chunk_id")) > 1,
        "unsafe_path": ~is_safe_path(F.col("relative_path")),
        "overlap": F.col("start") < before,
        "wrong_slice": ~F.coalesce(good, F.lit(False)),
        "wrong_location": moved,
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(tests[r], F.lit(False)), r) for r in CHUNK_RULES]))
    return rows.withColumn("broken", broken).select(*[F.col(f"__{c}").alias(c) if c in names else F.col(c) for c in chunks.columns], "broken")


def rule_counts(rows: DataFrame) -> DataFrame:
    """rule, violations and one example (chunk_id) of judged() rows; a row for every rule, in one aggregate."""
    per = [F.struct(F.lit(r).alias("rule"), F.count_if(F.array_contains("broken", r)).alias("violations"), F.min(F.when(F.array_contains("broken", r), F.col("chunk_id"))).alias("example")) for r in CHUNK_RULES]
    return rows.agg(F.array(*per).alias("r")).select(F.inline("r"))


def stale(files: DataFrame, parsed: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Files whose bytes are no longer those that were parsed."""
    return files.join(parsed.select(*keys, "source_sha256"), keys).filter(content_hash(F.col(content)) != F.col("source_sha256")).select(*keys)


def wrong_counters(summary: DataFrame, total: str, parts: list[str]) -> DataFrame:
    """Summary rows whose parts don't add up to the total."""
    added = F.lit(0)
    for p in parts:
        added = added + F.col(p)
    return summary.filter(F.col(total) != added)
