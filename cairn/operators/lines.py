"""Byte offsets to lines and columns, by an as-of join of line starts and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_table(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, line (from 1) and start (bytes) of every line; a line begins after each LF. Null content has no lines."""
    body = F.posexplode(F.split(F.col(content).cast("string"), "\n", -1)).alias("pos", "body")
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("body") + 1).over(before), F.lit(0)).cast("int")
    return files.select(*keys, body).select(*keys, (F.col("pos") + 1).cast("int").alias("line"), start.alias("start"))


def located(rows: DataFrame, lines: DataFrame, keys: list[str], offset: Column, prefix: str = "") -> DataFrame:
    """rows with <prefix>line and <prefix>column (bytes, from 0) of an offset: the last line that starts at it or before.

    Line starts and offsets are merged in one order, and a window carries the last start on: n log n in the rows of a file.
    """
    item = F.struct("line", "start")
    starts = lines.select(*keys, F.col("start").cast("bigint").alias("__at"), F.lit(0).alias("__side"), item.alias("__line"), F.lit(None).cast(rows.select(F.struct("*").alias("r")).schema["r"].dataType).alias("__row"))
    asks = rows.select(*keys, offset.cast("bigint").alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(starts.schema["__line"].dataType).alias("__line"), F.struct("*").alias("__row"))
    order = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = starts.unionByName(asks).withColumn("__found", F.last("__line", ignorenulls=True).over(order)).filter("__side = 1")
    return found.select("__row.*", F.col("__found.line").alias(f"{prefix}line"), (F.col("__at") - F.col("__found.start")).cast("int").alias(f"{prefix}column"))


def with_locations(rows: DataFrame, lines: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """rows with start_line, start_column, end_line and end_column of their ranges."""
    return located(located(rows, lines, keys, F.col(start), "start_"), lines, keys, F.col(end), "end_")


def wrong_locations(rows: DataFrame, files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Rows (start, end and the four columns of with_locations) whose lines or columns aren't those of their offsets."""
    names = ("start_line", "start_column", "end_line", "end_column")
    held = rows.select("*", *[F.col(c).alias(f"__{c}") for c in names]).drop(*names)
    again = with_locations(held, line_table(files, keys, content), keys)
    wrong = F.lit(False)
    for c in names:
        wrong = wrong | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return again.filter(wrong).select(*[F.col(f"__{c}").alias(c) if c in names else F.col(c) for c in rows.columns])
