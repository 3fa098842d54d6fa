"""Intervals of a file: containment, residual gaps, unsafe ranges and first-wins duplicates, as windows and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_end(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Adds max_end, the largest end of the intervals up to each, by (start, longest first)."""
    order = Window.partitionBy(*by).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    return intervals.withColumn("max_end", F.max("end").over(order))


def ancestors(intervals: DataFrame, by: list[str], key: str, items: list[str], holds: str | None = None, nearest: bool = False) -> DataFrame:
    """Adds above: structs of `items` of all intervals that hold this one, outermost first; with nearest, of the innermost alone.

    Intervals of one file are nested or apart, and key names each. Starts and ends are put in one order, in which running sums
    of what opens and closes give a row's depth; its holder at each level above is the last row before it that opened there.
    Of equal ranges the one of least key holds the others. Empty ranges, and rows for which `holds` is false, hold nothing.
    """
    holding = (F.col("start") < F.col("end")) & (F.col(holds) if holds else F.lit(True))
    opens = F.struct(F.col("start").alias("at"), F.lit(1).alias("side"), (-F.col("end")).alias("to"), holding.cast("int").alias("step"))
    shuts = F.struct(F.col("end").alias("at"), F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("to"), F.lit(-1).alias("step"))
    events = intervals.withColumn("__e", F.explode(F.when(holding, F.array(opens, shuts)).otherwise(F.array(opens))))
    order = [F.col("__e.at"), F.col("__e.side"), F.col("__e.to"), F.col("__e.step").desc(), F.col(key)]
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("__depth", F.coalesce(F.sum("__e.step").over(before), F.lit(0)).cast("int")).filter("__e.side = 1")
    lowest = F.greatest(F.lit(0), F.col("__depth") - 1) if nearest else F.lit(0)
    asks = F.when(F.col("__depth") > 0, F.transform(F.sequence(lowest, F.greatest(F.lit(0), F.col("__depth") - 1)), lambda x: F.struct(x.alias("level"), F.lit(False).alias("own")))).otherwise(F.array().cast("array<struct<level:int,own:boolean>>"))
    rows = rows.withColumn("__r", F.explode(F.concat(asks, F.array(F.struct(F.col("__depth").alias("level"), F.lit(True).alias("own"))))))
    level = Window.partitionBy(*by, "__r.level").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    item = F.struct(*items)
    rows = rows.withColumn("__held", F.last(F.when(F.col("__r.own") & (F.col("__e.step") == 1), item), ignorenulls=True).over(level))
    listed = F.array_sort(F.collect_list(F.when(~F.col("__r.own"), F.struct(F.col("__r.level").alias("level"), F.col("__held").alias("item")))))
    above = rows.groupBy(*by, key).agg(F.transform(listed, lambda x: x["item"]).alias("above"))
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"i.{c}"))
    on = same(key)
    for c in by:
        on = on & same(c)
    return intervals.alias("i").join(above.alias("a"), on).select("i.*", "a.above")


def containment_parents(intervals: DataFrame, by: list[str], key: str = "id", label: str | None = None) -> DataFrame:
    """Adds parent: the key of the smallest interval that holds this one; null for roots. With a label column also `path`, the
    labels of all intervals that hold this one, outermost first."""
    item = intervals.withColumn("__key", F.col(key)).withColumn("__label", F.col(label) if label else F.lit(""))
    placed = ancestors(item, by, key, ["__key", "__label"], nearest=label is None).drop("__key", "__label")
    out = placed.withColumn("parent", F.try_element_at("above", F.lit(-1))["__key"])
    return (out.withColumn("path", F.transform("above", lambda a: a["__label"])) if label else out).drop("above")


def crossing(intervals: DataFrame, by: list[str]) -> DataFrame:
    """by, start and end of intervals that break the nesting: they cross another, or another has the same range."""
    other = intervals.select(*[F.col(c).alias(f"o_{c}") for c in by], F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    same_file = [F.col(c) == F.col(f"o_{c}") for c in by]
    crossed = intervals.join(other, [*same_file, F.col("o_start") < F.col("start"), F.col("start") < F.col("o_end"), F.col("o_end") < F.col("end")], "left_semi")
    twice = intervals.groupBy(*by, "start", "end").count().filter("count > 1")
    return crossed.select(*by, "start", "end").unionByName(twice.select(*by, "start", "end")).distinct()


def residual_gaps(children: DataFrame, parents: DataFrame, by: list[str]) -> DataFrame:
    """by, start, end of what the children of a parent leave free. parents: by, start, end; children: by, start, end, apart."""
    bounds = parents.select(*by, F.col("start").alias("lo"), F.col("end").alias("hi"))
    edges = (
        bounds.select(*by, F.col("lo").alias("start"), F.col("lo").alias("end"))
        .unionByName(children.select(*by, "start", "end"))
        .unionByName(bounds.select(*by, F.col("hi").alias("start"), F.col("hi").alias("end")))
    )
    order = Window.partitionBy(*by).orderBy("start", "end")
    return edges.select(*by, F.lag("end").over(order).alias("gap_start"), F.col("start").alias("gap_end")).filter("gap_end > gap_start").select(*by, F.col("gap_start").alias("start"), F.col("gap_end").alias("end"))


def unsafe(intervals: DataFrame, issues: DataFrame, by: list[str]) -> DataFrame:
    """Intervals that an issue touches; an issue of no width counts as one byte.

    Issues and the ends of intervals are put in one order; the largest end of the issues that begin before an interval's
    end, a running maximum, tells whether one reaches into it. n log n in the rows of a file, without pairs.
    """
    width = F.greatest(F.col("end"), F.col("start") + 1)
    ends = issues.select(*by, F.col("start").alias("__at"), F.lit(0).alias("__side"), width.alias("__to"), F.lit(None).cast(intervals.select(F.struct("*")).schema[0].dataType).alias("__row"))
    asks = intervals.select(*by, F.col("end").alias("__at"), F.lit(-1).alias("__side"), F.lit(None).cast("bigint").alias("__to"), F.struct("*").alias("__row"))
    before = Window.partitionBy(*by).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, -1)
    rows = ends.withColumn("__to", F.col("__to").cast("bigint")).unionByName(asks).withColumn("__reach", F.max("__to").over(before))
    return rows.filter("__row is not null and __reach > __row.start").select("__row.*")


def first_of_each(rows: DataFrame, key: list[str], position: str) -> DataFrame:
    """Of rows with equal keys, the one of least position."""
    order = Window.partitionBy(*key).orderBy(position)
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
