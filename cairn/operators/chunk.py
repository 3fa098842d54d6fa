"""Chunks: exact byte ranges of a file, with content hashes and provenance ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import byte_slice, chunk_id, content_hash
from cairn.operators.lines import line_table, with_locations

TARGET, MOST = 4096, 8192
TAG = "cairn-chunk-v1"


def next_cut(data: Column, at: Column, target: int, most: int) -> Column:
    """The end of the piece that begins at a byte offset from which more than `most` bytes are left; null where it has no bytes.

    After the last LF within target, else within most, else a hard cut that parts neither a character nor CR and LF.
    """

    def behind_last_line(size: int) -> Column:
        end = at + size - F.octet_length(F.substring_index(F.substr(data, at + 1, F.lit(size)).cast("string"), "\n", -1))
        return F.get(F.filter(F.array(end), lambda p: p > at), F.lit(0))  # a lambda's argument is computed once

    byte = lambda p: F.hex(F.substr(data, p + 1, F.lit(1)))
    hard = at + most
    whole = [F.when(~byte(hard - k).between("80", "BF"), hard - k) for k in range(min(4, most))]
    end = F.when((byte(hard - 1) == "0D") & (byte(hard) == "0A"), hard - 1 if most > 1 else F.lit(None)).otherwise(F.coalesce(*whole))
    return F.coalesce(behind_last_line(target), behind_last_line(most), end)


def cut_points(content: Column, target: int = TARGET, most: int = MOST) -> Column:
    """Ends of the pieces of valid UTF-8, an array; a text of `most` bytes or less is one piece, also the empty one.

    A fold of as many steps as a text can have pieces. Two pieces together have more than the lesser of target and most - 3
    bytes. A step reads `most` bytes at most, so a text is read about four times; only ends are kept.
    """
    if most <= 0 or target <= 0 or target > most:
        raise ValueError("0 < target <= most is needed")
    n = F.octet_length(content)
    steps = F.when(n <= most, 0).otherwise(2 * F.ceil(n / max(1, min(target, most - 3))) + 2).cast("int")
    begin = F.struct(content.cast("binary").alias("data"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def step(done: Column, _: Column) -> Column:
        at = done["at"]
        stuck = F.raise_error(F.lit("a character is longer than the largest piece")).cast("int")
        cut = F.coalesce(next_cut(done["data"], at, target, most), stuck).cast("int")
        further = F.transform(F.array(cut), lambda p: F.struct(done["data"].alias("data"), p.alias("at"), F.concat(done["ends"], F.array(p)).alias("ends")))
        return F.when(F.octet_length(done["data"]) - at > most, F.get(further, F.lit(0))).otherwise(done)

    # The first of `steps` is a no-op where a text is one piece: sequence() has one element at least.
    return F.aggregate(F.sequence(F.lit(0), steps), begin, step, lambda done: F.concat(done["ends"], F.array(F.octet_length(done["data"]))))


def fragments(files: DataFrame, content: str, keys: list[str], target: int = TARGET, most: int = MOST) -> DataFrame:
    """keys, fragment_index, fragment_count, start, end of every file's pieces; each file is cut where it lies, in the JVM. Null content has none."""
    # All of a piece comes from one array, so that the plan has the fold once.
    start = lambda ends, k: F.when(k == 0, 0).otherwise(F.get(ends, k - 1)).alias("start")
    pieces = lambda ends: F.transform(ends, lambda p, k: F.struct(k.alias("fragment_index"), F.size(ends).alias("fragment_count"), start(ends, k), p.alias("end")))
    return files.select(*keys, F.inline(F.get(F.transform(F.array(cut_points(F.col(content), target, most)), pieces), F.lit(0))))


def chunk_rows(pieces: DataFrame, files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Pieces joined with their file: chunk_id, content, content_hash and the lines of both ends.

    pieces: keys (namespace, relative_path), start, end, kind, fragment_index and the symbol columns (nullable).
    """
    rows = pieces.join(files.select(*keys, F.col(content).alias("__text")), keys)
    data = byte_slice(F.col("__text"), F.col("start"), F.col("end"))
    symbol = [F.col(c) if c in pieces.columns else F.lit(None).cast("string") for c in ("symbol_kind", "qualified_name", "parent_qualified_name")]
    ident = chunk_id(TAG, F.col(keys[0]), F.col(keys[1]), F.col("kind"), *symbol, F.col("start"), F.col("end"), F.col("fragment_index"))
    made = rows.select(ident.alias("chunk_id"), *pieces.columns, data.cast("string").alias("content"), content_hash(data).alias("content_hash"))
    return with_locations(made, line_table(files, keys, content), keys)


def unpaired(files: DataFrame, parsed: DataFrame, key: str = "relative_path") -> DataFrame:
    """Paths that only one of two inventories has, and which."""
    only = lambda a, b, side: a.join(b, key, "left_anti").select(key, F.lit(side).alias("only_in"))
    return only(files, parsed, "files").unionByName(only(parsed, files, "parsed"))
