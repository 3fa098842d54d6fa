"""Column functions over text, bytes and offsets. Offsets are bytes of the original UTF-8, half-open; lines count from 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw(text: Column) -> Column:
    return text.cast("binary")


def content_hash(data: Column) -> Column:
    """Lowercase hex SHA-256 of the bytes."""
    return F.sha2(data.cast("binary"), 256)


def json_string(text: Column) -> Column:
    """A JSON string literal: non-ASCII kept, control characters as lowercase \\u00xx."""
    quoted = F.to_json(F.struct(text.alias("v")))
    body = F.regexp_replace(F.substring(quoted, 6, 2**30), r"\}$", "")
    # Spark writes \u001F, Python \u001f: bring the hex digits of control escapes to lower case.
    for digit in "ABCDEF":
        body = F.regexp_replace(body, r"(?<!\\)((?:\\\\)*)\\u00([01])" + digit, r"$1\\u00$2" + digit.lower())
    return body


def json_array(*parts: Column) -> Column:
    """Compact JSON array of parts that are JSON already."""
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def chunk_id(tag: str, namespace: Column, path: Column, kind: Column, symbol_kind: Column, qualified: Column, parent: Column, start: Column, end: Column, index: Column) -> Column:
    """SHA-256 of the compact JSON array of ten provenance values; nulls among the names count as empty strings."""
    text = [json_string(F.coalesce(c, F.lit(""))) for c in (F.lit(tag), namespace, path, kind, symbol_kind, qualified, parent)]
    return content_hash(json_array(*text, *[c.cast("string") for c in (start, end, index)]))


def byte_slice(data: Column, start: Column, end: Column) -> Column:
    return F.substr(data.cast("binary"), (start + 1).cast("int"), (end - start).cast("int"))


def is_blank(text: Column) -> Column:
    """Whether all characters are white space in the sense of str.isspace (which knows U+001C to U+001F too)."""
    return text.rlike(r"(?U)\A[\s\x1c-\x1f]*\z")


def bounded_text(text: Column, most: int = 1000) -> Column:
    """Text without ASCII white space at its ends; over `most` bytes it is cut at a character within most - 3 and gets an ellipsis."""
    trimmed = F.regexp_replace(text, r"\A[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+\z", "")
    # Of the cuts at most - 3 bytes and up to three before it, the longest that is whole characters.
    cuts = [F.try_validate_utf8(F.substr(raw(trimmed), F.lit(1), F.lit(most - 3 - k)).cast("binary").cast("string")) for k in range(4)]
    return F.when(F.octet_length(trimmed) <= most, trimmed).otherwise(F.concat(F.coalesce(*cuts), F.lit("…")))


# The closed vocabulary of modifiers, in the order of output.
MODIFIERS = (
    "public", "protected", "private", "static", "async", "abstract", "final", "readonly", "export", "default", "generator", "synchronized",
    "native", "strictfp", "transient", "volatile", "sealed", "non-sealed", "open", "override", "declare", "accessor", "get", "set",
)


def normalized_modifiers(values: Column) -> Column:
    """Known modifiers in lower case, each once, in the vocabulary's order."""
    # The list is lowered and reduced once a row; within a filter of the vocabulary it would be lowered anew for each modifier.
    known = F.array(*[F.lit(m) for m in MODIFIERS])
    return F.coalesce(F.array_intersect(known, F.transform(values, F.lower)), F.array().cast("array<string>"))


def printable(text: Column) -> Column:
    """For log lines: what can't be printed becomes a question mark, the empty text <invalid>."""
    safe = F.regexp_replace(text, r"[^\P{C}]|[\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]", "?")
    return F.when(F.length(safe) == 0, "<invalid>").otherwise(safe)


def readable_size(n: Column) -> Column:
    """A size in decimal units; halves of the one decimal go to the even digit, by the exact binary value."""
    value = n.cast("double")
    decimal = lambda x, unit: F.concat(F.replace(F.format_number(x, 1), F.lit(",")), F.lit(f" {unit}"))
    return (
        F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1_000_000, decimal(value / 1e3, "kB"))
        .when(n < 1_000_000_000, decimal(value / 1e6, "MB"))
        .otherwise(decimal(value / 1e9, "GB"))
    )
