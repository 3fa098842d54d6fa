"""The text that is embedded for a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import json_string

VERSION = "cairn-document-v1"
SEPARATOR = "\n---\n"
INPUT_BYTES = 1536


def json_or_null(c: Column) -> Column:
    return F.when(c.isNull(), "null").otherwise(json_string(c))


def embedding_document(kind: Column, language: Column, parent: Column, qualified: Column, path: Column, symbol_kind: Column, content: Column) -> Column:
    """Version, compact JSON of the six names in alphabetical order, a separator line, and the exact content."""
    names = (("chunk_kind", kind), ("language", language), ("parent_qualified_name", parent), ("qualified_name", qualified), ("relative_path", path), ("symbol_kind", symbol_kind))
    fields = [F.concat(F.lit(f'"{n}":'), json_or_null(c)) for n, c in names]
    return F.concat(F.lit(VERSION + "\n{"), F.concat_ws(",", *fields), F.lit("}" + SEPARATOR), content)


def oversize(documents: DataFrame, text: str = "text", most: int = INPUT_BYTES) -> DataFrame:
    """Documents with more bytes than a provider takes; they fail an index and are never cut."""
    return documents.filter(F.octet_length(text) > most)
