"""A repository made of the driver's documents, in Spark and, with the same expressions, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import table

DIRECTORIES = ("src", "tests", "node_modules", "migrations", "docs", ".github")
NAMES = (
    "app#.py", "Main#.java", "bundle#.min.js", ".env", ".env.example", "package-lock.json", "logo#.png", "latest#.py", "Dockerfile", "README#.md",
    "index#.tsx", "schema#.sql", "server#.pem", "util#.test.ts", "settings#.toml", "notes#.txt", "Makefile", "contest.py", "core#.h",
)


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


PATH_SQL = f"lang || '/' || ([{quoted(DIRECTORIES)}])[doc_id % {len(DIRECTORIES)} + 1] || '/' || replace(([{quoted(NAMES)}])[doc_id % {len(NAMES)} + 1], '#', CAST(doc_id AS VARCHAR))"
FILES_SQL = f"files AS (SELECT doc_id, source AS namespace, {PATH_SQL} AS relative_path, CAST(strlen(text) AS BIGINT) AS size_bytes, text AS content FROM documents)"
LOWER_NAME = "lower(split_part(relative_path, '/', -1))"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values) + 1).cast("int"))
    path = F.concat_ws("/", "lang", pick(DIRECTORIES), F.replace(pick(NAMES), F.lit("#"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("namespace"), path.alias("relative_path"), F.octet_length("text").cast("bigint").alias("size_bytes"), F.col("text").alias("content")
    )
