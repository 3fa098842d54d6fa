"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import paths, text
from cairn.operators import asserts, chunk, clusters, documents, embed, intervals, lines, parse, scan, search, sync, syntax
from cairn.plans import virtual
from cairn.plans.virtual import FILES_SQL, LOWER_NAME, quoted
from cairn.session import shared_dir, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- search -----------------------------------------------------------------------------------------------------------

PROBE = "(SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]"
SCORE = "round(1 - (1 - list_cosine_similarity({a}::DOUBLE[], {b})) / 2, 6)"


def probe(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


@query(f"SELECT vec_id, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INT) AS rank, score FROM (SELECT vec_id, {SCORE.format(a='embedding', b=PROBE)} AS score FROM embeddings) ORDER BY score DESC, vec_id LIMIT 10")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cosine_topk(table(spark, sf_dir, "embeddings"), probe(spark, sf_dir), 10)


@query(
    f"""SELECT label, vec_id, rank, score FROM (SELECT label, vec_id, score, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS INT) AS rank
    FROM (SELECT label, vec_id, {SCORE.format(a="embedding", b=PROBE)} AS score FROM embeddings)) WHERE rank <= 5"""
)
def search_by_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of each namespace (label)."""
    scored = search.scored(table(spark, sf_dir, "embeddings"), probe(spark, sf_dir))
    order = Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter("rank <= 5").select("label", "vec_id", "rank", "score")


NEAREST_SQL = f"""SELECT q.vec_id AS query_id, v.vec_id AS vec_id, {SCORE.format(a="v.embedding", b="q.embedding::DOUBLE[]")} AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0
    QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {SCORE.format(a="v.embedding", b="q.embedding::DOUBLE[]")} DESC, v.vec_id) <= 10"""


@query(NEAREST_SQL)
def search_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of the stated queries, every hundredth row, among all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return search.cosine_topk_batch(vectors, vectors.filter("vec_id % 100 = 0"), 10)


@query(NEAREST_SQL)
def search_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by clusters, of which those that can't hold one of the ten are skipped."""
    vectors = table(spark, sf_dir, "embeddings")
    return clusters.clustered_topk(clusters.clustered(vectors), vectors.filter("vec_id % 100 = 0"), 10)[0]


@query(
    f"""SELECT vec_id, path, score FROM (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'B' ELSE 'a' END || CAST(vec_id % 5 AS VARCHAR) || '.py' AS path,
    round({SCORE.format(a="embedding", b=PROBE)}, 1) AS score FROM embeddings) ORDER BY score DESC, lower(path), path, vec_id LIMIT 50"""
)
def search_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse scores: ties go by folded path, path and id."""
    scored = search.scored(table(spark, sf_dir, "embeddings"), probe(spark, sf_dir))
    path = F.concat(F.when(F.col("vec_id") % 2 == 0, "B").otherwise("a"), (F.col("vec_id") % 5).cast("string"), F.lit(".py"))
    return scored.select("vec_id", path.alias("path"), F.round("score", 1).alias("score")).orderBy(F.desc("score"), *paths.path_order(F.col("path")), "vec_id").limit(50)


@query("SELECT vec_id, 0.5::DOUBLE AS score FROM embeddings WHERE label = -1")
def search_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A namespace without rows gives none."""
    return search.scored(table(spark, sf_dir, "embeddings").filter("label = -1"), probe(spark, sf_dir)).select("vec_id", "score")


BROKEN_SQL = "CASE WHEN vec_id % 7 = 0 THEN embedding[1:63] WHEN vec_id % 11 = 0 THEN list_concat(embedding[1:63], ['nan'::FLOAT]) ELSE embedding END"


@query(f"SELECT vec_id, len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS valid FROM (SELECT vec_id, {BROKEN_SQL} AS v FROM embeddings)")
def vector_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 11 == 0, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", embed.vector_valid(broken, 64).alias("valid"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / 3)::FLOAT::DOUBLE)), 6) AS total FROM embeddings")
def vector_float32(spark: SparkSession, sf_dir: str) -> DataFrame:
    thirds = embed.float32(F.transform("embedding", lambda x: x.cast("double") / 3))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(thirds, F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


# --- scan -------------------------------------------------------------------------------------------------------------

EXT = f"regexp_extract(ltrim({LOWER_NAME}, '.'), '^.+(\\.[^.]+)$', 1)"
TEMPLATE_SQL = f"regexp_matches({LOWER_NAME}, '\\.env\\.(example|sample|template)$')"
SENSITIVE_SQL = f"""({LOWER_NAME} IN ({quoted(scan.SENSITIVE_NAMES)}) OR regexp_matches({LOWER_NAME}, '\\.(pem|key|p12|pfx)$')
    OR (({LOWER_NAME} LIKE '%.env' OR {LOWER_NAME} LIKE '%.env.%') AND NOT {TEMPLATE_SQL}))"""
SUPPORTED_SQL = f"""({TEMPLATE_SQL} OR {LOWER_NAME} IN ({quoted(scan.SPECIAL_NAMES)})
    OR (contains({LOWER_NAME}, '.') AND '.' || split_part({LOWER_NAME}, '.', -1) IN ({quoted([*scan.SOURCE_EXTENSIONS, *scan.CONFIG_EXTENSIONS, *scan.DOCUMENT_EXTENSIONS])})))"""
REASON_SQL = f"""CASE WHEN {SENSITIVE_SQL} THEN 'sensitive_file' WHEN {LOWER_NAME} IN ({quoted(scan.LOCKFILES)}) THEN 'lockfile'
    WHEN regexp_matches({LOWER_NAME}, '\\.min\\.(js|css)$') THEN 'minified' WHEN NOT {SUPPORTED_SQL} THEN 'unsupported_type' WHEN size_bytes > 8192 THEN 'too_large' END"""
ABOVE = "list_slice(string_split(lower(relative_path), '/'), 1, -2)"
STEM = f"left({LOWER_NAME}, length({LOWER_NAME}) - length({EXT}))"
CATEGORY_SQL = f"""CASE WHEN list_has_any({ABOVE}, [{quoted(scan.TEST_DIRECTORIES)}]) OR ({EXT} IN ({quoted(scan.SOURCE_EXTENSIONS)})
      AND ({STEM} LIKE 'test\\_%' ESCAPE '\\' OR {STEM} LIKE '%test' OR {LOWER_NAME} LIKE '%.test.%' OR {LOWER_NAME} LIKE '%.spec.%')) THEN 'test'
    WHEN {EXT} IN ('.sql', '.prisma') OR list_has_any({ABOVE}, ['migration', 'migrations']) THEN 'database'
    WHEN {LOWER_NAME} IN ({quoted(scan.BUILD_NAMES)}) THEN 'build'
    WHEN {LOWER_NAME} IN ({quoted(scan.CONFIG_NAMES)}) OR {TEMPLATE_SQL} OR {EXT} IN ({quoted(scan.CONFIG_EXTENSIONS)}) THEN 'config'
    WHEN {EXT} IN ('.md', '.rst') OR regexp_matches({LOWER_NAME}, '^({"|".join(scan.DOCUMENT_STEMS)})') THEN 'documentation'
    WHEN {EXT} IN ({quoted(scan.SOURCE_EXTENSIONS)}) THEN 'source' ELSE 'other_text' END"""
LANGUAGE_SQL = f"""coalesce(CASE {LOWER_NAME} {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scan.NAMED_LANGUAGES.items())} END,
    CASE {EXT} {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scan.LANGUAGES.items())} END)"""
NOT_PRUNED = f"NOT list_has_any({ABOVE}, [{quoted(scan.IGNORED_DIRECTORIES)}])"
CLASSIFIED_SQL = f"""{FILES_SQL}, classified AS (SELECT namespace, relative_path, split_part(relative_path, '/', -1) AS filename, {EXT} AS extension,
    {LANGUAGE_SQL} AS language, {CATEGORY_SQL} AS category, size_bytes, {REASON_SQL} AS reason FROM files WHERE {NOT_PRUNED})"""


@query(f"WITH {CLASSIFIED_SQL} SELECT * FROM classified")
def scan_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.classify_files(virtual.files(spark, sf_dir), 8192)


@query(f"WITH {CLASSIFIED_SQL} SELECT coalesce(reason, 'included') AS reason, category, count(*) AS files FROM classified GROUP BY ALL")
def scan_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = scan.classify_files(virtual.files(spark, sf_dir), 8192)
    return classified.groupBy(F.coalesce("reason", F.lit("included")).alias("reason"), "category").agg(F.count("*").alias("files"))


@query(f"WITH {CLASSIFIED_SQL} SELECT namespace, count(*) AS total_files_seen, count(*) FILTER (reason IS NULL) AS included_files, count(*) FILTER (reason IS NOT NULL) AS ignored_files FROM classified GROUP BY namespace")
def scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_counters(scan.classify_files(virtual.files(spark, sf_dir), 8192))


@query(f"WITH {CLASSIFIED_SQL} SELECT namespace, relative_path FROM classified WHERE reason IS NULL AND category IN ('source', 'test') AND language IN ({quoted(scan.PARSED)})")
def parse_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a parser takes."""
    return scan.classify_files(virtual.files(spark, sf_dir), 8192).filter("reason is null and category in ('source', 'test')").filter(F.col("language").isin(*scan.PARSED)).select("namespace", "relative_path")


@query(f"WITH {FILES_SQL} SELECT namespace, count(*) AS total_files, CAST(sum(size_bytes) AS BIGINT) AS repository_size_bytes FROM files GROUP BY namespace")
def tree_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.tree_measure(virtual.files(spark, sf_dir))


@query(
    r"""SELECT doc_id, CASE WHEN n = 0 THEN 0.0 ELSE (n - length(regexp_replace(t, '[\x00-\x07\x0B\x0E-\x1F\x7F]', '', 'g'))) / n END AS share,
    n > 0 AND (n - length(regexp_replace(t, '[\x00-\x07\x0B\x0E-\x1F\x7F]', '', 'g'))) / n > 0.3 AS is_binary
    FROM (SELECT doc_id, t, length(t) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', chr(1)) WHEN doc_id % 3 = 1 THEN regexp_replace(text, '[a-z]', chr(2), 'g') ELSE text END AS t FROM documents))"""
)
def binary_control_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("e"), F.lit("\x01"))).when(F.col("doc_id") % 3 == 1, F.regexp_replace("text", "[a-z]", "\x02")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", scan.control_share(t).alias("share"), scan.is_binary(t.cast("binary")).alias("is_binary"))


URLS_SQL = """urls AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://github.com/owner' || page_id || '/repo.git' WHEN 1 THEN 'http://GitHub.com/a-b/' || page_id
    WHEN 2 THEN 'https://github.com/-a/b' WHEN 3 THEN 'https://github.com/a/b/c' WHEN 4 THEN 'https://github.com/a/b.git.git' WHEN 5 THEN 'https://user@github.com/a/b'
    WHEN 6 THEN url ELSE 'https://github.com/a/b?x=' || page_id END AS url FROM pages)"""
SHAPE_SQL = r"'(?i)^https?://github\.com/([^/?#%@:\s]+)/([^/?#%@:\s]+)$'"


@query(
    f"""WITH {URLS_SQL}, parts AS (SELECT page_id, regexp_matches(url, {SHAPE_SQL}) AS shaped, regexp_extract(url, {SHAPE_SQL}, 1) AS o, regexp_replace(regexp_extract(url, {SHAPE_SQL}, 2), '\\.git$', '') AS r FROM urls),
    judged AS (SELECT *, shaped AND regexp_full_match(o, '[A-Za-z0-9]([A-Za-z0-9-]{{0,37}}[A-Za-z0-9])?') AND regexp_full_match(r, '[A-Za-z0-9._-]{{1,100}}') AND r NOT IN ('.', '..') AND NOT ends_with(r, '.git') AS accepted FROM parts)
    SELECT page_id, accepted, CASE WHEN accepted THEN o END AS owner, CASE WHEN accepted THEN r END AS repo, CASE WHEN accepted THEN 'https://github.com/' || o || '/' || r END AS normalized FROM judged"""
)
def url_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, p = table(spark, sf_dir, "pages"), F.col("page_id").cast("string")
    made = [
        F.concat(F.lit("https://github.com/owner"), p, F.lit("/repo.git")), F.concat(F.lit("http://GitHub.com/a-b/"), p), F.lit("https://github.com/-a/b"), F.lit("https://github.com/a/b/c"),
        F.lit("https://github.com/a/b.git.git"), F.lit("https://user@github.com/a/b"), F.col("url"), F.concat(F.lit("https://github.com/a/b?x="), p),
    ]
    url = F.element_at(F.array(*made), (F.col("page_id") % 8 + 1).cast("int"))
    return pages.select("page_id", paths.repository_address(url).alias("a")).select("page_id", "a.*")


# --- text, offsets, hashes ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY ALL")
def content_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(text.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


LINES_SQL = """lines AS (SELECT doc_id, line, CAST(coalesce(sum(strlen(body) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS line FROM documents))"""


@query(f"WITH {LINES_SQL} SELECT doc_id, line, start FROM lines")
def line_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_table(table(spark, sf_dir, "documents"), ["doc_id"], "text")


@query(
    f"""WITH {LINES_SQL}, o AS (SELECT doc_id, CAST(strlen(text) * 2 // 3 AS INT) AS off FROM documents)
    SELECT doc_id, off, max(line) AS line, off - max(start) AS "column" FROM o JOIN lines USING (doc_id) WHERE start <= off GROUP BY doc_id, off"""
)
def offset_to_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.floor(F.octet_length("text") * 2 / 3).cast("int").alias("off"))
    return lines.located(rows, lines.line_table(docs, ["doc_id"], "text"), ["doc_id"], F.col("off"))


def fragments_sql(target: int, most: int) -> str:
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, text, strlen(text) AS n, encode(text) AS b FROM documents),
    lf AS (SELECT doc_id, list(start ORDER BY start) FILTER (start > 0) AS ends FROM (
        SELECT doc_id, sum(strlen(body) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS start, line, count(*) OVER (PARTITION BY doc_id) AS m
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)) WHERE line < m GROUP BY doc_id),
    cut AS (
      SELECT doc_id, -1 AS fragment_index, 0::BIGINT AS start, 0::BIGINT AS "end" FROM d
      UNION ALL
      SELECT c.doc_id, c.fragment_index + 1, c."end", CASE WHEN d.n - c."end" <= {most} THEN d.n ELSE coalesce(
          list_max(list_filter(l.ends, lambda e: e > c."end" AND e <= c."end" + {target})), list_max(list_filter(l.ends, lambda e: e > c."end" AND e <= c."end" + {most})),
          list_max(list_filter([c."end" + {most}, c."end" + {most} - 1, c."end" + {most} - 2, c."end" + {most} - 3], lambda p: hex(d.b[p + 1:p + 1])[1] NOT IN ('8', '9', 'A', 'B')))) END
      FROM cut c JOIN d USING (doc_id) LEFT JOIN lf l USING (doc_id) WHERE c."end" < d.n OR (d.n = 0 AND c.fragment_index < 0))
    SELECT doc_id, CAST(fragment_index AS INT) AS fragment_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS fragment_count, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end"
    FROM cut WHERE fragment_index >= 0"""


@query(fragments_sql(chunk.TARGET, chunk.MOST))
def fragments_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.fragments(table(spark, sf_dir, "documents"), "text", ["doc_id"])


@query(fragments_sql(96, 128))
def fragments_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.fragments(table(spark, sf_dir, "documents"), "text", ["doc_id"], 96, 128)


@query(
    f"""WITH {FILES_SQL} SELECT doc_id, sha256('["{chunk.TAG}",' || to_json(namespace) || ',' || to_json(relative_path) || ',"context","","","",0,' || size_bytes || ',0]') AS chunk_id FROM files"""
)
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    ident = text.chunk_id(chunk.TAG, F.col("namespace"), F.col("relative_path"), F.lit("context"), none, none, none, F.lit(0), F.col("size_bytes"), F.lit(0))
    return virtual.files(spark, sf_dir).select("doc_id", ident.alias("chunk_id"))


DOCUMENT_SQL = f"""'{documents.VERSION}' || chr(10) || '{{"chunk_kind":"context","language":"python","parent_qualified_name":null,"qualified_name":' || to_json('m.' || namespace) || ',"relative_path":' || to_json(relative_path)
    || ',"symbol_kind":null}}' || chr(10) || '---' || chr(10) || content"""


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    doc = documents.embedding_document(F.lit("context"), F.lit("python"), none, F.concat(F.lit("m."), F.col("namespace")), F.col("relative_path"), none, F.col("content"))
    return virtual.files(spark, sf_dir).select("doc_id", doc.alias("text"))


@query(f"WITH {FILES_SQL} SELECT doc_id, sha256({DOCUMENT_SQL}) AS document_hash, CAST(strlen({DOCUMENT_SQL}) AS INT) AS bytes FROM files")
def embedding_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark, sf_dir).select("doc_id", text.content_hash(F.col("text")).alias("document_hash"), F.octet_length("text").alias("bytes"))


@query(f"WITH {FILES_SQL} SELECT doc_id FROM files WHERE strlen({DOCUMENT_SQL}) > {documents.INPUT_BYTES}")
def oversize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.oversize(rendered(spark, sf_dir)).select("doc_id")


BOUND = "CASE WHEN hex(encode(t)[{k}:{k}])[1] NOT IN ('8', '9', 'A', 'B') THEN decode(encode(t)[1:{j}]) END"


@query(
    f"""WITH s AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents)
    SELECT doc_id, sha256(CASE WHEN strlen(t) <= 1000 THEN t ELSE coalesce({", ".join(BOUND.format(k=998 - k, j=997 - k) for k in range(4))}) || '…' END) AS bounded FROM s"""
)
def bounded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(text.bounded_text(F.col("text"))).alias("bounded"))


@query(
    f"""SELECT doc_id, array_to_string(list_filter([{quoted(text.MODIFIERS)}], lambda m: list_contains(list_transform(w, lambda x: lower(x)), m)), ' ') AS modifiers
    FROM (SELECT doc_id, list_concat(string_split(text, ' '), CASE WHEN doc_id % 2 = 0 THEN ['STATIC', 'public', 'static', 'what'] ELSE ['Final', 'abstract'] END) AS w FROM documents)"""
)
def modifiers_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("doc_id") % 2 == 0, F.array(*map(F.lit, ("STATIC", "public", "static", "what")))).otherwise(F.array(F.lit("Final"), F.lit("abstract")))
    words = F.concat(F.split("text", " "), more)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.normalized_modifiers(words), " ").alias("modifiers"))


# --- inventories and intervals ------------------------------------------------------------------------------------------


def two_inventories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = virtual.files(spark, sf_dir).select("doc_id", F.concat_ws("#", "relative_path", "doc_id").alias("relative_path"))
    return files.filter("doc_id % 7 <> 0").select("relative_path"), files.filter("doc_id % 11 <> 0").select("relative_path")


PAIRS_SQL = f"WITH {FILES_SQL}, p AS (SELECT doc_id, relative_path || '#' || doc_id AS relative_path FROM files), a AS (SELECT relative_path FROM p WHERE doc_id % 7 <> 0), b AS (SELECT relative_path FROM p WHERE doc_id % 11 <> 0)"


@query(f"{PAIRS_SQL} SELECT relative_path FROM a JOIN b USING (relative_path)")
def inventory_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_inventories(spark, sf_dir)
    return a.join(b, "relative_path")


@query(f"{PAIRS_SQL} SELECT relative_path, 'files' AS only_in FROM a ANTI JOIN b USING (relative_path) UNION ALL SELECT relative_path, 'parsed' FROM b ANTI JOIN a USING (relative_path)")
def inventory_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.unpaired(*two_inventories(spark, sf_dir))


def line_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested intervals over each text: the whole, two thirds, and two places in the second, as far as the text has room."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("n"))
    made = "array(struct(0L as id, 0L as start, n as end), struct(1L as id, 1L as start, n div 3 as end), struct(2L as id, n div 3 as start, 2 * (n div 3) as end), struct(3L as id, n div 3 + 2 as start, least(n div 3 + 12, 2 * (n div 3)) as end), struct(4L as id, n div 3 + 5 as start, least(n div 3 + 8, 2 * (n div 3)) as end))"
    return docs.select("doc_id", F.inline(F.expr(made))).filter("start < end")


INTERVALS_SQL = """i AS (SELECT * FROM (SELECT doc_id, unnest([0, 1, 2, 3, 4])::BIGINT AS id, unnest([0, 1, n // 3, n // 3 + 2, n // 3 + 5])::BIGINT AS start, unnest([n, n // 3, 2 * (n // 3), least(n // 3 + 12, 2 * (n // 3)), least(n // 3 + 8, 2 * (n // 3))])::BIGINT AS "end"
    FROM (SELECT doc_id, strlen(text) AS n FROM documents)) WHERE start < "end")"""


@query(
    f"""WITH {INTERVALS_SQL} SELECT c.doc_id, c.id, c.start, c."end", arg_min(p.id, p."end" - p.start) AS parent FROM i c LEFT JOIN i p ON p.doc_id = c.doc_id AND p.id <> c.id AND p.start <= c.start AND p."end" >= c."end"
    GROUP BY ALL"""
)
def containment_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.containment_parents(line_intervals(spark, sf_dir), ["doc_id"]).select("doc_id", "id", "start", "end", "parent")


@query(f"""WITH {INTERVALS_SQL} SELECT doc_id, id, start, "end", max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC ROWS UNBOUNDED PRECEDING) AS max_end FROM i""")
def running_max_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.running_end(line_intervals(spark, sf_dir), ["doc_id"]).select("doc_id", "id", "start", "end", "max_end")


@query(f"""WITH {INTERVALS_SQL} SELECT doc_id, id FROM i WHERE start < doc_id % 40 + 1 + 10 AND doc_id % 40 + 10 < "end" """)
def unsafe_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that an issue of no width touches, one issue a document."""
    rows = line_intervals(spark, sf_dir)
    at = F.col("doc_id") % 40 + 10
    issues = rows.filter("id = 0").select("doc_id", at.alias("start"), at.alias("end"))
    return intervals.unsafe(rows, issues, ["doc_id"]).select("doc_id", "id")


@query(
    f"""WITH {INTERVALS_SQL}, e AS (SELECT doc_id, start, "end" FROM i WHERE id IN (1, 2) UNION ALL SELECT doc_id, 0, 0 FROM i WHERE id = 0 UNION ALL SELECT doc_id, "end", "end" FROM i WHERE id = 0)
    SELECT doc_id, a AS start, b AS "end" FROM (SELECT doc_id, lag("end") OVER (PARTITION BY doc_id ORDER BY start, "end") AS a, start AS b FROM e) WHERE b > a"""
)
def residual_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What intervals 1 and 2 leave of the whole text."""
    rows = line_intervals(spark, sf_dir)
    return intervals.residual_gaps(rows.filter("id in (1, 2)"), rows.filter("id = 0"), ["doc_id"])


@query("SELECT doc_id, text_hash FROM (SELECT doc_id, md5(text) AS text_hash, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal records of a source, the first."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("text_hash"))
    return intervals.first_of_each(rows, ["source", "text_hash"], "doc_id").select("doc_id", "text_hash")


# --- synchronisation ----------------------------------------------------------------------------------------------------


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the documents by fixed rules: some gone, some edited, some new."""
    docs = table(spark, sf_dir, "documents").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("chunk_id"), "doc_id", "text")
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    current = docs.filter("doc_id % 10 <> 0").select("chunk_id", F.sha2(edited, 256).alias("content_hash"))
    return current, docs.filter("doc_id % 13 <> 0").select("chunk_id", F.sha2("text", 256).alias("content_hash"))


SNAP_SQL = """WITH c AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS chunk_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 0),
    s AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS chunk_id, sha256(text) AS h FROM documents WHERE doc_id % 13 <> 0),
    d AS (SELECT coalesce(c.chunk_id, s.chunk_id) AS chunk_id, CASE WHEN s.h IS NULL THEN 'new' WHEN c.h IS NULL THEN 'deleted' WHEN c.h = s.h THEN 'unchanged' ELSE 'updated' END AS class, coalesce(c.h, s.h) AS h FROM c FULL JOIN s USING (chunk_id))"""
COUNTERS_SQL = """SELECT count(*) FILTER (class <> 'deleted') AS total_chunks, count(*) FILTER (class = 'unchanged') AS reused_chunks, count(*) FILTER (class IN ('new', 'updated')) AS embedded_chunks,
    count(*) FILTER (class = 'new') AS inserted_chunks, count(*) FILTER (class = 'updated') AS updated_chunks, count(*) FILTER (class = 'deleted') AS deleted_chunks,
    CASE WHEN count(*) FILTER (class <> 'unchanged') = 0 THEN 'unchanged' ELSE 'success' END AS status FROM """


@query(f"{SNAP_SQL} SELECT chunk_id, class FROM d")
def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sync_diff(*snapshots(spark, sf_dir))


@query(f"{SNAP_SQL} {COUNTERS_SQL} d")
def sync_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sync_counters(sync.sync_diff(*snapshots(spark, sf_dir)))


@query(f"{SNAP_SQL} {COUNTERS_SQL} (SELECT 'unchanged' AS class FROM s)")
def sync_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = snapshots(spark, sf_dir)[1]
    return sync.sync_counters(sync.sync_diff(stored, stored))


@query(f"{SNAP_SQL} SELECT chunk_id, CASE WHEN class = 'unchanged' THEN 'updated' ELSE class END AS class FROM d")
def sync_incompatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sync_diff(*snapshots(spark, sf_dir), compatible=False)


@query(f"{SNAP_SQL} SELECT chunk_id, h AS content_hash, CASE WHEN class = 'unchanged' THEN 'reused' ELSE 'embedded' END AS origin FROM d WHERE class <> 'deleted'")
def next_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, stored = snapshots(spark, sf_dir)
    diff = sync.sync_diff(current, stored)
    fresh = current.join(diff.filter("class in ('new', 'updated')").select("chunk_id"), "chunk_id", "left_semi").withColumn("origin", F.lit("embedded"))
    return sync.next_manifest(diff, stored.withColumn("origin", F.lit("reused")), fresh)


# --- parsing ------------------------------------------------------------------------------------------------------------

#: In the templates below # is the document's id, {C} its text as part of a comment, {B} as part of a text literal; [[x]] marks a place.
HARMLESS = {"#": [], "{C}": [("*/", "* /")], "{B}": [("\\", "/"), ('"', "'"), ("`", "'"), ("$", "S")]}


def parts_of(template: str) -> list[str]:
    return [p for p in re.split(r"(#|\{C\}|\{B\})", re.sub(r"\[\[\w+\]\]", "", template)) if p]


def source_of(template: str) -> Column:
    """A source for each document, with its id and text at the marks."""

    def one(part: str) -> Column:
        if part not in HARMLESS:
            return F.lit(part)
        value = F.col("doc_id").cast("string") if part == "#" else F.coalesce("text", F.lit(""))
        for a, b in HARMLESS[part]:
            value = F.replace(value, F.lit(a), F.lit(b))
        return value

    return F.concat(*map(one, parts_of(template)))


def source_sql(template: str) -> str:
    def one(part: str) -> str:
        if part not in HARMLESS:
            return quoted([part])
        value = "CAST(doc_id AS VARCHAR)" if part == "#" else "coalesce(text, '')"
        for a, b in HARMLESS[part]:
            value = f"replace({value}, {quoted([a])}, {quoted([b])})"
        return value

    return " || ".join(map(one, parts_of(template))) or "''"


def place_sql(template: str, mark: str) -> str:
    """The byte offset of a mark."""
    return f"CAST(strlen({source_sql(template.split(f'[[{mark}]]')[0])}) AS BIGINT)"


def facts_sql(template: str, marks: str, **columns: list[str]) -> str:
    """A row for each pair of marks (start, end), with the columns' values: texts with # for the document's id, None for null."""
    value = lambda v: "NULL" if v is None else source_sql(v)
    pairs = marks.split()
    listed = [f"unnest([{', '.join(map(value, v))}]) AS {k}" for k, v in columns.items()]
    listed += [f'unnest([{", ".join(place_sql(template, m[k]) for m in pairs)}]) AS "{n}"' for k, n in enumerate(("start", "end"))]
    return f"SELECT doc_id, {', '.join(listed)} FROM documents"


def sources(spark: SparkSession, sf_dir: str, template: str, language: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(language).alias("language"), source_of(template).alias("content"))


PYTHON = 'import m#\n# \n[[a]]class C#:\n    """{B}"""\n    [[c]]X = 1[[d]]\n    [[e]]def f(self):\n        """{B}"""\n        return [[g]]g#(1)[[h]][[f]][[b]]\n'


@query(facts_sql(PYTHON, "ab cd ef", kind=["class", "constant", "method"], name=["C#", "X", "f"], qualified_name=["C#", "C#.X", "C#.f"]).replace('AS "start"', "AS start_byte").replace('AS "end"', "AS end_byte"))
def parse_symbols_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse.parse_python(sources(spark, sf_dir, PYTHON, "python"), ["doc_id"])
    return parsed.select("doc_id", F.inline("symbols")).select("doc_id", "kind", "name", "qualified_name", F.col("start_byte").cast("bigint").alias("start_byte"), F.col("end_byte").cast("bigint").alias("end_byte"))


@query(facts_sql(PYTHON, "gh", module=["m#"], caller=["C#.f"], callee=["g#"]))
def parse_imports_calls_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse.parse_python(sources(spark, sf_dir, PYTHON, "python"), ["doc_id"])
    calls = parsed.select("doc_id", F.inline("imports"), "calls").select("doc_id", "module", F.inline("calls"))
    return calls.select("doc_id", "module", F.col("caller_qualified_name").alias("caller"), F.col("callee_text").alias("callee"), F.col("start_byte").cast("bigint").alias("start"), F.col("end_byte").cast("bigint").alias("end"))


JAVA = """package p#;
[[i]]import java.util.List;[[j]]
[[k]]import static a.b#.*;[[l]]
/* {C} */
[[a]]public class K# {
  [[c]]private final String s = \"\"\"
{B} " \"\"\";[[d]]
  [[e]]K#() { super(); }[[f]]
  [[g]]@Override int m(int a) throws E { /* {C} */ if (a > 0) { [[1]]x.go#()[[2]]; } return [[3]]new T#([[5]]h(a)[[6]])[[4]].size; }[[h]]
  Runnable r = [[7]]new Runnable()[[8]] { public void run() { [[9]]q("a")[[0]]; } };
  [[m]]interface I { [[o]]void f();[[p]] }[[n]]
}[[b]]
record R#(int a) { void z() { [[x]]y#()[[y]]; } }
"""
#: One class is sound, the other has a parenthesis without a partner.
JAVA_BROKEN = "[[a]]class G# { [[c]]void f() { /* {C} */ [[1]]g()[[2]]; }[[d]] }[[b]]\nclass B# { [[x]]void f( { /* {C} */ }[[y]] }\n"
ECMASCRIPT = """[[i]]import { a as b, c } from "m#";[[j]]
[[k]]import "side";[[l]]
// it's a "note" {
/* {C} */
export [[a]]class C# {
  [[c]]constructor(x) { [[1]]f#(x)[[2]]; }[[d]]
  [[e]]async go() { const t = `{B} } {`; if (a) { [[3]]a.b()[[4]]; } }[[f]]
}[[b]]
const [[g]]k# = (x) => { /* {C} */ return [[5]]q(x)[[6]] / 2; }[[h]];
[[m]]function z() { const C = class { method() { [[7]]hidden#()[[8]]; } }; }[[n]]
const fs = [[o]]require("fs#")[[p]];
"""


def java_facts(spark: SparkSession, sf_dir: str) -> syntax.Facts:
    return syntax.facts(sources(spark, sf_dir, JAVA, "java"), ["doc_id"])


def ecmascript_facts(spark: SparkSession, sf_dir: str) -> syntax.Facts:
    return syntax.facts(sources(spark, sf_dir, ECMASCRIPT, "javascript"), ["doc_id"])


SYMBOLS = ["doc_id", "kind", "qualified_name", "start", "end"]
CALLS = ["doc_id", "caller", "callee", "kind", "start", "end"]


@query(facts_sql(JAVA, "ab mn", kind=["class", "interface"], qualified_name=["p#.K#", "p#.K#.I"], parent_qualified_name=[None, "p#.K#"]))
def parse_declarations_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    return java_facts(spark, sf_dir).symbols.filter("kind in ('class', 'interface')").select(*SYMBOLS, "parent_qualified_name")


@query(facts_sql(JAVA, "cd ef gh op", kind=["constant", "constructor", "method", "method"], qualified_name=["p#.K#.s", "p#.K#.K#", "p#.K#.m", "p#.K#.I.f"]))
def parse_members_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    return java_facts(spark, sf_dir).symbols.filter("kind not in ('class', 'interface')").select(*SYMBOLS)


@query(facts_sql(JAVA, "ab cd ef gh mn op", qualified_name=["p#.K#", "p#.K#.s", "p#.K#.K#", "p#.K#.m", "p#.K#.I", "p#.K#.I.f"], modifiers=["public", "private final", "", "", "", ""]))
def parse_modifiers_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    return java_facts(spark, sf_dir).symbols.select("doc_id", "qualified_name", F.array_join("modifiers", " ").alias("modifiers"), "start", "end")


@query(facts_sql(JAVA, "ij kl", module=["java.util.List", "a.b#"], modifiers=["", "static"], wild=["false", "true"]))
def parse_imports_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    return java_facts(spark, sf_dir).imports.select("doc_id", "module", F.array_join("modifiers", " ").alias("modifiers"), F.col("is_wildcard").cast("string").alias("wild"), "start", "end")


@query(facts_sql(JAVA, "12 34 56 78 90 xy", caller=["p#.K#.m", "p#.K#.m", "p#.K#.m", None, None, None], callee=["x.go#", "T#", "h", "Runnable", "q", "y#"], kind=["call", "constructor", "call", "constructor", "call", "call"]))
def parse_calls_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    return java_facts(spark, sf_dir).calls.select(*CALLS)


SIGNATURES = """class K#<T extends C<T>> extends B#<M<A, T>> /* {C} */ implements I, J# {
  void f(final M<A, L#> m, @N(\"\"\"
{B}\"\"\") int[] x /* {C} */, String... rest) { g(a < b, c); }
}
"""


@query("SELECT doc_id, 'K' || doc_id AS name, unnest(['base', 'implemented', 'implemented']) AS relation, unnest([0, 0, 1])::INT AS position, unnest(['B' || doc_id || '<M<A, T>>', 'I', 'J' || doc_id]) AS type_name FROM documents")
def parse_supertypes_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = syntax.facts(sources(spark, sf_dir, SIGNATURES, "java"), ["doc_id"]).supertypes
    return found.select("doc_id", F.col("qualified_name").alias("name"), "relation", "position", "type_name")


@query("SELECT doc_id, unnest([0, 1, 2])::INT AS position, unnest(['m', 'x', 'rest']) AS name, unnest(['M<A, L' || doc_id || '>', 'int[]', 'String...']) AS type_name FROM documents")
def parse_parameters_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.facts(sources(spark, sf_dir, SIGNATURES, "java"), ["doc_id"]).parameters.select("doc_id", "position", "name", "type_name")


@query(facts_sql(JAVA_BROKEN, "ab cd 12 xy", kind=["class", "method", "call", "syntax_error"], name=["G#", "G#.f", "g", None]))
def parse_broken_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is sound beside a broken class, and the issue."""
    f = syntax.facts(sources(spark, sf_dir, JAVA_BROKEN, "java"), ["doc_id"])
    rows = f.symbols.select("doc_id", "kind", F.col("qualified_name").alias("name"), "start", "end")
    return rows.unionByName(f.calls.select("doc_id", "kind", F.col("callee").alias("name"), "start", "end")).unionByName(f.issues.select("doc_id", "kind", F.lit(None).cast("string").alias("name"), "start", "end"))


@query(facts_sql(ECMASCRIPT, "ab cd ef gh mn", kind=["class", "constructor", "method", "function", "function"], qualified_name=["C#", "C#.constructor", "C#.go", "k#", "z"]))
def parse_members_ecmascript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ecmascript_facts(spark, sf_dir).symbols.filter("kind <> 'constant'").select(*SYMBOLS)


@query(facts_sql(ECMASCRIPT, "ab cd ef gh mn", qualified_name=["C#", "C#.constructor", "C#.go", "k#", "z"], modifiers=["export", "", "async", "", ""]))
def parse_modifiers_ecmascript(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ecmascript_facts(spark, sf_dir).symbols.filter("kind <> 'constant'")
    return found.select("doc_id", "qualified_name", F.array_join("modifiers", " ").alias("modifiers"), "start", "end")


@query(facts_sql(ECMASCRIPT, "ij kl op", module=["m#", "side", "fs#"], bindings=["a b,c", "", "* fs"]))
def parse_imports_ecmascript(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_join(F.transform("bindings", lambda b: F.concat_ws(" ", b["imported_name"], b["alias"])), ",")
    return ecmascript_facts(spark, sf_dir).imports.select("doc_id", "module", names.alias("bindings"), "start", "end")


@query(facts_sql(ECMASCRIPT, "12 34 56 78 op", caller=["C#.constructor", "C#.go", "k#", None, None], callee=["f#", "a.b", "q", "hidden#", "require"], kind=["call"] * 5))
def parse_calls_ecmascript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ecmascript_facts(spark, sf_dir).calls.select(*CALLS)


# --- contract checks and publishing -------------------------------------------------------------------------------------


@query("SELECT content_hash, count(*) AS times FROM (SELECT sha256(text) AS content_hash FROM documents) GROUP BY content_hash HAVING count(*) > 1")
def assert_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(text.content_hash(F.col("text")).alias("content_hash"))
    return asserts.repeated(rows, ["content_hash"])


@query(f"""WITH {INTERVALS_SQL} SELECT doc_id, id FROM (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM i) WHERE start < b""")
def assert_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asserts.overlapping(line_intervals(spark, sf_dir), ["doc_id"]).select("doc_id", "id")


@query("SELECT doc_id FROM (SELECT doc_id, n_chars, lag(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents) WHERE n_chars <= b")
def assert_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return asserts.out_of_order(rows, ["source"], "doc_id", "n_chars").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 > 0")
def assert_unsafe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.element_at(F.array(F.lit("a/b.py"), F.lit("/a"), F.lit("a/../b"), F.lit("C:/x")), (F.col("doc_id") % 4 + 1).cast("int"))
    return asserts.unsafe_paths(table(spark, sf_dir, "documents").select("doc_id", path.alias("relative_path"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 9 = 0")
def assert_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    now = docs.withColumn("content", F.when(F.col("doc_id") % 9 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return asserts.stale(now, docs.select("doc_id", text.content_hash(F.col("content")).alias("source_sha256")), ["doc_id"])


@query("SELECT 0::BIGINT AS wrong")
def assert_wrong_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of all documents agree with their ranges."""
    files = virtual.files(spark, sf_dir).select("namespace", F.concat_ws("#", "relative_path", "doc_id").alias("relative_path"), "content")
    keys = ["namespace", "relative_path"]
    chunks = chunk.chunk_rows(chunk.fragments(files, "content", keys).withColumn("kind", F.lit("fragment")), files, keys)
    return asserts.wrong_chunks(chunks, files, keys).agg(F.count("*").alias("wrong"))


@query("SELECT sha256(CAST(doc_id AS VARCHAR)) AS chunk_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 11 > 0")
def publish_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A namespace indexed twice, the second time with fewer and edited chunks, then read by the pointer."""
    import uuid

    from cairn.operators import index

    root = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    store, provider = index.VectorIndex(spark, f"{root}/cairn/index-{uuid.uuid4().hex}"), embed.HashProvider(4)
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("chunk_id"), "doc_id", F.concat_ws("/", "source", "doc_id").alias("relative_path"), F.col("text").alias("content"), "text")
    edited = chunks.withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("?"))).otherwise(F.col("content")))
    index.synchronize(store, "n", edited.withColumn("content_hash", F.sha2("content", 256)), provider)
    index.synchronize(store, "n", chunks.filter("doc_id % 11 > 0").withColumn("content_hash", F.sha2("content", 256)), provider)
    return store.read("n", store.active("n")).select("chunk_id", "content_hash")


SIZES_SQL = "(SELECT DISTINCT unnest([n, 1000 * n + 50, 100000 * n, 1000000 * n]) AS size_bytes FROM (SELECT CAST(strlen(text) AS BIGINT) AS n FROM documents))"


@query(
    f"""SELECT size_bytes, CASE WHEN size_bytes < 1000 THEN size_bytes || ' B' WHEN size_bytes < 1000000 THEN format('{{:.1f}} kB', size_bytes / 1000) WHEN size_bytes < 1000000000 THEN format('{{:.1f}} MB', size_bytes / 1000000)
    ELSE format('{{:.1f}} GB', size_bytes / 1000000000) END AS readable FROM {SIZES_SQL}"""
)
def readable_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of all texts and some multiples, so that each unit occurs."""
    n = F.octet_length("text").cast("bigint")
    sizes = table(spark, sf_dir, "documents").select(F.explode(F.array(n, 1000 * n + 50, 100000 * n, 1000000 * n)).alias("size_bytes")).distinct()
    return sizes.select("size_bytes", text.readable_size(F.col("size_bytes")).alias("readable"))
