"""From a directory of source code to a searchable index: scan, parse, chunk, synchronise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.paths import path_order
from cairn.functions.text import byte_slice, is_blank
from cairn.operators import asserts, chunk, documents, index, parse, scan, syntax
from cairn.operators.embed import Provider
from cairn.operators.intervals import containment_parents, crossing, residual_gaps, unsafe
from cairn.session import materialize
from cairn.sources.files import repository_files

FILE = ["namespace", "relative_path"]


@dataclass
class Inventory:
    """files: to index, with content; ignored: left out, with a reason; skipped_dirs: pruned, with a reason."""

    files: DataFrame
    ignored: DataFrame
    skipped_dirs: DataFrame


def scan_repository(spark: SparkSession, path: str, namespace: str | None = None, max_file_bytes: int = scan.MAX_BYTES, sample_bytes: int = scan.SAMPLE_BYTES) -> Inventory:
    """The files under a directory, classified. The directory is read once, and written down, for one consistent view.

    A file that its name or size leaves out is never opened.
    """
    by_name = scan.ignore_reason(F.col("relative_path"), F.col("size_bytes"), max_file_bytes).isNull()
    entries = materialize(repository_files(spark, path, namespace, by_name, max_file_bytes), "scan")
    found = entries.filter(F.col("outcome").isin("file", "symlink", "unreadable"))
    named = scan.ignore_reason(F.col("relative_path"), F.col("size_bytes"), max_file_bytes)
    binary = F.when(named.isNull() & (F.col("outcome") == "file"), scan.is_binary(F.substring("content", 1, sample_bytes)))
    reason = F.when(F.col("outcome") == "symlink", "symlink").otherwise(F.coalesce(named, F.when(F.col("outcome") == "unreadable", "unreadable"), F.when(F.col("binary"), "binary")))
    judged = found.withColumn("binary", binary).withColumn("reason", reason)
    p = F.col("relative_path")
    kept = judged.filter("reason is null").select(*FILE, scan.language(p).alias("language"), scan.category(p).alias("category"), "size_bytes", "content")
    skipped = entries.filter(F.col("outcome").endswith("_directory")).select(*FILE, F.when(F.col("outcome") == "ignored_directory", "ignored_directory").when(F.col("outcome") == "symlink_directory", "symlink").otherwise("unreadable").alias("reason"))
    return Inventory(kept, judged.filter("reason is not null").select(*FILE, "reason"), skipped)


def ordered_inventory(inventory: Inventory) -> Inventory:
    """Each part in its total order, by range partitions: folded path, then path. Written out, the files of a folder keep it."""
    by = lambda df: df.orderBy("namespace", *path_order(F.col("relative_path")))
    return Inventory(by(inventory.files), by(inventory.ignored), by(inventory.skipped_dirs))


SYMBOL = "array<struct<kind:string,name:string,qualified_name:string,parent_qualified_name:string,start:bigint,end:bigint,modifiers:array<string>>>"
IMPORT = "array<struct<module:string,bindings:array<struct<imported_name:string,alias:string>>,is_wildcard:boolean,modifiers:array<string>,start:bigint,end:bigint>>"
CALL = "array<struct<caller:string,callee:string,kind:string,start:bigint,end:bigint>>"
ISSUE = "array<struct<kind:string,message:string,start:bigint,end:bigint>>"
LISTS = {"symbols": SYMBOL, "imports": IMPORT, "calls": CALL, "issues": ISSUE}
PARSED = ("python", "java", "javascript", "typescript")


def python_files(files: DataFrame) -> DataFrame:
    """parse_inventory() for Python."""
    binding = lambda i: F.when(i["imported_name"].isNull() & i["alias"].isNull(), F.array()).otherwise(F.array(F.struct(F.coalesce(i["imported_name"], i["module"]).alias("imported_name"), i["alias"].alias("alias"))))
    lists = {
        "symbols": F.transform("symbols", lambda x: F.struct(x["kind"], x["name"], x["qualified_name"], x["parent_qualified_name"], x["start_byte"], x["end_byte"], x["modifiers"])),
        "imports": F.transform("imports", lambda x: F.struct(x["module"], binding(x).alias("bindings"), x["is_wildcard"], F.array().cast("array<string>").alias("modifiers"), x["start_byte"], x["end_byte"])),
        "calls": F.transform("calls", lambda x: F.struct(x["caller_qualified_name"], x["callee_text"], F.lit("call").alias("kind"), x["start_byte"], x["end_byte"])),
        "issues": F.transform("issues", lambda x: F.struct(x["kind"], x["message"], x["start_byte"], x["end_byte"])),
    }
    return parse.parse_python(files, FILE).select(*FILE, F.lit("python").alias("language"), "status", "source_sha256", *[c.cast(LISTS[n]).alias(n) for n, c in lists.items()])


def token_files(files: DataFrame) -> DataFrame:
    """parse_inventory() for Java and ECMAScript: facts of all files by joins and windows, then listed by file."""
    files = files.withColumn("valid", F.is_valid_utf8(F.col("content").cast("string")))
    found = syntax.facts(files.filter("valid").select(*FILE, "language", F.col("content").cast("string").alias("content")), FILE)
    rows = files.select(*FILE, "language", "valid", F.sha2("content", 256).alias("source_sha256"))
    order = {"symbols": ["start", "end", "kind", "qualified_name"], "imports": ["start", "end", "module"], "calls": ["start", "end", "kind", "callee"], "issues": ["start", "end", "kind"]}
    for name, kind in LISTS.items():
        fields = [f.split(":")[0] for f in kind.removeprefix("array<struct<").replace("array<struct<imported_name:string,alias:string>>", "x").split(",")]
        facts = getattr(found, name)
        first = F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order[name])], F.struct(*fields).alias("item"))
        each = facts.groupBy(*FILE).agg(F.transform(F.array_sort(F.collect_list(first)), lambda x: x["item"]).cast(kind).alias(name))
        rows = rows.join(each, FILE, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    unreadable = F.array(F.struct(F.lit("decoding_error"), F.lit("the file is not UTF-8"), F.lit(None), F.lit(None))).cast(ISSUE)
    rows = rows.withColumn("issues", F.when(F.col("valid"), F.col("issues")).otherwise(unreadable))
    return rows.select(*FILE, "language", parse.parse_status(F.col("issues"), F.col("symbols"), F.col("imports"), F.col("calls")).alias("status"), "source_sha256", *LISTS)


def parse_inventory(files: DataFrame) -> DataFrame:
    """namespace, relative_path, language, status, source_sha256, symbols, imports, calls and issues of the source and test files.

    success: no issues; partial: issues, and something is sound; failed: nothing is. A file in a language without a parser
    has status skipped.
    """
    code = files.filter(F.col("category").isin("source", "test"))
    skipped = code.filter(~F.coalesce(F.col("language").isin(*PARSED), F.lit(False)))
    skipped = skipped.select(*FILE, "language", F.lit("skipped").alias("status"), F.sha2("content", 256).alias("source_sha256"), *[F.array().cast(k).alias(n) for n, k in LISTS.items()])
    tokens = code.filter(F.col("language").isin(*PARSED[1:]))
    return python_files(code.filter("language = 'python'")).unionByName(token_files(tokens)).unionByName(skipped)


def candidates(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Ranges to chunk, apart from each other: leaf symbols, what is left of their parents, what is left of a file.

    files: namespace, relative_path, content. Gaps of white space alone are dropped. Only files whose parse succeeded, at least
    in part, and whose bytes are those that were parsed take part. Of a file with issues nothing is left over: text outside of
    symbols gives no context, and a symbol that an issue touches gives neither itself nor what is left of it; sound symbols within it stay.
    """
    same = files.withColumn("sha", F.sha2("content", 256)).join(parsed.filter("status in ('success', 'partial')").select(*FILE, "status", "source_sha256", "symbols", "issues"), FILE)
    same = same.filter("sha = source_sha256").select(*FILE, "content", "status", F.octet_length("content").cast("bigint").alias("n"), "symbols", "issues")
    symbols = same.select(*FILE, F.posexplode("symbols").alias("id", "s")).select(*FILE, "id", "s.*")
    nested = containment_parents(symbols, FILE)
    found = same.select(*FILE, F.explode("issues").alias("i")).select(*FILE, F.coalesce("i.start", F.lit(0)).cast("bigint").alias("start"), F.coalesce("i.end", F.lit(1 << 60)).cast("bigint").alias("end"))
    spoilt = unsafe(symbols.select(*FILE, "id", "start", "end"), found, FILE).select(*FILE, "id")
    parents = nested.filter("parent is not null").select(*FILE, F.col("parent").alias("id")).distinct()
    sound = nested.join(spoilt, [*FILE, "id"], "left_anti")
    leaves = sound.join(parents, [*FILE, "id"], "left_anti").select(*FILE, F.lit("symbol").alias("kind"), F.col("id").alias("owner"), "start", "end")
    children = nested.filter("parent is not null").select(*FILE, F.col("parent").alias("id"), "start", "end")
    inner_of = sound.join(parents, [*FILE, "id"], "left_semi").select(*FILE, "id", "start", "end")
    inner = residual_gaps(children.join(inner_of.select(*FILE, "id"), [*FILE, "id"], "left_semi"), inner_of, [*FILE, "id"])
    whole = same.filter("status = 'success'").select(*FILE, F.lit(0).cast("bigint").alias("start"), F.col("n").alias("end"))
    outer = residual_gaps(nested.filter("parent is null").join(whole.select(*FILE), FILE, "left_semi").select(*FILE, "start", "end"), whole, FILE)
    gaps = inner.select(*FILE, F.lit("context").alias("kind"), F.col("id").alias("owner"), "start", "end").unionByName(outer.select(*FILE, F.lit("context").alias("kind"), F.lit(None).cast("int").alias("owner"), "start", "end"))
    cut = gaps.join(same.select(*FILE, "content"), FILE).filter(~is_blank(byte_slice(F.col("content"), F.col("start"), F.col("end")).cast("string"))).drop("content")
    owners = symbols.select(*FILE, F.col("id").alias("owner"), F.col("kind").alias("symbol_kind"), "name", "qualified_name", "parent_qualified_name")
    return leaves.unionByName(cut).join(owners, [*FILE, "owner"], "left").drop("owner").withColumnRenamed("name", "symbol_name")


def chunk_inventory(files: DataFrame, parsed: DataFrame, target: int = chunk.TARGET, most: int = chunk.MOST) -> DataFrame:
    """Chunks of the candidates; those over `most` bytes are cut and become fragments."""
    found = candidates(files, parsed)
    held = found.join(files.select(*FILE, "content"), FILE).withColumn("part", byte_slice(F.col("content"), F.col("start"), F.col("end"))).drop("content")
    keys = [*FILE, "kind", "symbol_kind", "symbol_name", "qualified_name", "parent_qualified_name", "base"]
    pieces = chunk.fragments(held.withColumn("base", F.col("start")).drop("start", "end"), "part", keys, target, most)
    rows = pieces.select(
        *FILE, F.when(F.col("fragment_count") > 1, "fragment").otherwise(F.col("kind")).alias("kind"), "symbol_kind", "symbol_name", "qualified_name", "parent_qualified_name",
        (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"), "fragment_index", "fragment_count",
    )
    text = files.select(*FILE, F.col("content").cast("string").alias("content"))
    return chunk.chunk_rows(rows, text, FILE).join(parsed.select(*FILE, "language"), FILE)


def ordered_chunks(chunks: DataFrame) -> DataFrame:
    """The total order of chunks: file, range, kind, symbol, fragment, id."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return chunks.orderBy(*FILE, "start", "end", "kind", text("symbol_kind"), text("qualified_name"), "fragment_index", "chunk_id")


def chunk_statuses(parsed: DataFrame, files: DataFrame, chunks: DataFrame, faults: DataFrame | None = None) -> DataFrame:
    """A row for each parsed file: namespace, relative_path, status, chunks, fault.

    failed: it was not parsed, its bytes changed since, or it has a fault (see `sound_chunks`); skipped: no parser, or nothing
    but white space; else that of the parse.
    """
    made = chunks.groupBy(*FILE).agg(F.count("*").alias("chunks"))
    now = files.select(*FILE, F.sha2("content", 256).alias("now"))
    rows = parsed.select(*FILE, "status", "source_sha256").join(now, FILE, "left").join(made, FILE, "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    rows = rows.join(faults, FILE, "left") if faults is not None else rows.withColumn("fault", F.lit(None).cast("string"))
    stale = ~F.col("now").eqNullSafe(F.col("source_sha256"))
    fault = F.when(stale, "source_changed").otherwise(F.col("fault"))
    status = F.when((F.col("status") == "failed") | fault.isNotNull(), "failed").when((F.col("status") == "skipped") | (F.col("chunks") == 0), "skipped").otherwise(F.col("status"))
    return rows.select(*FILE, status.alias("status"), "chunks", fault.alias("fault"))


def chunk_counters(statuses: DataFrame) -> DataFrame:
    """One row: files by status and all chunks."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_files")
    return statuses.agg(F.count("*").alias("total_files"), n("success"), n("partial"), n("failed"), n("skipped"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("total_chunks"))


def checked_chunks(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """The chunks, after the contract's checks: own ids, safe paths, ranges apart, contents and lines as in the files."""
    counts = asserts.rule_counts(asserts.judged(chunks, files, FILE)).filter("violations > 0").collect()  # a row a rule at most
    if counts:
        raise asserts.ContractViolated("; ".join(f"{r['rule']}: {r['violations']}, as {r['example']}" for r in counts))
    return chunks


def sound_chunks(chunks: DataFrame, files: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks of sound files, and the faults of the others (namespace, relative_path, fault): one file's fault costs no other.

    A file is at fault if a chunk of it breaks a rule, is longer than a provider takes (`text`, where there is one), or if
    its symbols cross each other.
    """
    rules = asserts.judged(chunks, files, FILE).select(*FILE, F.explode("broken").alias("fault"))
    if "text" in chunks.columns:
        rules = rules.unionByName(documents.oversize(chunks).select(*FILE, F.lit("input_too_large").alias("fault")))
    symbols = parsed.select(*FILE, F.inline("symbols")).select(*FILE, "start", "end")
    crossed = crossing(symbols.distinct(), FILE).select(*FILE, F.lit("crossing_symbols").alias("fault"))
    faults = materialize(rules.unionByName(crossed).groupBy(*FILE).agg(F.min("fault").alias("fault")), "chunk-faults")
    return chunks.join(faults, FILE, "left_anti"), faults


def index_repository(spark: SparkSession, path: str, namespace: str, store: index.VectorIndex, provider: Provider) -> dict:
    """Bring a namespace's index to the state of a directory; returns the counters of the synchronisation, and under `parsed`
    and `chunked` those of the two steps before it.

    Every source file must have been parsed, and nothing else; a file at fault is left out and counts as failed.
    """
    files = materialize(scan_repository(spark, path, namespace).files, "files")
    parsed = materialize(parse_inventory(files), "parsed")
    asserts.require_none(chunk.unpaired(files.filter(F.col("category").isin("source", "test")), parsed), "files and parsed files are the same")
    made = materialize(chunk_inventory(files, parsed), "chunks")
    text = documents.embedding_document(F.col("kind"), F.col("language"), F.col("parent_qualified_name"), F.col("qualified_name"), F.col("relative_path"), F.col("symbol_kind"), F.col("content"))
    chunks, faults = sound_chunks(made.withColumn("text", text), files, parsed)
    statuses = chunk_statuses(parsed, files, chunks, faults)
    counters = {"parsed": parse.parse_counters(parsed), "chunked": chunk_counters(statuses)}
    asserts.require_none(asserts.wrong_counters(counters["parsed"], "total_files_requested", ["success_files", "partial_files", "failed_files", "skipped_files"]), "counters add up")
    return index.synchronize(store, namespace, chunks, provider, documents.VERSION) | {k: v.first().asDict() for k, v in counters.items()}
