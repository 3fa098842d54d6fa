"""The files under a directory as a DataFrame: listed and read by executors, no name skipped, no link followed."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.scan import IGNORED_DIRECTORIES
from cairn.session import materialize

#: Entries that a task lists below one directory before it leaves the directories still to be seen to the next job.
ENTRIES = 20_000
FILES, BYTES = 512, 64 << 20
ENTRY = "outcome string, relative_path string, size_bytes bigint, identity string"
ENTRY_FIELDS = pa.schema([("outcome", pa.string()), ("relative_path", pa.string()), ("size_bytes", pa.int64()), ("identity", pa.string())])


def opened(root: str, path: str, flags: int = 0) -> int:
    """A descriptor of what lies at a path under root, gone to part by part; a link on the way or at the end is an OSError."""
    fd = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
    parts = path.split("/") if path else []
    for k, part in enumerate(parts):
        try:
            inner = os.open(part, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK | (flags if k == len(parts) - 1 else os.O_DIRECTORY), dir_fd=fd)
        finally:
            os.close(fd)
        fd = inner
    return fd


def identity_of(found: os.stat_result) -> str:
    return f"{found.st_dev}:{found.st_ino}"


def walk(root: str, ignored=frozenset(IGNORED_DIRECTORIES), start: str = "", most: int | None = None) -> Iterator[tuple[str, str, int, str | None]]:
    """(outcome, relative path, size, identity) of the entries below a directory: file, symlink, unreadable, or a directory's
    ignored_directory, symlink_directory or unreadable_directory.

    After `most` entries no further directory is begun; those left are given with outcome open. The first one always is.
    """
    todo, seen = [start], 0
    while todo:
        at = todo.pop()
        if most is not None and seen >= most:
            yield "open", at, 0, None
            continue
        try:
            fd = opened(root, at, os.O_DIRECTORY)
        except OSError:
            yield "unreadable_directory", at, 0, None
            continue
        try:
            with os.scandir(fd) as entries:
                for e in entries:
                    path, seen = f"{at}/{e.name}" if at else e.name, seen + 1
                    if e.is_symlink():
                        try:
                            yield ("symlink_directory" if e.is_dir() else "symlink"), path, 0, None
                        except OSError:
                            yield "symlink", path, 0, None
                    elif e.is_dir(follow_symlinks=False):
                        if e.name.casefold() in ignored:
                            yield "ignored_directory", path, 0, None
                        else:
                            todo.append(path)
                    else:
                        try:
                            found = e.stat(follow_symlinks=False)
                            yield "file", path, found.st_size, identity_of(found)
                        except OSError:
                            yield "unreadable", path, 0, None
        except OSError:
            yield "unreadable_directory", at, 0, None
        finally:
            os.close(fd)


def read_inside(root: str, path: str, most: int, identity: str | None = None) -> bytes | None:
    """The bytes of a regular file of at most `most` bytes under root, opened without following links.

    None if it isn't one, can't be read, is not the file of that identity any more, or changes while it is read.
    """
    try:
        with os.fdopen(opened(root, path), "rb") as f:
            before = os.fstat(f.fileno())
            if not stat.S_ISREG(before.st_mode) or before.st_size > most or identity not in (None, identity_of(before)):
                return None
            data = f.read(most + 1)
            after = os.fstat(f.fileno())
            return data if len(data) == before.st_size and (before.st_size, before.st_mtime_ns) == (after.st_size, after.st_mtime_ns) else None
    except OSError:
        return None


def positive(name: str, value: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} must be a positive integer")
    return value


def directory_entries(spark: SparkSession, root: str, entries_per_task: int = ENTRIES) -> DataFrame:
    """outcome, relative_path, size_bytes and identity of all entries under a directory that all executors see.

    A frontier of directories is expanded job by job: a task lists what lies below a directory, up to a number of entries, and
    leaves the rest to the next job. Each job's entries are written down, so a directory is read once for all that follows;
    the driver knows but how many directories are left. A small tree is one job.
    """
    most = positive("entries_per_task", entries_per_task)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column(0).to_pylist():
                rows = []
                for row in walk(root, start=at, most=most):
                    rows.append(dict(zip(ENTRY_FIELDS.names, row, strict=True)))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, ENTRY_FIELDS)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ENTRY_FIELDS)

    left, frontier, levels = 1, spark.range(1).select(F.lit("").alias("relative_path")), []
    while left:
        level = materialize(frontier.repartition(min(left, tasks)).mapInArrow(expand, ENTRY), "scan-level")
        levels.append(level.filter("outcome <> 'open'"))
        frontier = level.filter("outcome = 'open'").select("relative_path")
        left = frontier.count()
    return reduce(DataFrame.unionByName, levels)


def repository_files(
    spark: SparkSession, path: str, namespace: str | None = None, wanted: Column | None = None, max_file_bytes: int = 1_000_000, files_per_task: int = FILES, entries_per_task: int = ENTRIES
) -> DataFrame:
    """namespace, relative_path, outcome, size_bytes and content of all entries under a directory.

    content is that of files of at most max_file_bytes for which `wanted` holds, a condition on relative_path and size_bytes:
    it is asked before anything is opened, so what it leaves out is never read. A file that can't be read, or is another than
    was listed, has outcome unreadable.
    """
    root = os.path.realpath(path)
    most, per_task = positive("max_file_bytes", max_file_bytes), positive("files_per_task", files_per_task)
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    entries = directory_entries(spark, root, entries_per_task)
    ask = F.coalesce((F.col("outcome") == "file") & (F.col("size_bytes") <= most) & (wanted if wanted is not None else F.lit(True)), F.lit(False))
    total = entries.filter(ask).agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, -(-total["n"] // per_task), -(-total["bytes"] // BYTES))
    fields = pa.schema([*list(ENTRY_FIELDS)[:3], ("content", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for e in b.to_pylist():
                data = read_inside(root, e["relative_path"], most, e["identity"])
                rows.append({"outcome": "unreadable" if data is None else "file", "relative_path": e["relative_path"], "size_bytes": e["size_bytes"], "content": data})
                size += len(data or b"")
                if size > BYTES // 8:
                    yield pa.RecordBatch.from_pylist(rows, fields)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, fields)

    contents = entries.filter(ask).repartition(tasks).mapInArrow(read, "outcome string, relative_path string, size_bytes bigint, content binary")
    others = entries.filter(~ask).select("outcome", "relative_path", "size_bytes", F.lit(None).cast("binary").alias("content"))
    return contents.unionByName(others).select(F.lit(namespace or root).alias("namespace"), "relative_path", "outcome", "size_bytes", "content")
