"""An index of vectors: immutable generations of Parquet, published by a pointer file."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import shutil
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.paths import path_order
from cairn.functions.text import content_hash
from cairn.operators.embed import Provider, embed, vector_valid
from cairn.operators.search import cosine_distance, score_of
from cairn.operators.sync import sync_counters, sync_diff

SCHEMA_VERSION = "cairn-index-v1"


class IndexCorrupt(Exception):
    pass


class IndexBusy(Exception):
    pass


class NotIndexed(Exception):
    pass


class VectorIndex:
    """Generations under a root on a file system that the driver and all executors share.

    A namespace's folder is the SHA-256 of its name. A new generation is written whole, read again and checked, then the
    pointer is replaced in one step. Readers hold the generation they began with; what nobody holds is removed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.readers, self.writing = spark, Path(root), {}, set()
        self.root.mkdir(parents=True, exist_ok=True)

    def home(self, namespace: str) -> Path:
        if not namespace:
            raise ValueError("a namespace is needed")
        return self.root / hashlib.sha256(namespace.encode()).hexdigest()

    @contextmanager
    def writer(self, namespace: str):
        """One writer a namespace; a second one fails at once."""
        home = self.home(namespace)
        home.mkdir(exist_ok=True)
        with (home / "lock").open("w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                raise IndexBusy(namespace) from e
            yield

    def active(self, namespace: str) -> dict | None:
        """The pointer's payload, checked; None if the namespace was never indexed."""
        path = self.home(namespace) / "active.json"
        if not path.exists():
            return None
        try:
            p = json.loads(path.read_text())
            body = json.dumps(p["payload"], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            good = set(p) == {"payload", "sha256"} and hashlib.sha256(body.encode()).hexdigest() == p["sha256"]
            payload = p["payload"]
            good = good and payload["namespace"] == namespace and payload["schema_version"] == SCHEMA_VERSION
        except (ValueError, KeyError, TypeError) as e:
            raise IndexCorrupt(str(path)) from e
        if not good or not (self.home(namespace) / payload["generation"]).is_dir():
            raise IndexCorrupt(str(path))
        return payload

    def read(self, namespace: str, payload: dict) -> DataFrame:
        return self.spark.read.parquet(str(self.home(namespace) / payload["generation"]))

    @contextmanager
    def reading(self, namespace: str):
        """(payload, rows) of the active generation, which stays until the block ends."""
        payload = self.active(namespace)
        if payload is None:
            raise NotIndexed(namespace)
        key = (namespace, payload["generation"])
        self.readers[key] = self.readers.get(key, 0) + 1
        try:
            yield payload, self.read(namespace, payload)
        finally:
            self.readers[key] -= 1
            if not self.readers[key]:
                del self.readers[key]
                try:
                    with self.writer(namespace):
                        self.vacuum(namespace)
                except IndexBusy:  # the writer removes what is left
                    pass

    def check(self, rows: DataFrame, namespace: str, dimensions: int) -> int:
        """Count of the rows; fails if one is wrong."""
        bad = (F.col("namespace") != namespace) | ~F.col("chunk_id").rlike("^[0-9a-f]{64}$") | (content_hash(F.col("content")) != F.col("content_hash")) | ~vector_valid(F.col("embedding"), dimensions)
        n, ids, wrong = rows.agg(F.count("*"), F.count_distinct("chunk_id"), F.count_if(F.coalesce(bad, F.lit(True)))).first()
        if wrong or ids != n:
            raise IndexCorrupt(f"{wrong} wrong rows, {n - ids} repeated ids")
        return n

    def begin(self, namespace: str) -> str:
        """The name of a new generation, which is kept until it is published or aborted."""
        generation = f"generation-{uuid.uuid4().hex}"
        self.writing.add(generation)
        return generation

    def publish(self, namespace: str, generation: str, identity: dict, expected: int | None = None) -> dict:
        """Check the written generation, also against the count of rows expected, and make it the active one, in one step."""
        rows = self.spark.read.parquet(str(self.home(namespace) / generation))
        n = self.check(rows, namespace, identity["dimensions"])
        if expected is not None and n != expected:
            raise IndexCorrupt(f"{n} rows were written, {expected} expected")
        payload = {"schema_version": SCHEMA_VERSION, "namespace": namespace, "generation": generation, "rows": n, "identity": identity}
        body = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        path = self.home(namespace) / "active.json"
        tmp = path.with_suffix(f".{uuid.uuid4().hex}")
        with tmp.open("w") as f:
            json.dump({"payload": payload, "sha256": hashlib.sha256(body.encode()).hexdigest()}, f, ensure_ascii=False)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
        if self.active(namespace) != payload:
            raise IndexCorrupt("the pointer is not what was published")
        self.writing.discard(generation)
        self.vacuum(namespace)
        return payload

    def abort(self, namespace: str, generation: str) -> None:
        self.writing.discard(generation)
        active = self.active(namespace)
        if not active or active["generation"] != generation:
            shutil.rmtree(self.home(namespace) / generation, ignore_errors=True)

    def vacuum(self, namespace: str) -> None:
        active = self.active(namespace)
        for d in self.home(namespace).glob("generation-*"):
            if (not active or d.name != active["generation"]) and (namespace, d.name) not in self.readers and d.name not in self.writing:
                shutil.rmtree(d, ignore_errors=True)

    def delete(self, namespace: str) -> bool:
        """Remove the namespace's index; fails while it is read. False if there was none."""
        with self.writer(namespace):
            if any(ns == namespace for ns, _ in self.readers):
                raise IndexBusy(namespace)
            there = self.active(namespace) is not None
            (self.home(namespace) / "active.json").unlink(missing_ok=True)
            self.vacuum(namespace)
            return there


def identity_of(provider: Provider, document_version: str) -> dict:
    return {"provider": provider.provider, "model": provider.model, "dimensions": provider.dimensions, "compatibility_version": provider.compatibility_version, "document_version": document_version}


#: What a chunk may say of itself beside its content; kept with it and given with every hit.
ABOUT = ("language", "kind", "symbol_kind", "qualified_name", "parent_qualified_name", "start_line", "end_line")


def synchronize(index: VectorIndex, namespace: str, chunks: DataFrame, provider: Provider, document_version: str = "v1") -> dict:
    """Bring a namespace's index to the given chunks: (chunk_id, content_hash, relative_path, content, text), and any columns of ABOUT.

    Only new and changed chunks are embedded. Nothing is written if nothing changed. Returns the counters and the status.
    """
    identity = identity_of(provider, document_version)
    columns = ["namespace", "chunk_id", "content_hash", "relative_path", "content", *[c for c in ABOUT if c in chunks.columns], "embedding"]
    with index.writer(namespace):
        active = index.active(namespace)
        empty = chunks.limit(0).select("chunk_id", "content_hash")
        stored = index.read(namespace, active) if active else None
        compatible = bool(active) and active["identity"] == identity
        diff = sync_diff(chunks, stored if active else empty, compatible).persist()
        try:
            counters = sync_counters(diff).first().asDict()
            if active and counters["status"] == "unchanged":
                return counters
            counters["status"] = "success"
            # Contents are dealt once at most: not at all where every chunk is embedded. A kept chunk keeps its vector alone.
            rows, known = chunks.withColumn("namespace", F.lit(namespace)), None
            if compatible:
                kept = stored.select("chunk_id", "embedding").join(diff.filter("class = 'unchanged'").select("chunk_id"), "chunk_id", "left_semi")
                rows = rows.drop("embedding").join(kept.withColumnRenamed("embedding", "__known"), "chunk_id", "left").withColumn("text", F.when(F.col("__known").isNull(), F.col("text")))
                known = F.col("__known")
            rows = embed(rows, provider, known=known).select(*columns)
            generation = index.begin(namespace)
            try:
                rows.write.parquet(str(index.home(namespace) / generation))
                index.publish(namespace, generation, identity, counters["total_chunks"])
            except Exception:
                index.abort(namespace, generation)
                raise
            return counters
        finally:
            diff.unpersist()


def search(index: VectorIndex, namespace: str, query: str, k: int, provider: Provider, document_version: str = "v1") -> list[dict]:
    """The k chunks nearest to the query: by score, then folded path, path and id. A wrong row fails the whole query."""
    if not namespace or not query.strip() or len(query) > 16_384 or isinstance(k, bool) or not 1 <= k <= 100:
        raise ValueError("namespace, a query of at most 16384 characters and 1 <= k <= 100 are needed")
    with index.reading(namespace) as (payload, rows):
        if payload["identity"] != identity_of(provider, document_version):
            raise ValueError("the index was built by another provider or document version")
        if not payload["rows"]:
            return []
        q = F.array(*[F.lit(float(x)).cast("float") for x in provider.embed_query(query)])
        good = (F.col("namespace") == namespace) & (content_hash(F.col("content")) == F.col("content_hash")) & vector_valid(F.col("embedding"), provider.dimensions)
        checked = F.when(good, cosine_distance(F.col("embedding"), q)).otherwise(F.raise_error(F.lit("a stored row is wrong")).cast("double"))
        best = rows.select("chunk_id", "relative_path", "content", *[c for c in ABOUT if c in rows.columns], score_of(checked).alias("score"))
        return [r.asDict() for r in best.orderBy(F.desc("score"), *path_order(F.col("relative_path")), "chunk_id").limit(k).collect()]
