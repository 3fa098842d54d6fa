"""Broken files, members and statuses, beyond what the query catalogue holds."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import embed, index, parse
from cairn.plans import code_index


def test_broken_python_gives_what_stands_before(spark):
    source = b"import a\n\ndef f():\n    return g()\n\ndef h(:\n    pass\n"
    status, symbols, imports, calls, issues = parse.python_facts(source)
    assert (status, [s[1] for s in symbols], [i[0] for i in imports], [c[1] for c in calls]) == ("partial", ["f"], ["a"], ["g"])
    assert issues == [("syntax_error", "SyntaxError", source.index(b"def h"), len(source))]
    assert parse.python_facts(b"def (")[0] == "failed" and parse.python_facts(b"\xff")[4][0][0] == "decoding_error"
    assert parse.python_facts("\ufeff\ufeffx = 1".encode())[0] == "failed"


def test_statuses_and_counters(spark):
    files = spark.createDataFrame([("n", p, bytearray(c)) for p, c in [("a.py", b"x = 1\n"), ("b.py", b"def f(:\n"), ("c.go", b"package c"), ("d.py", b"def f():\n  pass\n\ndef g(:\n")]], "namespace string, relative_path string, content binary")
    files = files.withColumn("category", F.lit("source")).withColumn("language", F.when(F.col("relative_path").endswith("py"), "python").otherwise("go"))
    parsed = code_index.parse_inventory(files)
    chunks = code_index.chunk_inventory(files, parsed)
    statuses = code_index.chunk_statuses(parsed, files, chunks)
    assert {(r["relative_path"], r["status"]) for r in statuses.collect()} == {("a.py", "success"), ("b.py", "failed"), ("c.go", "skipped"), ("d.py", "partial")}
    counted = code_index.chunk_counters(statuses).first()
    assert (counted["total_files"], counted["partial_files"], counted["total_chunks"]) == (4, 1, chunks.count())
    ordered = [(r["relative_path"], r["start"]) for r in code_index.ordered_chunks(code_index.checked_chunks(chunks, files)).collect()]
    assert ordered == sorted(ordered)


def test_candidates_stay_until_published_and_counts_must_agree(spark, tmp_path):
    store, provider = index.VectorIndex(spark, str(tmp_path)), embed.HashProvider(3)
    text = spark.createDataFrame([("c1", "a"), ("c2", "b")], "id string, content string")
    chunks = text.select(F.sha2("id", 256).alias("chunk_id"), F.sha2("content", 256).alias("content_hash"), F.concat("id", F.lit(".py")).alias("relative_path"), "content", F.col("content").alias("text"))
    index.synchronize(store, "n", chunks, provider)
    candidate = store.begin("n")
    (store.home("n") / candidate).mkdir()
    with store.reading("n"):
        pass
    assert (store.home("n") / candidate).is_dir()
    store.abort("n", candidate)
    assert not (store.home("n") / candidate).exists()
    rows = embed.embed(chunks.limit(1).withColumn("namespace", F.lit("n")), provider)
    rows.write.parquet(str(store.home("n") / candidate))
    with pytest.raises(index.IndexCorrupt):
        store.publish("n", candidate, index.identity_of(provider, "v1"), expected=2)


def test_modifiers():
    _, symbols, *_ = parse.python_facts(b"async def f():\n    def g(): pass\nclass A:\n    async def m(self): pass\n")
    assert {s[2]: s[-1] for s in symbols} == {"f": ("async",), "f.g": (), "A": (), "A.m": ("async",)}
