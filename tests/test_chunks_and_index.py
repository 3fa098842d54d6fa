import json

import pytest
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import chunk, embed, index, intervals, parse, sync, syntax


@pytest.mark.parametrize(
    "data, config, first, count",
    [
        (b"a" * 4096, (4096, 8192), 4096, 1), (b"a" * 8192, (4096, 8192), 8192, 1), (b"a" * 3000 + b"\n" + b"b" * 3000 + b"\n" + b"c" * 3000, (4096, 8192), 3001, 2),
        (b"abcdefg\r\n" * 3, (8, 10), 9, 3), (b"abcdefghi\r\n" * 2, (8, 10), 9, None), (b"", (8, 10), 0, 1),
    ],
)
def test_cut_points(spark, data, config, first, count):
    ends = ends_of(spark, [data], *config)[0]
    assert ends[0] == first and ends[-1] == len(data) and (count is None or len(ends) == count)
    assert all(b - a <= config[1] for a, b in zip([0, *ends], ends))


def ends_of(spark, texts, *config):
    rows = spark.createDataFrame([(k, bytearray(t)) for k, t in enumerate(texts)], "k int, t binary").select("k", chunk.cut_points(F.col("t"), *config).alias("e"))
    return [r["e"] for r in sorted(rows.collect())]


def brute_cuts(data, target, most):
    """The ends by a plain loop over the bytes."""
    at, ends = 0, []
    while len(data) - at > most:
        lines = [p for p in range(at + 1, at + most + 1) if data[p - 1] == 10]
        near = [p for p in lines if p <= at + target]
        hard = at + most - (data[at + most - 1 : at + most + 1] == b"\r\n")
        while data[hard] >> 6 == 2:
            hard -= 1
        at = max(near or lines or [hard])
        ends.append(at)
    return [*ends, len(data)]


def test_cuts_keep_characters(spark):
    data = ("नमस्ते " * 1000).encode()
    ends = ends_of(spark, [data], 16, 31)[0]
    pieces = [data[a:b] for a, b in zip([0, *ends], ends)]
    assert b"".join(pieces) == data and all(p.decode() and len(p) <= 31 for p in pieces)


@pytest.mark.parametrize("config", [(4, 4), (5, 9), (16, 31), (7, 40), (1, 8)])
def test_cuts_of_random_texts(spark, config):
    import random

    deal = random.Random(str(config))
    texts = ["".join(deal.choices(["a", "\n", "\r\n", "\r", "é", "त", "😀"], weights, k=deal.randrange(300))).encode() for weights in ([9, 1, 1, 1, 2, 2, 2], [1, 9, 2, 1, 0, 0, 1], [40, 1, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 1]) for _ in range(40)]
    assert ends_of(spark, texts, *config) == [brute_cuts(t, *config) for t in texts]


def test_fragments_run_in_the_jvm(spark):
    files = spark.createDataFrame([(1, None), (2, "")], "k int, t string")
    pieces = chunk.fragments(files, "t", ["k"])
    assert [tuple(r) for r in pieces.collect()] == [(2, 0, 1, 0, 0)]
    plan = pieces._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_progress_is_an_error(spark):
    with pytest.raises(Exception, match="longer than the largest piece"):
        ends_of(spark, ["😀😀".encode()], 1, 3)


def test_chunk_rows(spark):
    files = spark.createDataFrame([("n", "a.py", "ä\nb\nc"), ("n", "e.py", "")], "namespace string, relative_path string, content string")
    keys = ["namespace", "relative_path"]
    pieces = chunk.fragments(files, "content", keys, 2, 3).withColumn("kind", F.lit("fragment"))
    rows = chunk.chunk_rows(pieces, files, keys).orderBy("relative_path", "start").collect()
    assert [r["content"] for r in rows] == ["ä\n", "b\nc", ""] and rows[1]["start_line"] == 2 and rows[1]["start_column"] == 0 and (rows[1]["end_line"], rows[1]["end_column"]) == (3, 1)
    assert len({r["chunk_id"] for r in rows}) == 3


def test_json_escapes(spark):
    value = 'a"\\\x1f\x0b\n\tüé\x7f'
    assert spark.range(1).select(text.json_string(F.lit(value))).first()[0] == json.dumps(value, ensure_ascii=False)
    assert spark.range(1).select(text.json_string(F.lit("\\u001F}"))).first()[0] == json.dumps("\\u001F}")


@pytest.mark.parametrize("value, blank", [("", True), (" \t\n", True), ("\x1c\x1f", True), ("\u3000", True), ("a", False), ("\ufeff", False)])
def test_blank(spark, value, blank):
    assert spark.range(1).select(text.is_blank(F.lit(value))).first()[0] is blank


def test_bounded_text(spark):
    cut = spark.range(1).select(text.bounded_text(F.lit("  " + "é" * 600 + "\n"))).first()[0]
    assert cut == "é" * 498 + "…"
    assert spark.range(1).select(text.bounded_text(F.lit(" x "))).first()[0] == "x"


def test_intervals(spark):
    rows = [(1, 1, 0, 100), (1, 2, 10, 40), (1, 3, 12, 20), (1, 4, 50, 60), (2, 1, 0, 5), (2, 2, 3, 9), (3, 1, 0, 5), (3, 2, 0, 5)]
    df = spark.createDataFrame(rows, "f int, id int, start long, end long")
    parents = {(r["f"], r["id"]): r["parent"] for r in intervals.containment_parents(df.filter("f = 1"), ["f"]).collect()}
    assert parents == {(1, 1): None, (1, 2): 1, (1, 3): 2, (1, 4): 1}
    assert {(r["f"], r["start"]) for r in intervals.crossing(df, ["f"]).collect()} == {(2, 3), (3, 0)}


PYTHON = '''import os, sys as s
from .a import b as c
from x import *

@deco(1)
class A(Base):
    LIMIT = 3

    def __init__(self):
        self.y = f(1)

    async def run(self, n=g()):
        def inner():
            return h()
        return inner

TOP = k()

def ä():
    pass
'''


def test_python_facts():
    status, symbols, imports, calls, issues = parse.python_facts(PYTHON.encode())
    assert status == "success" and not issues
    assert [(s[0], s[2]) for s in symbols] == [
        ("class", "A"), ("constant", "A.LIMIT"), ("constructor", "A.__init__"), ("method", "A.run"), ("function", "A.run.inner"), ("constant", "TOP"), ("function", "ä"),
    ]
    data = PYTHON.encode()
    assert data[symbols[0][4] :].startswith(b"class A") and data[symbols[-1][4] : symbols[-1][5]] == "def ä():\n    pass".encode()
    assert imports[0][:4] == ("os", None, None, False) and imports[2][:3] == (".a", "b", "c") and imports[3][3]
    assert [(c[0], c[1]) for c in calls] == [(None, "deco"), ("A.__init__", "f"), ("A.run", "g"), ("A.run.inner", "h"), (None, "k")]
    marked = parse.python_facts(b"\xef\xbb\xbf" + data)
    assert marked[1][0][4] == symbols[0][4] + 3


@pytest.mark.parametrize("data, kind", [(b"def f(:", "syntax_error"), (b"\xff\xfe", "decoding_error"), (b"a\x00", "syntax_error")])
def test_broken_python(data, kind):
    status, symbols, _, _, issues = parse.python_facts(data)
    assert status == "failed" and not symbols and issues[0][0] == kind


def test_declarations(spark):
    source = 'export class A {\n  m() { return "}"; }\n}\nfunction f(x) { const y = `{`; }\ninterface E { a(): void }\nclass Broken {\n'
    df = spark.createDataFrame([("a.ts", "typescript", source), ("b.ts", "typescript", "")], "relative_path string, language string, content string")
    facts = syntax.facts(df, ["relative_path"])
    rows = {(r["kind"], r["name"]): source[r["start"] : r["end"]] for r in facts.symbols.collect()}
    assert rows[("class", "A")].endswith('"}"; }\n}') and rows[("function", "f")].endswith("`{`; }") and ("interface", "E") in rows and ("class", "Broken") not in rows
    assert [r["kind"] for r in facts.issues.collect()] == ["missing_node"]


def test_retry_rules(spark):
    assert embed.retry_delays(6)[:4] == [0.25, 0.5, 1.0, 2.0]
    statuses = spark.createDataFrame([(s,) for s in (200, 400, 401, 403, 408, 413, 429, 500, 503)], "s int")
    got = [r[0] for r in statuses.select(embed.http_error_class(F.col("s"))).collect()]
    assert got == [None, "invalid_request", "authentication", "authentication", "transient", "input_too_large", "rate_limit", "transient", "transient"]


def test_retries():
    waits, left = [], [embed.RateLimited(), embed.Transient(), 7]

    def call():
        x = left.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert embed.with_retries(call, sleep=waits.append) == 7 and waits == [0.25, 0.5]
    with pytest.raises(embed.Transient):
        embed.with_retries(lambda: (_ for _ in ()).throw(embed.Transient()), sleep=waits.append)


def chunks_of(spark, items):
    df = spark.createDataFrame(items, "relative_path string, content string")
    return df.select(F.sha2("relative_path", 256).alias("chunk_id"), F.sha2("content", 256).alias("content_hash"), "relative_path", "content", F.col("content").alias("text"))


def test_index_lifecycle(spark, tmp_path):
    store, provider = index.VectorIndex(spark, str(tmp_path / "index")), embed.HashProvider(3)
    with pytest.raises(index.NotIndexed):
        index.search(store, "n", "q", 3, provider)
    first = chunks_of(spark, [("a.py", "one"), ("b.py", "two"), ("c.py", "three")])
    assert index.synchronize(store, "n", first, provider)["inserted_chunks"] == 3
    generation = store.active("n")["generation"]
    assert index.synchronize(store, "n", first, provider)["status"] == "unchanged" and store.active("n")["generation"] == generation
    assert index.search(store, "n", "two", 2, provider)[0]["relative_path"] == "b.py"
    with store.reading("n") as (_, rows):
        counters = index.synchronize(store, "n", chunks_of(spark, [("a.py", "one!"), ("b.py", "two"), ("d.py", "four")]), provider)
        assert rows.count() == 3  # the old generation stays while it is read
    assert (counters["reused_chunks"], counters["updated_chunks"], counters["inserted_chunks"], counters["deleted_chunks"]) == (1, 1, 1, 1)
    assert len(list(store.home("n").glob("generation-*"))) == 1
    assert index.synchronize(store, "n", first.limit(0), provider)["deleted_chunks"] == 3
    assert index.search(store, "n", "two", 2, provider) == []
    with store.writer("n"), pytest.raises(index.IndexBusy), store.writer("n"):
        pass
    index.synchronize(store, "m", first, provider)
    assert store.delete("n") and not store.delete("n") and store.active("m")["rows"] == 3
    pointer = store.home("m") / "active.json"
    pointer.write_text(pointer.read_text().replace('"rows": 3', '"rows": 4'))
    with pytest.raises(index.IndexCorrupt):
        store.active("m")


def test_another_identity_embeds_all(spark, tmp_path):
    store = index.VectorIndex(spark, str(tmp_path / "index"))
    first = chunks_of(spark, [("a.py", "one"), ("b.py", "two")])
    index.synchronize(store, "n", first, embed.HashProvider(3))
    assert index.synchronize(store, "n", first, embed.HashProvider(4))["updated_chunks"] == 2


@pytest.mark.parametrize("k, query", [(0, "x"), (101, "x"), (True, "x"), (1, "  "), (1, "x" * 16_385)])
def test_bad_requests(spark, tmp_path, k, query):
    with pytest.raises(ValueError):
        index.search(index.VectorIndex(spark, str(tmp_path)), "n", query, k, embed.HashProvider(3))


def test_diff_of_two_hundred(spark):
    side = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("chunk_id"), F.lit("h").alias("content_hash"))
    counts = {r["class"]: r["count"] for r in sync.sync_diff(side(0, 200), side(100, 300)).groupBy("class").count().collect()}
    assert counts == {"unchanged": 100, "new": 100, "deleted": 100}


def test_known_vectors_are_kept(spark):
    """One pass embeds what has no vector and keeps what has one, whose text isn't sent."""
    from cairn.operators.embed import HashProvider, embed

    provider = HashProvider(2)
    rows = spark.createDataFrame([(1, "a", None), (2, None, [0.25, 0.5]), (3, "c", None)], "id int, text string, v array<float>").coalesce(1)
    got = {r["id"]: r["embedding"] for r in embed(rows, provider, known=F.col("v")).collect()}
    assert got[2] == [0.25, 0.5] and all(got[k] == pytest.approx(provider.embed_query(t)) for k, t in ((1, "a"), (3, "c")))
