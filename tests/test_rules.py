"""What issues forbid, faults that stay with their file, and rules of chunks."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.operators import asserts, intervals, lines
from cairn.plans import code_index as ci

SYMBOL = "array<struct<kind:string,name:string,qualified_name:string,parent_qualified_name:string,start:bigint,end:bigint>>"
ISSUE = "array<struct<kind:string,message:string,start:bigint,end:bigint>>"


def ranges(spark, source, symbols, issues, status="partial"):
    rows = [("n", "a.py", bytearray(source.encode()), status, [(k, q.split(".")[-1], q, None, a, b) for k, q, a, b in symbols], [("syntax_error", "", a, b) for a, b in issues])]
    df = spark.createDataFrame(rows, f"namespace string, relative_path string, content binary, status string, symbols {SYMBOL}, issues {ISSUE}")
    parsed = df.withColumn("source_sha256", F.sha2("content", 256)).drop("content")
    return sorted((r["kind"], r["start"], r["end"]) for r in ci.candidates(df.select("namespace", "relative_path", "content"), parsed).collect())


def test_what_an_issue_forbids(spark):
    text, outer, method = "0123456789abcdefghij", ("class", "Outer", 0, 20), ("method", "Outer.m", 5, 15)
    assert ranges(spark, text, [outer, method], [(1, 2)]) == [("symbol", 5, 15)]
    assert ranges(spark, text, [outer, method], [(7, 7)]) == []
    assert ranges(spark, text + "XXXXX", [outer, method], [(21, 22)]) == [("context", 0, 5), ("context", 15, 20), ("symbol", 5, 15)]
    assert ranges(spark, text + "XXXXX", [outer, method], [], "success") == [("context", 0, 5), ("context", 15, 20), ("context", 20, 25), ("symbol", 5, 15)]
    assert ranges(spark, text, [], [], "failed") == []


def test_faults_stay_with_their_file(spark):
    files = spark.createDataFrame([("n", p, bytearray(c)) for p, c in [("a.py", b"def f():\n  pass\n"), ("b.py", b"def g():\n  pass\n"), ("c.py", b"def h():\n  pass\n")]], "namespace string, relative_path string, content binary")
    files = files.withColumn("category", F.lit("source")).withColumn("language", F.lit("python"))
    parsed = ci.parse_inventory(files)
    made = ci.chunk_inventory(files, parsed).withColumn("text", F.when(F.col("relative_path") == "c.py", F.repeat(F.lit("x"), 2000)).otherwise("t"))
    made = made.withColumn("start_line", F.when(F.col("relative_path") == "b.py", F.col("start_line") + 1).otherwise(F.col("start_line")))
    chunks, faults = ci.sound_chunks(made, files, parsed)
    assert {r["relative_path"] for r in chunks.collect()} == {"a.py"}
    assert {(r["relative_path"], r["status"], r["fault"]) for r in ci.chunk_statuses(parsed, files, chunks, faults).collect()} == {("a.py", "success", None), ("b.py", "failed", "wrong_location"), ("c.py", "failed", "input_too_large")}


def test_every_rule_in_one_pass(spark):
    files = spark.createDataFrame([("n", "a.py", "ab\ncd\nef"), ("n", "../b.py", "x")], "namespace string, relative_path string, content string")
    good = [("1", "n", "a.py", 0, 3, "ab\n"), ("2", "n", "a.py", 3, 8, "cd\nef"), ("3", "n", "../b.py", 0, 1, "x")]
    bad = [("2", "n", "a.py", 1, 2, "b"), ("4", "n", "a.py", 6, 8, "no"), ("5", "n", "gone.py", 0, 1, "x")]
    rows = spark.createDataFrame(good + bad, "chunk_id string, namespace string, relative_path string, start bigint, end bigint, content string")
    located = lines.with_locations(rows, lines.line_table(files, ci.FILE), ci.FILE).withColumn("content_hash", F.sha2("content", 256))
    counts = {r["rule"]: (r["violations"], r["example"]) for r in asserts.rule_counts(asserts.judged(located, files, ci.FILE)).collect()}
    assert counts == {"repeated_id": (2, "2"), "unsafe_path": (1, "3"), "overlap": (2, "2"), "wrong_slice": (2, "4"), "wrong_location": (0, None)}
    moved = located.withColumn("end_column", F.col("end_column") + 1)
    assert asserts.wrong_chunks(moved.filter("chunk_id = '1'"), files, ci.FILE).count() == 1
    with pytest.raises(asserts.ContractViolated):
        ci.checked_chunks(located, files)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    """Containment, touched ranges and lines against brute force, over nested ranges of several files."""
    rng = random.Random(seed)

    def nest(a, b, out):
        out.append((a, b))
        at = a
        while at < b and rng.random() < 0.8:
            x = rng.randint(at, b)
            y = rng.randint(x, b)
            if (x, y) != (a, b):
                nest(x, y, out)
            at = y + 1
        return out

    rows, issues, texts = [], [], []
    for f in range(4):
        rows += [(f, k, a, b) for k, (a, b) in enumerate(sorted(set(nest(0, 300, [])), key=lambda r: (r[0], -r[1])))]
        issues += [(f, a, a + rng.choice([0, 0, 1, 9])) for a in rng.sample(range(300), 5)]
        texts.append((f, "".join(rng.choice("ab\né") for _ in range(300))))
    df = spark.createDataFrame(rows, "file int, id int, start bigint, end bigint")
    holds = lambda o, r: o[0] == r[0] and o[1] != r[1] and o[2] <= r[2] and r[3] <= o[3] and o[3] > r[2] and (o[2:] != r[2:] or o[1] < r[1])
    want = {(r[0], r[1], *([min((o for o in rows if holds(o, r)), key=lambda o: (o[3] - o[2], -o[1]))[1]] if any(holds(o, r) for o in rows) else [None])) for r in rows}
    assert {(r["file"], r["id"], r["parent"]) for r in intervals.containment_parents(df, ["file"]).collect()} == want
    found = intervals.unsafe(df, spark.createDataFrame(issues, "file int, start bigint, end bigint"), ["file"])
    assert sorted((r["file"], r["id"]) for r in found.collect()) == sorted((r[0], r[1]) for r in rows if any(i[0] == r[0] and r[2] < max(i[2], i[1] + 1) and i[1] < r[3] for i in issues))
    table = lines.line_table(spark.createDataFrame(texts, "file int, content string"), ["file"])
    data = {f: t.encode() for f, t in texts}
    for r in lines.with_locations(df, table, ["file"]).collect():
        for at, line, column in ((r["start"], r["start_line"], r["start_column"]), (r["end"], r["end_line"], r["end_column"])):
            head = data[r["file"]][:at]
            assert (line, column) == (head.count(b"\n") + 1, at - (head.rfind(b"\n") + 1))


def test_folding_is_casefold(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, points[k : k + 4096])) for k in range(0, len(points), 4096)] + ["Straße/İx", "", "ﬃ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["f"] for r in df.select("t", paths.folded(F.col("t")).alias("f")).collect()] == [t.casefold() for t in texts]


def test_inventories_have_an_order(spark):
    names = ["b.py", "A.py", "a.py", "STRASSE.py", "straße.py", "Z/a.py", "z/A.py", "é.py", "É.py"]
    rows = spark.createDataFrame([("n", p, "r") for p in names], "namespace string, relative_path string, reason string").repartition(5)
    got = ci.ordered_inventory(ci.Inventory(rows, rows, rows))
    for part in (got.files, got.ignored, got.skipped_dirs):
        assert [r["relative_path"] for r in part.collect()] == sorted(names, key=lambda p: (p.casefold(), p))


def test_modifiers_are_lowered_once(spark):
    """The list is lowered once a row, not once a modifier; nulls and repeated words change nothing."""
    from pyspark.sql import functions as F

    from cairn.functions.text import normalized_modifiers

    rows = spark.createDataFrame([(1, ["STATIC", "x", None, "public", "static"]), (2, None), (3, [])], "id int, w array<string>")
    found = rows.select("id", normalized_modifiers(F.col("w")).alias("m"))
    assert {r["id"]: r["m"] for r in found.collect()} == {1: ["public", "static"], 2: [], 3: []}
    assert "array_contains" not in found._jdf.queryExecution().optimizedPlan().toString()
