import os

import pytest
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.functions.text import readable_size
from cairn.operators import scan
from cairn.sources.files import directory_entries, read_inside, repository_files, walk


def reasons(spark, rows, most=1_000_000):
    df = spark.createDataFrame(rows, "relative_path string, size_bytes long")
    return {r[0]: r[1] for r in df.select("relative_path", scan.ignore_reason(F.col("relative_path"), F.col("size_bytes"), most)).collect()}


@pytest.mark.parametrize(
    "name, reason",
    [
        (".env", "sensitive_file"), (".env.production", "sensitive_file"), ("APP.ENV", "sensitive_file"), ("app.env.local", "sensitive_file"), ("private.pem", "sensitive_file"),
        ("ID_RSA", "sensitive_file"), ("credentials.json", "sensitive_file"), (".env.example", None), (".ENV.SAMPLE", None), ("app.env.template", None), ("YARN.LOCK", "lockfile"),
        ("STYLES.MIN.CSS", "minified"), ("logo.png", "unsupported_type"), ("diagram.svg", "unsupported_type"), (".py", None), ("README.md", None), ("Makefile", None),
    ],
)
def test_reason(spark, name, reason):
    assert reasons(spark, [(name, 1)]) == {name: reason}


def test_size_limit_keeps_equal(spark):
    assert reasons(spark, [("a.py", 10), ("b.py", 11)], 10) == {"a.py": None, "b.py": "too_large"}


@pytest.mark.parametrize(
    "path, language, category",
    [
        ("src/app.py", "python", "source"), ("src/types.h", "c/cpp", "source"), ("Dockerfile", "dockerfile", "build"), ("README.md", None, "documentation"),
        ("latest.py", "python", "test"), ("contest.py", "python", "test"), ("tests/data.json", None, "test"), ("a/migrations/1.txt", None, "database"), ("q.sql", "sql", "database"),
        ("conf.toml", None, "config"), (".gitignore", None, "config"), ("x/util.test.ts", "typescript", "test"), ("LICENSE", None, "documentation"), ("notes.txt", None, "other_text"),
        ("pkg/test_a.go", "go", "test"), ("package.json", None, "build"), ("app.env.example", None, "config"), ("Makefile", "make", "build"),
    ],
)
def test_language_and_category(spark, path, language, category):
    row = spark.range(1).select(scan.language(F.lit(path)), scan.category(F.lit(path)), paths.suffix(paths.filename(F.lit(path)))).first()
    assert tuple(row)[:2] == (language, category)


@pytest.mark.parametrize(
    "sample, binary",
    [
        (b"", False), (b"\x01" * 3 + b"a" * 7, False), (b"\x01" * 4 + b"a" * 6, True), (b"a\x00b", True), ("é".encode("utf-16"), False), (b"\xff\xfea", True),
        (b"caf\xe9 au lait", False), (b"\xef\xbb\xbfabc\xc3", True), (b"\xe9" + b"\x02" * 9, True), ("‍‍a".encode(), False),
    ],
)
def test_binary(spark, sample, binary):
    assert spark.createDataFrame([(bytearray(sample),)], "s binary").select(scan.is_binary(F.col("s"))).first()[0] is binary


@pytest.mark.parametrize(
    "url, normalized",
    [
        ("https://github.com/o/r", "https://github.com/o/r"), ("https://github.com/o/r.git", "https://github.com/o/r"), ("http://github.com/o/r", "https://github.com/o/r"),
        *[(u, None) for u in (
            "github.com/o/r", "https://github.com", "https://github.com/o", "https://gitlab.com/o/r", "ftp://github.com/o/r", "https://github.com/o/r/tree", "https://u@github.com/o/r",
            "https://github.com:443/o/r", "https://github.com/o/r?a=1", "https://github.com/o/r#x", "https://github.com/o/r%20x", "https://github.com/o/..", "https://github.com/o/r/",
            "https://github.com//r", "https://github.com/o/r.git.git", "https://github.com/o /r", "https://github.com/-o/r", "", None,
        )],
    ],
)
def test_address(spark, url, normalized):
    a = spark.range(1).select(paths.repository_address(F.lit(url).cast("string")).alias("a")).first()["a"]
    assert (a["accepted"], a["normalized"]) == (normalized is not None, normalized)


@pytest.mark.parametrize("path, safe", [("a/b.py", True), ("a", True), ("/a", False), ("a//b", False), ("a/../b", False), ("./a", False), ("C:/a", False), ("a\\b", False), ("", False), (None, False)])
def test_safe_path(spark, path, safe):
    assert spark.range(1).select(paths.is_safe_path(F.lit(path).cast("string"))).first()[0] is safe


def test_files_of_a_directory(spark, tmp_path):
    for name, data in {"src/__init__.py": b"", "src/app.py": b"print(1)\n", ".github/w.yml": b"a", "node_modules/x.js": b"x", "builder/y.py": b"yy", "big.txt": b"z" * 50}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    os.symlink(tmp_path / "src/app.py", tmp_path / "link.py")
    os.symlink("/etc", tmp_path / "out_link")
    rows = {r["relative_path"]: r for r in repository_files(spark, str(tmp_path), "ns", max_file_bytes=20).collect()}
    files = {p for p, r in rows.items() if r["outcome"] == "file"}
    assert files == {"src/__init__.py", "src/app.py", ".github/w.yml", "builder/y.py", "big.txt"}
    assert rows["node_modules"]["outcome"] == "ignored_directory" and rows["link.py"]["outcome"] == "symlink" and rows["out_link"]["outcome"] == "symlink_directory"
    assert bytes(rows["src/app.py"]["content"]) == b"print(1)\n"
    assert rows["big.txt"]["size_bytes"] == 50
    assert {r["namespace"] for r in rows.values()} == {"ns"}
    assert read_inside(str(tmp_path), "link.py", 10) is None and read_inside(str(tmp_path), "out_link/passwd", 10) is None
    assert sum(1 for _ in walk(str(tmp_path))) == len(rows)


def test_counters(spark):
    rows = [("n", "a.py", 1), ("n", "b.png", 1), ("n", "yarn.lock", 1), ("n", "x.pem", 1), ("n", "dist/z.py", 1), ("n", "m.min.js", 1)]
    files = spark.createDataFrame(rows, "namespace string, relative_path string, size_bytes long")
    assert tuple(scan.scan_counters(scan.classify_files(files)).first()) == ("n", 5, 1, 4)


@pytest.mark.parametrize("n, text", [(999, "999 B"), (1250, "1.2 kB"), (1450, "1.4 kB"), (1150, "1.1 kB"), (2_500_000, "2.5 MB"), (1_234_500_000_000, "1234.5 GB")])
def test_sizes(spark, n, text):
    assert spark.range(1).select(readable_size(F.lit(n).cast("long"))).first()[0] == text


def test_limit_counts_with_a_namespace(spark, tmp_path):
    (tmp_path / "a.py").write_text("x" * 2000)
    (row,) = repository_files(spark, str(tmp_path), "n", max_file_bytes=100).collect()
    assert (row["namespace"], row["outcome"], row["content"]) == ("n", "file", None)
    (tmp_path / "a.py").write_text("x" * 1_500_000)
    (row,) = repository_files(spark, str(tmp_path), "n", max_file_bytes=2_000_000).collect()
    assert len(row["content"]) == 1_500_000


def test_listing_goes_on_in_further_jobs(spark, tmp_path):
    for k in range(12):
        below = tmp_path / "/".join(f"d{j}" for j in range(k % 5)) / f"e{k}"
        below.mkdir(parents=True)
        (below / "a.py").write_text("x" * k)
    (tmp_path / "empty").mkdir()
    os.symlink(tmp_path / "d0", tmp_path / "again")
    whole = sorted(walk(str(tmp_path)), key=lambda r: r[1])
    assert sum(r[0] == "file" for r in whole) == 12
    assert any(r[0] == "open" for r in walk(str(tmp_path), most=1))
    for most in (1, 3, 1000):
        assert sorted(map(tuple, directory_entries(spark, str(tmp_path), most).collect()), key=lambda r: r[1]) == whole
    assert directory_entries(spark, str(tmp_path / "empty")).collect() == []


def test_what_is_not_wanted_is_not_read(spark, tmp_path):
    for name in ("a.py", "id_rsa", "b.py"):
        (tmp_path / name).write_text(name)
    os.mkfifo(tmp_path / "pipe")
    rows = {r["relative_path"]: (r["outcome"], r["content"]) for r in repository_files(spark, str(tmp_path), "n", F.col("relative_path") != "id_rsa").collect()}
    assert rows == {"a.py": ("file", b"a.py"), "b.py": ("file", b"b.py"), "id_rsa": ("file", None), "pipe": ("unreadable", None)}


def test_a_file_that_was_replaced_is_not_read(tmp_path):
    (tmp_path / "a").write_text("one")
    ((_, _, _, was),) = walk(str(tmp_path))
    assert read_inside(str(tmp_path), "a", 10, was) == b"one" and read_inside(str(tmp_path), "a", 2, was) is None
    (tmp_path / "b").write_text("two")
    os.replace(tmp_path / "b", tmp_path / "a")
    assert read_inside(str(tmp_path), "a", 10, was) is None and read_inside(str(tmp_path), "a", 10) == b"two"


@pytest.mark.parametrize("bad", [{"max_file_bytes": 0}, {"max_file_bytes": True}, {"files_per_task": -1}, {"entries_per_task": False}])
def test_limits_are_positive(spark, tmp_path, bad):
    with pytest.raises(ValueError):
        repository_files(spark, str(tmp_path), "n", **bad)
