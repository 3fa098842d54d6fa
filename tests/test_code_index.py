"""A small repository, end to end."""

import pytest

from cairn.operators import documents, index
from cairn.operators.embed import HashProvider
from cairn.plans import code_index as ci
from cairn.session import materialize

FILES = {
    "pkg/a.py": "import os\n\n\nclass A:\n    X = 1\n\n    def f(self):\n        return os.getcwd()\n\n\ndef g():\n    pass\n\n# end ü\n",
    "pkg/plain.py": "x = 1\n" * 40,
    "pkg/broken.py": "def f(:\n",
    "Main.java": "package p;\nclass Main {\n  interface In { void f(); }\n  int x;\n}\n",
    "web/app.tsx": "import a from 'a';\nexport class App { render() { return 1; } }\nfunction go() { return `}`; }\n",
    "lib/z.go": "package main\n",
    "README.md": "# hi\n",
    "logo.png": "png",
    ".env": "KEY=1",
    "node_modules/m.js": "x",
}


@pytest.fixture()
def repo(tmp_path):
    for name, text in FILES.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(text)
    (tmp_path / "r" / "bin.txt").write_bytes(b"\x00\x01")
    return tmp_path / "r"


def test_inventories(spark, repo):
    scanned = ci.scan_repository(spark, str(repo), "ns")
    assert {r["relative_path"]: r["reason"] for r in scanned.ignored.collect()} == {"logo.png": "unsupported_type", ".env": "sensitive_file", "bin.txt": "binary"}
    assert [tuple(r) for r in scanned.skipped_dirs.collect()] == [("ns", "node_modules", "ignored_directory")]
    status = {r["relative_path"]: r["status"] for r in ci.parse_inventory(scanned.files).collect()}
    assert status == {"pkg/a.py": "success", "pkg/plain.py": "success", "pkg/broken.py": "failed", "Main.java": "success", "web/app.tsx": "success", "lib/z.go": "skipped"}


def test_chunks_partition_the_files(spark, repo):
    files = materialize(ci.scan_repository(spark, str(repo), "ns").files, "test-files")
    rows = ci.chunk_inventory(files, materialize(ci.parse_inventory(files), "test-parsed"), 24, 48).collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r["relative_path"], []).append(r)
    assert set(by_file) == {"pkg/a.py", "pkg/plain.py", "Main.java", "web/app.tsx"}
    for path, chunks in by_file.items():
        data, at = FILES[path].encode(), 0
        for c in sorted(chunks, key=lambda c: c["start"]):
            assert c["start"] >= at and not data[at : c["start"]].strip()
            assert data[c["start"] : c["end"]].decode() == c["content"] and c["end"] - c["start"] <= 48
            at = c["end"]
        assert not data[at:].strip()
    assert {(r["kind"], r["qualified_name"]) for r in by_file["pkg/a.py"] if r["fragment_count"] == 1} >= {("symbol", "A.X"), ("symbol", "A.f"), ("symbol", "g"), ("context", "A"), ("context", None)}
    assert len({r["chunk_id"] for r in rows}) == len(rows)


def test_index_and_search(spark, repo, tmp_path):
    store, provider = index.VectorIndex(spark, str(tmp_path / "index")), HashProvider(8)
    first = ci.index_repository(spark, str(repo), "ns", store, provider)
    assert first["inserted_chunks"] == first["total_chunks"] > 5
    assert (first["parsed"]["total_files_requested"], first["parsed"]["failed_files"], first["parsed"]["skipped_files"]) == (6, 1, 1)
    assert first["chunked"]["total_chunks"] == first["total_chunks"]
    assert ci.index_repository(spark, str(repo), "ns", store, provider)["status"] == "unchanged"
    (repo / "pkg/a.py").write_text(FILES["pkg/a.py"].replace("pass", "exit"))
    (repo / "Main.java").unlink()
    second = ci.index_repository(spark, str(repo), "ns", store, provider)
    assert second["updated_chunks"] == 1 and second["deleted_chunks"] > 0 and second["inserted_chunks"] == 0
    hits = index.search(store, "ns", "def g", 3, provider, documents.VERSION)
    assert {(h["language"], h["kind"]) for h in hits} <= {("python", "symbol"), ("python", "context"), ("typescript", "symbol"), ("typescript", "context")} and all(1 <= h["start_line"] <= h["end_line"] for h in hits)
    assert len(hits) == 3 and [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)
