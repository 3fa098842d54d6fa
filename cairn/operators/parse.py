"""Symbols, imports and calls of Python files by the standard library's parser, a file a row, and the statuses of parsed files."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOC = "start_byte int, end_byte int, start_line int, start_column int, end_line int, end_column int"
LOCATION = ("start_byte", "end_byte", "start_line", "start_column", "end_line", "end_column")
RESULT = (
    "status string, symbols array<struct<kind:string,name:string,qualified_name:string,parent_qualified_name:string,start_byte:int,end_byte:int,start_line:int,start_column:int,end_line:int,end_column:int,modifiers:array<string>>>, "
    "imports array<struct<module:string,imported_name:string,alias:string,is_wildcard:boolean,start_byte:int,end_byte:int>>, "
    "calls array<struct<caller_qualified_name:string,callee_text:string,start_byte:int,end_byte:int>>, "
    "issues array<struct<kind:string,message:string,start_byte:int,end_byte:int>>"
)


class PythonFacts(ast.NodeVisitor):
    """Facts of one file, in byte offsets of its text."""

    def __init__(self, data: bytes):
        self.data, self.starts = data, [0]
        for line in data.split(b"\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.scope: list[tuple[str, str]] = []  # kind and qualified name
        self.symbols, self.imports, self.calls = [], [], []

    def span(self, node) -> tuple[int, int]:
        return self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset

    def symbol(self, kind: str, name: str, node) -> str:
        a, b = self.span(node)
        parent = self.scope[-1][1] if self.scope else None
        qualified = f"{parent}.{name}" if parent else name
        self.symbols.append((kind, name, qualified, parent, a, b, node.lineno, node.col_offset, node.end_lineno, node.end_col_offset, ("async",) if isinstance(node, ast.AsyncFunctionDef) else ()))
        return qualified

    def inside(self, kind: str, qualified: str, nodes) -> None:
        self.scope.append((kind, qualified))
        for n in nodes:
            self.visit(n)
        self.scope.pop()

    def unowned(self, nodes) -> None:
        scope, self.scope = self.scope, []
        for n in nodes:
            self.visit(n)
        self.scope = scope

    def visit_ClassDef(self, node):
        self.unowned(node.decorator_list)
        self.inside("class", self.symbol("class", node.name, node), [*node.bases, *node.keywords, *node.body])

    def visit_FunctionDef(self, node):
        self.unowned(node.decorator_list)
        in_class = bool(self.scope) and self.scope[-1][0] == "class"
        kind = "constructor" if in_class and node.name == "__init__" else "method" if in_class else "function"
        self.inside("callable", self.symbol(kind, node.name, node), [node.args, *([node.returns] if node.returns else []), *node.body])

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Assign(self, node):
        if not self.scope or self.scope[-1][0] == "class":
            for t in node.targets:
                if isinstance(t, ast.Name) and t.id.isupper():
                    self.symbol("constant", t.id, node)
        self.generic_visit(node)

    def visit_Import(self, node):
        self.imports += [(a.name, None, a.asname, False, *self.span(node)) for a in node.names]

    def visit_ImportFrom(self, node):
        module = "." * node.level + (node.module or "")
        self.imports += [(module, None if a.name == "*" else a.name, a.asname, a.name == "*", *self.span(node)) for a in node.names]

    def visit_Call(self, node):
        owner = self.scope[-1] if self.scope else ("", None)
        a, b = self.span(node.func)
        self.calls.append((owner[1] if owner[0] == "callable" else None, self.data[a:b].decode("utf-8", "replace"), *self.span(node)))
        self.generic_visit(node)


def sound_prefix(text: str, line: int, tries: int = 32) -> str:
    """The text before the statement that a syntax error on a line breaks, cut where a top-level statement begins; else nothing."""
    lines = text.split("\n")
    tops = [k for k in range(min(line, len(lines)) - 1, 0, -1) if lines[k][:1].isidentifier() or lines[k][:1] == "@"]
    for k in tops[:tries]:
        prefix = "".join(x + "\n" for x in lines[:k])
        try:
            ast.parse(prefix)
            return prefix
        except (SyntaxError, ValueError):
            continue
    return ""


def python_facts(data: bytes) -> tuple:
    """(status, symbols, imports, calls, issues) of one file.

    A file that breaks off is parsed up to the broken statement: partial if that gives anything, with an issue over the rest.
    Any other exception fails this file alone.
    """
    mark = 3 if data.startswith(b"\xef\xbb\xbf") else 0
    facts, issues = PythonFacts(data[mark:]), []
    try:
        text = data[mark:].decode("utf-8")
        if text.startswith("\ufeff"):
            raise ValueError("a second byte order mark")
        try:
            tree = ast.parse(text)
        except SyntaxError as e:
            prefix = sound_prefix(text, e.lineno or 1)
            issues.append(("syntax_error", type(e).__name__, mark + len(prefix.encode()), len(data)))
            tree = ast.parse(prefix)
        facts.visit(tree)
    except UnicodeDecodeError:
        return "failed", [], [], [], [("decoding_error", "the file is not UTF-8", None, None)]
    except (SyntaxError, ValueError, RecursionError) as e:
        return "failed", [], [], [], [("syntax_error", type(e).__name__, None, None)]
    except Exception as e:  # noqa: BLE001 - one file must not end the job
        return "failed", [], [], [], [("extraction_error", type(e).__name__, None, None)]
    move = lambda rows, at: [(*r[:at], r[at] + mark, r[at + 1] + mark, *r[at + 2 :]) for r in rows]
    symbols = sorted(set(move(facts.symbols, 4)), key=lambda s: (s[4], s[5], s[0], s[2]))
    imports = sorted(set(move(facts.imports, 4)), key=lambda i: (i[4], i[5], i[0], i[1] or "", i[2] or ""))
    calls = sorted(set(move(facts.calls, 2)), key=lambda c: (c[2], c[3], c[1]))
    status = "success" if not issues else "partial" if symbols or imports or calls else "failed"
    return status, symbols, imports, calls, issues


def parse_python(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, source_sha256 and the facts of each Python file. A broken file is a row with status failed and an issue."""
    kept = ", ".join(f"{k} {dict(files.dtypes)[k]}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keys].copy()
            out["source_sha256"] = b["__sha"]
            found = [python_facts(bytes(x)) for x in b["__data"]]
            for k, name in enumerate(("status", "symbols", "imports", "calls", "issues")):
                out[name] = [f[k] for f in found]
            yield out

    data = F.col(content).cast("binary")
    return files.select(*keys, data.alias("__data"), F.sha2(data, 256).alias("__sha")).mapInPandas(run, f"{kept}, source_sha256 string, {RESULT}")


def parse_status(issues: Column, symbols: Column, imports: Column, calls: Column) -> Column:
    """success without issues; else partial with any structure, and failed with none."""
    some = (F.size(symbols) > 0) | (F.size(imports) > 0) | (F.size(calls) > 0)
    return F.when(F.size(issues) == 0, "success").when(some, "partial").otherwise("failed")


def parse_counters(parsed: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_files")
    return parsed.agg(F.count("*").alias("total_files_requested"), n("success"), n("partial"), n("failed"), n("skipped"))
