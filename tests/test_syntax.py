"""Facts of Java and ECMAScript sources: scopes, barriers, owners, kinds of calls, imports, and broken files."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import syntax

#: name: (language, source, symbols (kind, qualified name), calls (caller, callee, kind))
SOURCES = {
    "primary": (
        "java",
        "package com.example.auth;\n\nimport java.util.Optional;\n\npublic final class AuthService implements AuthProvider {\n    private UserRepository repository;\n\n    public AuthService(UserRepository repository) {\n        this.repository = repository;\n    }\n\n    public Optional<User> find(String email) {\n        return repository.findByEmail(email);\n    }\n}\n",
        [("class", "com.example.auth.AuthService"), ("constructor", "com.example.auth.AuthService.AuthService"), ("method", "com.example.auth.AuthService.find")],
        [("com.example.auth.AuthService.find", "repository.findByEmail", "call")],
    ),
    "local": (
        "java",
        "class C {\n    void outer() {\n        class Local {\n            { init(); }\n            Object value = make();\n            void inner() { run(); }\n        }\n    }\n}\n",
        [("class", "C"), ("method", "C.outer"), ("class", "C.outer.Local"), ("method", "C.outer.Local.inner")],
        [(None, "init", "call"), (None, "make", "call"), ("C.outer.Local.inner", "run", "call")],
    ),
    "anonymous": ("java", "class A { void outer(){ Object x = new Object(){ void run(){ go(); } }; } }", [("class", "A"), ("method", "A.outer")], [("A.outer", "Object", "constructor"), (None, "go", "call")]),
    "anonymous_field": (
        "java",
        "class A { Runnable r = new Runnable() { public void run() { h(); } }; int x = foo(); }",
        [("class", "A")],
        [(None, "Runnable", "constructor"), (None, "h", "call"), (None, "foo", "call")],
    ),
    "record": ("java", "record P(int a) { int q() { return go(); } }", [], [(None, "go", "call")]),
    "annotation_type": ("java", "@interface N { String value() default \"\"; }\nclass A { @N(\"x\") @Deprecated() void f() { g(); } }", [("class", "A"), ("method", "A.f")], [("A.f", "g", "call")]),
    "text_block": ("java", 'class A { String s = """\n  one " quote { \n"""; void f() { g(); } void h() { } }', [("class", "A"), ("method", "A.f"), ("method", "A.h")], [("A.f", "g", "call")]),
    "made": ("java", "class Factory {\n    User make() {\n        audit();\n        return new User();\n    }\n}\n", [("class", "Factory"), ("method", "Factory.make")], [("Factory.make", "audit", "call"), ("Factory.make", "User", "constructor")]),
    "constants": (
        "java",
        'interface Settings {\n    int DEFAULT = 1;\n}\nclass Constants {\n    public static final int MAX = 3;\n    final String NAME = "app", B = f(x, y);\n    int ordinary = 4;\n    void update() {\n        final int local = 5;\n    }\n}\n',
        [("interface", "Settings"), ("class", "Constants"), ("constant", "Constants.MAX"), ("constant", "Constants.NAME"), ("constant", "Constants.B"), ("method", "Constants.update")],
        [(None, "f", "call")],
    ),
    "nested": (
        "java",
        "package nested;\nclass Outer {\n    interface Inner {\n        void run();\n    }\n    enum State { ON }\n    class Child {}\n}\n",
        [("class", "nested.Outer"), ("interface", "nested.Outer.Inner"), ("method", "nested.Outer.Inner.run"), ("enum", "nested.Outer.State"), ("class", "nested.Outer.Child")],
        [],
    ),
    "initializers": ("java", "class Init {\n    { boot(); }\n    static { warm(); }\n    void run() { go(); }\n}\n", [("class", "Init"), ("method", "Init.run")], [(None, "boot", "call"), (None, "warm", "call"), ("Init.run", "go", "call")]),
    "lambda": ("java", "class A { void f() { xs.each(x -> { g(x); }, y); if (h()) { k(); } } }", [("class", "A"), ("method", "A.f")], [("A.f", c, "call") for c in ("xs.each", "g", "h", "k")]),
    "broken_java": ("java", "class Good {}\nclass Broken { void nope( { } }\n", [("class", "Good")], []),
    "open_java": ("java", "class Kept { void ok() { run(); } }\nclass Broken { void nope( {\n", [("class", "Kept"), ("method", "Kept.ok")], [("Kept.ok", "run", "call")]),
    "broken_first": ("java", "class A { void f( { } }\nclass B { void k() { g(); } }", [("class", "B"), ("method", "B.k")], [("B.k", "g", "call")]),
    "es_primary": (
        "javascript",
        'import api from "./api.js";\n\nexport default class AuthService {\n    constructor(client) {\n        this.client = client;\n    }\n\n    async login(user, password = "guest") {\n        return api.login(user, password);\n    }\n}\n\nexport function logout(user) {\n    return api.logout(user);\n}\n',
        [("class", "AuthService"), ("constructor", "AuthService.constructor"), ("method", "AuthService.login"), ("function", "logout")],
        [("AuthService.login", "api.login", "call"), ("logout", "api.logout", "call")],
    ),
    "es_bound": (
        "javascript",
        "function outer(items) {\n    const arrow = (value = 1) => work(value);\n    let expression = function internal(value) { return work2(value); };\n    assigned = async function(value) { return work3(value); };\n    items.map(item => transform(item));\n    return arrow(1);\n}\nsetTimeout(() => tick(), 0);\nignored ||= () => nope();\n",
        [("function", "outer"), ("function", "outer.arrow"), ("function", "outer.expression"), ("function", "outer.assigned")],
        [("outer.arrow", "work", "call"), ("outer.expression", "work2", "call"), ("outer.assigned", "work3", "call"), ("outer", "items.map", "call"), ("outer", "transform", "call"), ("outer", "arrow", "call"), (None, "setTimeout", "call"), (None, "tick", "call"), (None, "nope", "call")],
    ),
    "es_expression_class": ("javascript", "function outer() {\n    const C = class {\n        @decorate()\n        method() { leaked(); }\n    };\n    return done();\n}\n", [("function", "outer")], [(None, "decorate", "call"), (None, "leaked", "call"), ("outer", "done", "call")]),
    "es_decorator": ("javascript", "class C {\n    @dec(factory())\n    method() { body(); }\n}\n", [("class", "C"), ("method", "C.method")], [(None, "dec", "call"), (None, "factory", "call"), ("C.method", "body", "call")]),
    "ts_parameter_decorator": ("typescript", "class C { method(@dec() x: string) { body(); } }", [("class", "C"), ("method", "C.method")], [(None, "dec", "call"), ("C.method", "body", "call")]),
    "ts_namespace": ("typescript", "namespace N { export function f(){ go(); } }", [], [(None, "go", "call")]),
    "es_constants": (
        "javascript",
        "const LIMIT = 3;\nconst { FIRST } = settings;\nconst helper = () => {\n    const LOCAL = 1;\n    new Client();\n};\nclass Child extends framework.Base {}\n",
        [("constant", "LIMIT"), ("function", "helper"), ("class", "Child")],
        [("helper", "Client", "constructor")],
    ),
    "es_texts": ("javascript", "function f() { const r = /[/{]\"/g; const s = `}` + '{'; return r.test(s) / 2; }\nfunction g() { /* } */ h(); } // {", [("function", "f"), ("function", "g")], [("f", "r.test", "call"), ("g", "h", "call")]),
    "es_templates": ("javascript", "function f() { return `a ${g(`b ${ { x: `}` }.x } '`)} {`; }\nfunction h() { return k(`it's ${ '}' } $ $$ \\` {`); }\n", [("function", "f"), ("function", "h")], [("h", "k", "call")]),
    "broken_es": ("javascript", "function good() {}\nfunction broken(x = ) {}\n", [("function", "good")], []),
    "open_es": ("javascript", "function kept() { ok(); }\nfunction broken( {\n", [("function", "kept")], [("kept", "ok", "call")]),
    "broken_ts": ("typescript", "interface Good {}\nfunction broken(x: ) {}\n", [("interface", "Good")], []),
    "empty": ("java", "", [], []),
    "null": ("java", None, [], []),
}
ISSUES = {
    "broken_java": [("syntax_error", 29, 43)],
    "open_java": [("syntax_error", 36, 63)],
    "broken_first": [("syntax_error", 10, 21)],
    "broken_es": [("syntax_error", 37, 40)],
    "open_es": [("syntax_error", 26, 44)],
    "broken_ts": [("syntax_error", 35, 38)],
    "unclosed": [("missing_node", 12, 12)],
    "stray": [("syntax_error", 11, 12)],
}
MORE = {"unclosed": ("java", "﻿class A {"), "stray": ("java", "class A { }}\nclass B { }"), "mark": ("java", "﻿class M { }")}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(n, s[0], s[1]) for n, s in (SOURCES | MORE).items()]
    files = spark.createDataFrame(rows, "file string, language string, content string").repartition(3)
    f = syntax.facts(files, ["file"])
    return {k: getattr(f, k).collect() for k in ("symbols", "calls", "imports", "issues")}


@pytest.mark.parametrize("name", SOURCES)
def test_symbols_and_calls(found, name):
    _, _, symbols, calls = SOURCES[name]
    assert sorted((r["kind"], r["qualified_name"]) for r in found["symbols"] if r["file"] == name) == sorted(symbols)
    assert sorted(((r["caller"], r["callee"], r["kind"]) for r in found["calls"] if r["file"] == name), key=str) == sorted(calls, key=str)
    for r in found["symbols"]:
        parent, _, last = r["qualified_name"].rpartition(".")
        assert last == r["name"] and r["parent_qualified_name"] in (parent, None)


def test_ranges(found):
    at = {(r["file"], r["qualified_name"], r["kind"]): (r["start"], r["end"]) for r in found["symbols"]}
    p = "com.example.auth.AuthService"
    assert [at["primary", p, "class"], at["primary", p + ".AuthService", "constructor"], at["primary", p + ".find", "method"]] == [(55, 349), (156, 247), (253, 347)]
    assert [at["es_primary", q, k] for q, k in (("AuthService", "class"), ("AuthService.constructor", "constructor"), ("AuthService.login", "method"), ("logout", "function"))] == [(44, 220), (68, 125), (131, 218), (229, 283)]
    assert at["mark", "M", "class"] == (3, 14)
    assert {(r["start"], r["end"]) for r in found["calls"] if r["file"] in ("primary", "es_primary")} == {(311, 340), (186, 211), (264, 280)}


def test_issues(found):
    got = {}
    for r in found["issues"]:
        got.setdefault(r["file"], []).append((r["kind"], r["start"], r["end"]))
    assert got == ISSUES


IMPORTS = {
    "java": ("java", "package p;\nimport java.util.List;\nimport static java.util.Collections.*;\nclass A { }", [("java.util.List", [], False, []), ("java.util.Collections", [], True, ["static"])]),
    "es": (
        "javascript",
        'import "./setup.js";\nimport defaultApi, { readFile as read, writeFile } from "lib";\nimport * as path from "path"\nconst fs = require("fs");\nrequire("side");\nrequire(name);\nimport("lazy");\n',
        [("./setup.js", [], False, []), ("lib", [("default", "defaultApi"), ("readFile", "read"), ("writeFile", None)], False, []), ("path", [("*", "path")], True, []), ("fs", [("*", "fs")], True, []), ("side", [], False, [])],
    ),
}


def test_imports(spark):
    files = spark.createDataFrame([(n, *s[:2]) for n, s in IMPORTS.items()], "file string, language string, content string")
    f = syntax.facts(files, ["file"])
    rows = f.imports.orderBy("file", "start").collect()
    for name, (_, _, want) in IMPORTS.items():
        assert [(r["module"], [tuple(b) for b in r["bindings"]], r["is_wildcard"], r["modifiers"]) for r in rows if r["file"] == name] == want
    assert [(r["start"], r["end"]) for r in rows if r["file"] == "es"][:2] == [(0, 20), (21, 83)]
    assert sorted(r["callee"] for r in f.calls.collect()) == ["import", "require", "require", "require"]


def test_required_patterns(spark):
    """The parts of a pattern are bindings; what isn't declared, nested or has a default is none."""
    source = (
        "const { a, b: c, d: d, e = 1, f: { g }, 'h': i, ...rest } = require('one');\nlet x = require('two'), { y } = require('three')\n"
        "z = require('four');\nconst [k] = require('five');\n({ m } = require('six'));\nfunction n() { var { o } = require('seven'); }\nconst {} = require('eight');\n"
    )
    f = syntax.facts(spark.createDataFrame([("a", "javascript", source)], "file string, language string, content string"), ["file"])
    got = {r["module"]: ([tuple(b) for b in r["bindings"]], r["is_wildcard"]) for r in f.imports.collect()}
    assert got == {
        "one": ([("a", None), ("b", "c"), ("d", None)], False), "two": ([("*", "x")], True), "three": ([("y", None)], False), "four": ([], False),
        "five": ([], False), "six": ([], False), "seven": ([("o", None)], False), "eight": ([], False),
    }


MODIFIERS = {
    "java": (
        "java",
        "@A(final = 1) public abstract static class C {\n  static public final int X = 1, Y = 2;\n  @B protected synchronized void f(final int a) { final int z = 1; }\n  C() { }\n}\npublic interface I { default void g() { } }\nnon-sealed class D { }\nsealed class E { }\n",
        {"C": "public static abstract", "C.X": "public static final", "C.Y": "public static final", "C.f": "protected synchronized", "C.C": "", "I": "public", "I.g": "default", "D": "non-sealed", "E": "sealed"},
    ),
    "es": (
        "typescript",
        "export default abstract class C {\n  private static async *go() { }\n  get get() { return 1; }\n  static() { }\n  @dec() protected override set(x) { }\n  constructor(private readonly y) { }\n}\nexport async function* f() { }\nexport const g = async () => h(), K = 1;\nlet p = function* () { };\ndeclare function q(): void;\nfunction r() { }\nexport const L = 2;\n",
        {"C": "abstract export default", "C.go": "private static async generator", "C.get": "get", "C.static": "", "C.set": "protected override", "C.constructor": "", "f": "async export generator", "g": "async export", "p": "generator", "q": "declare", "r": "", "L": "export"},
    ),
}


def test_modifiers(spark):
    files = spark.createDataFrame([(n, *s[:2]) for n, s in MODIFIERS.items()], "file string, language string, content string")
    rows = syntax.facts(files, ["file"]).symbols.collect()
    for name, (_, _, want) in MODIFIERS.items():
        assert {r["qualified_name"]: " ".join(r["modifiers"]) for r in rows if r["file"] == name} == want


SIGNATURES = {
    "java": (
        "java",
        "class A<T extends Comparable<T>> extends Base<Map<K, V>> implements I, p.J<X> {\n  A(final Map<String, List<X>> m, @N(a, b) int[] x, String... rest) throws E, F { }\n  void f(Outer Outer.this) { }\n  int g() { return h(a < b, c); }\n}\ninterface Q extends R, S { void k(int a[]); }\nclass D extends /* note */ B {}",
        [("A", "base", 0, "Base<Map<K, V>>"), ("A", "implemented", 0, "I"), ("A", "implemented", 1, "p.J<X>"), ("D", "base", 0, "B"), ("Q", "base", 0, "R"), ("Q", "base", 1, "S")],
        [("A.A", 0, "m", "Map<String, List<X>>", None), ("A.A", 1, "x", "int[]", None), ("A.A", 2, "rest", "String...", None), ("A.f", 0, "Outer.this", "Outer", None), ("Q.k", 0, "a", "int[]", None)],
    ),
    "es": (
        "typescript",
        "class C extends framework.Base<A, B> implements I, J { constructor(private readonly x: Map<string, number>, y?: string, @dec(1, 2) z = a < b) { } }\nfunction f({ a, b }, [c, d] = [1, 2], ...rest) { }\nconst g = async (v: (n: number) => void = w, u) => v(u);\nconst h = one => one;\nfunction none() { }\n",
        [("C", "base", 0, "framework.Base<A, B>"), ("C", "implemented", 0, "I"), ("C", "implemented", 1, "J")],
        [("C.constructor", 0, "x", "Map<string, number>", None), ("C.constructor", 1, "y", "string", None), ("C.constructor", 2, "z", None, "a < b"), ("f", 0, "{ a, b }", None, None), ("f", 1, "[c, d]", None, "[1, 2]"), ("f", 2, "rest", None, None), ("g", 0, "v", "(n: number) => void", "w"), ("g", 1, "u", None, None), ("h", 0, "one", None, None)],
    ),
}


def test_signatures(spark):
    files = spark.createDataFrame([(n, *s[:2]) for n, s in SIGNATURES.items()], "file string, language string, content string")
    f = syntax.facts(files, ["file"])
    supers, parameters = f.supertypes.collect(), f.parameters.collect()
    for name, (_, _, types, want) in SIGNATURES.items():
        assert sorted((r["qualified_name"], r["relation"], r["position"], r["type_name"]) for r in supers if r["file"] == name) == types
        assert sorted((r["qualified_name"], r["position"], r["name"], r["type_name"], r["default_value_text"]) for r in parameters if r["file"] == name) == sorted(want)


def test_one_long_file(spark):
    """A file of many members costs in proportion."""
    source = "class A {\n" + "".join(f"  int f{k}() {{ return g{k}(h(1)); }}\n" for k in range(3000)) + "}\n"
    f = syntax.facts(spark.createDataFrame([("a", "java", source)], "file string, language string, content string"), ["file"])
    assert f.symbols.count() == 3001 and f.calls.filter(F.col("caller").startswith("A.f")).count() == 6000 and f.issues.count() == 0


def test_long_literals_stay_in_their_file(spark):
    """Tokens hold no long text, facts do; imports alone need no marks of symbols."""
    long = "m" * 500
    source = f'import a from "{long}1";\nconst b = require("{long}2");\nfunction f(x = "{long}3", y = `é{long}4`) {{ g("{long}5"); }}\n/* {long} */\n'
    f = syntax.facts(spark.createDataFrame([("a", "javascript", source)], "file string, language string, content string"), ["file"])
    assert sorted(r["module"] for r in f.imports.collect()) == [long + "1", long + "2"]
    assert "marks" not in vars(f)
    assert f.tokens.agg(F.max(F.octet_length("token"))).first()[0] <= syntax.LONG
    assert [r["default_value_text"] for r in f.parameters.orderBy("position").collect()] == [f'"{long}3"', f"`é{long}4`"]


def test_what_stands_before_a_package(spark):
    """Annotations are no part of its name; an import may end a file without a semicolon."""
    rows = [("p", "java", "@A package a.b;\nclass C { void f() { g(); } }"), ("i", "javascript", 'import x from "m"')]
    f = syntax.facts(spark.createDataFrame(rows, "file string, language string, content string"), ["file"])
    assert sorted(r["qualified_name"] for r in f.symbols.collect()) == ["a.b.C", "a.b.C.f"]
    assert [(r["module"], r["start"], r["end"]) for r in f.imports.collect()] == [("m", 0, 17)]


def test_marks_are_not_sorted(spark):
    """The step of marks took its time to sort tokens by file, block and statement: what surrounds a token is found without."""
    files = spark.createDataFrame([("a", "java", "class A { int f() { return a + b * c - d.e / g(h); } }")], "file string, language string, content string")
    plan = syntax.marks_of(syntax.tokens(files, ["file"], "content", "language", 1, kept_only=True), ["file"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 1 and plan.count("Exchange") <= 1
