"""Java and ECMAScript sources as relations: tokens, matched brackets, scopes, and the facts that follow from them.

A file is a row per token. Brackets are matched by running depths and their minima, braces first and then parentheses
and square brackets within each block, so an error in one statement doesn't unsettle the others. What has no partner is
an issue with a range. Scopes are types, callables and barriers; a scope that an issue touches is a barrier: nothing in
it is a symbol and its calls have no owner.

Files are dealt by their keys once, as light tokens, in as many partitions as their bytes need. What surrounds a token
comes from array operations over batches of files (brackets.surround), so tokens are neither sorted nor joined; which
facts follow is told by columns, and owners by joins and windows over facts. Texts of literals and comments never travel
with the tokens: what a fact needs of a long literal is cut out of its file afterwards. Only the rows that make facts
are written down, and a fact that nobody asks for isn't computed.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import MODIFIERS, byte_slice
from cairn.operators.brackets import surrounded
from cairn.operators.intervals import ancestors, unsafe
from cairn.session import materialize


def nested_template(levels: int) -> str:
    """A template whose substitutions hold texts, braces and templates, each at most so many levels deep."""
    text = r"""'(?:[^'\\\n]++|\\.)*+'|"(?:[^"\\\n]++|\\.)*+"|/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/|//[^\n]*+"""
    plain = r"""[^`{}'"/]++|[^`{}'"]"""
    held = rf"(?:{text}|{plain})*+"
    for _ in range(levels):
        held = rf"(?:{text}|{plain}|\{{{held}\}}|`(?:[^`\\$]++|\\(?s:.)|\$\{{{held}\}}|\$(?!\{{))*+`)*+"
    return rf"`(?:[^`\\$]++|\\(?s:.)|\$\{{{held}\}}|\$(?!\{{))*+`"


#: White space, byte order marks and comments.
GAP = r"(?:[\s\x{FEFF}]++|//[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/)*+"
#: Texts, templates and regular expressions are one token each, so that brackets in them don't count. A regular expression is told
#: from a division by what stands before it. Loops over long texts are possessive, which Java runs without a stack, and take
#: runs of plain characters at once.
TOKEN = (
    r"[A-Za-z_$][\w$]*+|=>|[{}();=]|\.\.\."
    r'|"""(?s:(?:[^"\\]++|\\.|"(?!""))*+)"""|"(?:[^"\\\n]++|\\.)*+"|\'(?:[^\'\\\n]++|\\.)*+\''
    rf"|{nested_template(2)}"
    r'|`(?s:(?:[^`\\]++|\\.)*+)`'
    r"|(?=/)(?<=[=(,:\[!&|?{};]\s{0,40}|\breturn\s{1,40})/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\n\[])++/[a-z]*+"
    r"|[^\sA-Za-z_${}();=]"
)
NAME = r"^[A-Za-z_$][\w$]*$"
#: Words before a parenthesis that call and declare nothing.
CONTROL = (
    "if", "for", "while", "switch", "catch", "synchronized", "try", "do", "else", "return", "new", "throw", "case", "function", "typeof", "await",
    "yield", "assert", "in", "of", "instanceof", "delete", "void", "super", "this", "with", "default",
)
#: Words that are no part of a callee or a type.
KEYWORDS = ("new", "return", "throw", "case", "else", "await", "typeof", "yield", "in", "of", "instanceof", "delete", "void", "do")
#: Words that may stand before a member's or type's own keyword or name.
LEADING = ("async", "static", "abstract", "get", "set", "public", "private", "protected", "readonly", "override", "accessor", "declare", "*", "#")
#: Further words between the modifiers and the name of a declaration.
BETWEEN = ("export", "default", "const", "let", "var")
#: Modifiers of Java; `non-sealed` is three tokens and stands for itself.
JAVA_MODIFIERS = ("public", "protected", "private", "static", "abstract", "final", "synchronized", "native", "strictfp", "transient", "volatile", "sealed", "default")
#: A token and the next one that can't follow it.
DANGLING = {"=": (")", "]", "}", ";", ","), "=>": (")", "]", "}", ";", ","), ":": (")", "]"), ".": (")", "]", "}", ";", ",")}


#: Literals of more bytes are two quotes among the tokens.
LONG = 64
#: Bytes of sources in a partition of tokens. Of dense code that is about two million tokens.
PART_BYTES = 8 << 20


def is_name(token: Column) -> Column:
    """Whether a token is a name: its first character says so."""
    first = F.ascii(token)
    return first.between(ord("a"), ord("z")) | first.between(ord("A"), ord("Z")) | first.isin(ord("_"), ord("$"))


def tokens(files: DataFrame, keys: list[str], content: str, language: str, parts: int, kept_only: bool = False) -> DataFrame:
    """keys, java, and of every token but comments what brackets.FIELDS lists; a byte order mark counts in the offsets.

    A literal of over LONG bytes stands as two quotes, so its token is shorter than its range. Rows are dealt by the keys. With
    kept_only, tokens are left out on which no fact of marks_of() depends.
    """
    pieces = F.regexp_extract_all(F.col(content), F.lit(rf"{GAP}(?:{TOKEN}|\z)"), F.lit(0))
    bulky = lambda x: (F.octet_length(x) > LONG) & F.substring(x, 1, 1).isin('"', "'", "`", "/")
    short = lambda x: F.when(bulky(x), F.repeat(F.substring(x, 1, 1), F.lit(2))).otherwise(x)
    bare = lambda x: F.when(F.ascii(x).isin(9, 10, 11, 12, 13, 32, ord("/"), 0xFEFF), F.regexp_extract(x, rf"\A{GAP}((?s:.*+))", 1)).otherwise(x)
    dealt = files.select(*keys, (F.col(language) == "java").alias("java"), pieces.alias("pieces"))
    cut = F.transform(F.transform("pieces", lambda x: F.struct(bare(x).alias("token"), F.octet_length(x).alias("total"))), lambda y: F.struct(short(y["token"]).alias("token"), F.octet_length(y["token"]).alias("size"), y["total"].alias("total")))
    dealt = dealt.select(*keys, "java", cut.alias("pieces")).repartition(parts, *keys)
    bit = {w: 1 << k for k, w in enumerate(MODIFIERS)}
    run = {w: bit[w] for w in LEADING if w not in "*#"} | {"export": bit["export"], "default": bit["default"], "*": bit["generator"]}
    words = {
        "link": (".", "<", ">", ",", "?", "&", "..."), "keyword": KEYWORDS, "leading": LEADING, "run": (*LEADING, *BETWEEN),
        "facts": ("class", "interface", "enum", "record", "namespace", "module", "function", "non", "=", ",", "=>", '"', "'", "`", *JAVA_MODIFIERS),
    }
    # Arrow batches end by bytes: a token's row of what surrounds it is wider than the token.
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")
    placed = surrounded("pieces", words=words, said={w: bit[w] for w in JAVA_MODIFIERS} | {"non": bit["non-sealed"]}, run=run, kept_only=kept_only)
    return dealt.select(*keys, "java", F.inline(placed))


def spelled(rows: DataFrame, keys: list[str], files: DataFrame, content: str, wanted: Column) -> DataFrame:
    """Materialized rows (keys, pos, token, start, end) with the whole token of long literals where it is wanted, cut out of the files."""
    is_cut = wanted & (F.octet_length("token") < F.col("end") - F.col("start"))
    cut = materialize(rows.filter(is_cut).select(*keys, "pos", "start", "end").distinct(), "syntax-long")
    texts = cut.join(files.select(*keys, F.col(content).alias("__content")), keys)
    texts = texts.select(*keys, "pos", byte_slice(F.col("__content"), F.col("start"), F.col("end")).cast("string").alias("__whole"))
    return rows.join(texts, [*keys, "pos"], "left").withColumn("token", F.coalesce("__whole", "token")).drop("__whole")


def marks_of(t: DataFrame, keys: list[str]) -> DataFrame:
    """The tokens that make a fact: keys, pos, token, block, shut (pos) and head, site, fault, packaged.

    bare: where the region of an arrow's single name begins and ends. All parentheses that open are kept.
    """
    token, java = F.col("token"), F.col("java")
    nxt, nxt2, nxt3 = F.col("next"), F.col("next2"), F.col("next3")
    equals, late = token == "=", nxt == "async"
    # A bound arrow's single name has no parentheses: its owner's next parenthesis stands behind the arrow.
    region = lambda k: F.struct((F.col("pos") + k).alias("from_pos"), (F.col("pos") + k + 2).alias("to_pos"))
    bare = F.when(equals & (nxt2 == "=>"), region(0)).when(equals & late & (nxt3 == "=>"), region(1))
    packaged = java & F.col("in_package") & (token != ";") & (F.col("block") == -1)
    t = t.withColumns({"what": what_of(), "site": site_of(), "fault": fault_of(), "packaged": packaged, "bare": bare})
    t = t.withColumn("head", F.when(F.col("what").isNotNull(), head_of()))
    t = t.filter(F.col("what").isNotNull() | F.col("site").isNotNull() | F.col("fault").isNotNull() | F.col("packaged") | (token == "("))
    return t.select(*keys, "pos", "token", "block", F.col("shut_pos").alias("shut"), "head", "site", "fault", "packaged", "bare")


def what_of() -> Column:
    """The kind of head that begins at a token, if any."""
    token, java = F.col("token"), F.col("java")
    prev, prev2, nxt, nxt2, nxt3 = (F.col(c) for c in ("prev", "prev2", "next", "next2", "next3"))
    has_body, closed, flat = F.col("body_pos").isNotNull(), F.col("body_end").isNotNull(), F.col("round") == 0
    starts = F.col("led_by").isin(";", "{", "}", ")", "export", "default")
    # Types and what hides its members.
    keyword = token.isin("class", "interface", "enum") & (prev != ".") & has_body & (java | token.isin("class", "interface"))
    sound = is_name(nxt) & ~nxt.isin("extends", "implements") & closed & (java | starts) & (prev != "@")
    odd = (java & (token == "record") & is_name(nxt) & nxt2.isin("(", "<") | ~java & token.isin("namespace", "module") & nxt.rlike(r"^[\w$'\"]") & nxt2.isin("{", ".")) & has_body
    # Functions, by name or bound to one: name = [async] function, name = [async] (...) =>, name = [async] x =>.
    function = ~java & (token == "function") & F.when(nxt == "*", is_name(nxt2)).otherwise(is_name(nxt)) & starts & (closed | ~has_body)
    late = nxt == "async"
    first, second = F.when(late, nxt2).otherwise(nxt), F.when(late, nxt3).otherwise(nxt2)
    args = F.coalesce(F.when(late, F.col("after2")).otherwise(F.col("after")), F.lit(""))
    plain = ~java & (token == "=") & is_name(prev) & ~prev2.isin(".", "|", "&", "?", "*", ":")
    bound = plain & ((first == "function") & closed | (first == "(") & (args == "=>") | is_name(first) & (second == "=>"))
    # Members: a name and its parentheses directly in a type's body. Constants: final fields in Java, const at the top of a module.
    after = F.coalesce("after", F.lit(""))
    member = is_name(token) & ~token.isin(*CONTROL) & (nxt == "(") & flat & ~prev.isin(".", "new", "=", "(", ",", "return", "function", "@", "=>") & after.isin("{", "throws", ";", ":", "[", "default")
    bodiless = after.isin(";", "default") | ~has_body
    declarator = is_name(token) & flat & nxt.isin("=", ";", ",", ":") & ~token.isin(*CONTROL)
    field = java & declarator & F.col("final") & (is_name(prev) | prev.isin(">", "]", ",")) & (nxt != ":")
    const = ~java & declarator & (F.col("block") == -1) & (prev == "const")
    decorator = ~java & (token == "(") & is_name(prev) & (prev2 == "@") & F.col("shut_pos").isNotNull()
    return (
        F.when(keyword, F.when(sound, "type").when(closed, "hidden").otherwise("open"))
        .when(odd, F.when(closed, "hidden").otherwise("open"))
        .when(java & F.col("made_by"), "anonymous")
        .when(decorator, "decorator")
        .when(function, F.when(closed, "function").otherwise("signature"))
        .when(bound, F.when(closed & ((first == "function") | (F.col("arrow_next") == "{")), "bound").otherwise("expression"))
        .when(member, F.when(bodiless, "bodiless").when(closed, "member"))
        .when(field, "field")
        .when(const, "const")
    )


def modifiers_of() -> Column:
    """Modifiers of a head, in the vocabulary's order.

    Java's stand anywhere in the statement but in parentheses and blocks. ECMAScript's are the run of such words before the
    name or keyword; a name bound to a function stands behind its modifiers, and what the function says itself behind the equals
    sign. A member may be named like a modifier.
    """
    java, token, nxt, nxt2, nxt3 = (F.col(c) for c in ("java", "token", "next", "next2", "next3"))
    equals, late = token == "=", nxt == "async"
    own, ahead = F.when(equals, F.col("prev")).otherwise(token), F.when(equals, F.col("prev2")).otherwise(F.col("prev"))
    star = equals & F.when(late, (nxt2 == "function") & (nxt3 == "*")).otherwise((nxt == "function") & (nxt2 == "*")) | (token == "function") & (nxt == "*")
    said = lambda m, k: (F.getbit("run", k) == 1) & ((m != own) | (own == ahead)) | equals & late & (m == "async") | star & (m == "generator")
    return F.filter(F.array(*[F.lit(m) for m in MODIFIERS]), lambda m, k: F.when(java, F.getbit("words", k) == 1).otherwise(said(m, k)))


def head_of() -> Column:
    """The head that what_of() finds at a token: java, before, role, kind, name, start, end, body, at, modifiers (in the vocabulary's order)."""
    what, token, java = F.col("what"), F.col("token"), F.col("java")
    roles = {"type": "type", "hidden": "barrier", "open": "barrier", "anonymous": "barrier", "decorator": "barrier", "function": "callable", "signature": "callable", "bound": "callable", "expression": "callable", "bodiless": "member", "member": "member", "field": "field", "const": "constant"}
    known = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    kind = F.when(what == "type", token).when(known[what] == "callable", "function").when(known[what] == "member", "method").when(what.isin("field", "const"), "constant")
    name = F.when(what.isin("type", "hidden", "open"), F.col("next")).when(what.isin("function", "signature"), F.when(F.col("next") == "*", F.col("next2")).otherwise(F.col("next"))).when(what.isin("bound", "expression"), F.col("prev")).when(what.isin("bodiless", "member", "field", "const"), token)
    led = what.isin("function", "signature") | what.isin("type", "member", "bodiless") & ~java
    start = F.when(led, F.col("led_from")).when(what.isin("bound", "expression"), F.col("prev_start")).when(what.isin("type", "member", "bodiless", "field"), F.col("begins")).otherwise(F.col("start"))
    end = (
        F.when(what == "anonymous", F.coalesce("shut_end", F.lit(1 << 40)))
        .when(what == "open", F.lit(1 << 40))
        .when(what == "decorator", F.col("shut_end"))
        .when(what.isin("signature", "bodiless", "field"), F.col("ends"))
        .when(what.isin("expression", "const"), F.coalesce("stop_end", "ends"))
        .otherwise(F.col("body_end"))
    )
    inner = F.when(what == "anonymous", F.col("pos")).when(what.isin("type", "hidden", "open"), F.col("body_pos"))
    return F.struct("java", F.col("prev").alias("before"), known[what].alias("role"), kind.alias("kind"), name.alias("name"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), inner.alias("body"), F.col("pos").alias("at"), modifiers_of().alias("modifiers"))


def site_of() -> Column:
    """The call whose arguments a token opens: kind (call, constructor), callee, start, end, at (pos of the name), unowned (a decorator's call)."""
    java, prev, leads, made = F.col("java"), F.col("prev"), F.col("leads"), F.col("made_start").isNotNull()
    plain = is_name(prev) & ~prev.isin(*KEYWORDS) & (~prev.isin(*CONTROL) | ~java & prev.isin("super", "import"))
    # Parentheses and a block behind them declare; parameters of an arrow are no arguments.
    declares = F.coalesce(F.col("shut_next").isin("{", "=>"), F.lit(False)) & ~made | (leads == "@") & java | (leads == "function") | (leads == "*") & (F.col("leads2") == "function")
    site = F.struct(F.when(made, "constructor").otherwise("call").alias("kind"), "callee", F.coalesce("made_start", "callee_start").alias("start"), F.col("shut_end").alias("end"), (F.col("pos") - 1).alias("at"), (leads == "@").alias("unowned"))
    return F.when((F.col("token") == "(") & (made | plain) & F.col("shut_pos").isNotNull() & ~declares, site)


def fault_of() -> Column:
    """The fault (start, end, open, last) at a token: a bracket without a partner, a quote that opens no text, or a token that the next one can't follow.

    The end of a file is that of its last token; nothing but open braces needs it.
    """
    token, stray = F.col("token"), F.col("stray")
    quote, dangling = token.isin('"', "`") | (token == "'") & F.col("java"), F.lit(False)
    for a, after in DANGLING.items():
        dangling = dangling | (token == a) & F.col("next").isin(*after)
    open_, round_ = (token == "{") & stray, token.isin("(", "[") & stray
    begin = F.when(open_ | round_, F.col("begins")).otherwise(F.col("start"))
    end = F.when(open_, F.col("last")).when(round_, F.col("ends")).when(stray | quote, F.col("end")).otherwise(F.col("next_start") + F.octet_length("next"))
    return F.when(stray | quote | dangling, F.struct(begin.alias("start"), end.alias("end"), open_.alias("open"), "last"))


def syntax_issues(marks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, message, start, end.

    An open brace without a partner spoils its statement and all behind it; where it is the file's only fault, a closing
    brace is missing at the end. A parenthesis without one spoils its statement. Stray closing brackets, quotes that
    open no text, and tokens that can't follow each other are faults by themselves.
    """
    rows = marks.filter("fault is not null").select(*keys, "fault.*")
    file = Window.partitionBy(*keys)
    rows = rows.withColumn("n", F.count("*").over(file)).withColumn("from", F.min(F.when(F.col("open"), F.col("start"))).over(file))
    # What lies behind an open brace is one fault with it.
    rows = rows.filter("from is null or start < from or (open and start = from)")
    missing = F.col("open") & (F.col("n") == 1)
    kind = F.when(missing, "missing_node").otherwise("syntax_error")
    message = F.when(missing, "A closing brace is missing.").otherwise("This is no valid syntax.")
    return rows.select(*keys, kind.alias("kind"), message.alias("message"), F.when(missing, F.col("last")).otherwise(F.col("start")).alias("start"), "end").distinct()


def heads(marks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, role (type, callable, barrier, constant), kind, name, start, end, at (pos of the name or keyword), modifiers of the marked heads.

    Types are classes, interfaces and enums; callables are functions, functions bound to a name, methods and constructors;
    barriers are records, annotation types, anonymous and expression classes, namespaces, decorators' arguments and types
    whose body never closes. Members are found in the bodies of types and barriers alone.
    """
    rows = marks.filter("head is not null").select(*keys, "block", "head.*")
    holders = rows.filter("role in ('type', 'barrier') and body is not null").select(*keys, F.col("body").alias("block"), F.col("name").alias("holder"), F.col("kind").alias("holder_kind"), F.col("role").alias("holder_role"))
    inside = rows.filter("role in ('member', 'field')").join(holders, [*keys, "block"])
    maker = F.when(F.col("java"), F.col("name") == F.col("holder")).otherwise((F.col("name") == "constructor") & ~F.col("holder_kind").eqNullSafe(F.lit("interface")))
    # A Java method has a type before its name; a name alone makes its class.
    typed = ~F.col("java") | maker | F.col("before").rlike(NAME) | F.col("before").isin(">", "]")
    methods = inside.filter("role = 'member'").filter(F.coalesce(typed, F.lit(True))).withColumn("role", F.lit("callable")).withColumn("kind", F.when(F.coalesce(maker, F.lit(False)), "constructor").otherwise("method"))
    fields = inside.filter("role = 'field' and holder_role = 'type' and holder_kind in ('class', 'enum')").withColumn("role", F.lit("constant"))
    consts = rows.filter("role = 'constant'").join(rows.filter("role = 'callable' and kind = 'function'").select(*keys, "name", "start"), [*keys, "name", "start"], "left_anti")
    out = [*keys, "role", "kind", "name", "start", "end", "at", "modifiers"]
    kept = rows.filter("role in ('type', 'barrier', 'callable')").select(*out)
    return kept.unionByName(methods.select(*out)).unionByName(fields.select(*out)).unionByName(consts.select(*out))


def imports_in(t: DataFrame, keys: list[str], files: DataFrame, content: str) -> DataFrame:
    """keys, module, bindings (imported_name, alias), is_wildcard, modifiers, start, end of imports, and of require with a literal."""
    token, java = F.col("token"), F.col("java")
    order = Window.partitionBy(*keys).orderBy("pos")
    text = token.rlike("^['\"]")
    columns = ("java", "pos", "token", "start", "end", "prev", "prev2", "next", "next2", "next3", "next_start", "block", "round")
    t = t.select(*keys, *columns, F.when(F.col("shut_pos").isNotNull(), F.struct(F.col("shut_pos").alias("pos"), F.col("shut_end").alias("end"))).alias("shut"))
    head = (token == "import") & (F.col("block") == -1) & (F.col("round") == 0) & ~F.coalesce(F.col("next").isin("(", "."), F.lit(False))
    t = t.withColumn("import", F.sum(F.when(head, 1).otherwise(0)).over(order))
    stop = F.when(java, token == ";").otherwise(text)
    t = t.withColumn("stops", F.coalesce(F.sum(F.when(stop, 1).otherwise(0)).over(Window.partitionBy(*keys, "import").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # require("m"), also declared as a name, which then stands for the whole module, or as a pattern of its parts.
    side = Window.partitionBy(*keys, "block", "round").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    declares = F.coalesce(F.last(F.when(token.isin("const", "let", "var"), True).when(token == ";", False), ignorenulls=True).over(side), F.lit(False))
    t = t.withColumn("declares", declares).withColumn("shut2", F.lead("shut").over(order)).withColumn("prev3", F.lag("token", 3).over(order)).withColumn("pos2", F.lag("pos", 2).over(order))
    for c in ("pos", "start", "end"):
        t = t.withColumn(f"text_{c}", F.lead(c, 2).over(order))
    written = (F.col("import") > 0) & (F.col("stops") == 0)
    needs = ~java & (token == "require") & (F.col("next") == "(") & F.col("next2").rlike("^['\"]") & (F.col("next3") == ")") & ~F.coalesce(F.col("prev") == ".", F.lit(False))
    opens = (token == "{") & F.col("declares") & F.col("prev").isin("const", "let", "var", ",")
    t = t.withColumns({"written": written, "needs": F.coalesce(needs, F.lit(False)), "opens": F.coalesce(opens, F.lit(False))})
    # What may stand in a pattern: what lies before the last end of the patterns begun so far.
    reach = F.max(F.when(F.col("opens"), F.col("shut.pos"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("reached", F.coalesce(F.col("pos") < reach, F.lit(False))).filter("written or needs or opens or reached")
    t = materialize(t, "syntax-imports")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"])
    last = F.max(F.struct("pos", "token", "start", "end"))
    rows = t.filter("written").groupBy(*keys, "java", "import").agg(parts.alias("parts"), last.alias("last"), F.min("start").alias("start"), F.max(F.when(stop, F.when(F.col("java") | (F.col("next") != ";"), F.col("end")).otherwise(F.col("next_start") + 1))).alias("end"))
    line = F.array_join("parts", " ")
    rows = rows.filter("end is not null").withColumn("line", line)
    name = r"[\w$]+"
    dotted = F.regexp_replace(F.regexp_replace("line", r"^import (?:static )?|;$| ", ""), r"\.\*$", "")
    inner = F.filter(F.split(F.regexp_extract("line", r"\{ ?(.*?) ?,? ?\}", 1), " , "), lambda x: x != "")
    binding = lambda a, b: F.struct(a.alias("imported_name"), b.alias("alias"))
    each = F.transform(inner, lambda x: binding(F.regexp_extract(x, rf"^(?:type )?({name})", 1), F.nullif(F.regexp_extract(x, rf" as ({name})$", 1), F.lit(""))))
    default, space = F.regexp_extract("line", rf"^import (?:type )?({name}) (?:,|from)", 1), F.regexp_extract("line", rf"\* as ({name})", 1)
    one = lambda n, cond: F.when(cond != "", F.array(binding(F.lit(n), cond))).otherwise(F.array().cast("array<struct<imported_name:string,alias:string>>"))
    bindings = F.when(java, one("", F.lit(""))).otherwise(F.concat(one("default", default), one("*", space), each))
    wild = F.when(java, F.col("line").rlike(r"\* ;$")).otherwise(space != "")
    # The literal that names a module; Java's names are none.
    literal = F.when(~java, F.col("last"))
    static = F.when(java & F.col("line").startswith("import static "), F.array(F.lit("static"))).otherwise(F.array().cast("array<string>"))
    listed = rows.select(*keys, F.when(java, dotted).alias("module"), literal.alias("literal"), bindings.alias("bindings"), wild.alias("is_wildcard"), static.alias("modifiers"), "start", "end")
    declared = F.coalesce(F.col("declares") & F.col("prev3").isin("const", "let", "var", ","), F.lit(False))
    needed = t.filter("needs")
    to = F.when(declared & (F.col("prev") == "=") & F.col("prev2").rlike(NAME), F.col("prev2")).otherwise("")
    behind = F.when((F.col("prev") == "=") & (F.col("prev2") == "}"), F.col("pos2"))
    needed = needed.select(*keys, "pos", behind.alias("closes"), F.struct(F.col("text_pos").alias("pos"), F.col("next2").alias("token"), F.col("text_start").alias("start"), F.col("text_end").alias("end")).alias("literal"), one("*", to).alias("whole"), (to != "").alias("is_wildcard"), "start", F.col("shut2.end").alias("end"))
    # The pattern's own tokens are those of the block that its brace opens; a part is a name, or a name, a colon and a name.
    patterns = t.filter("opens").select(*keys, F.col("pos").alias("block"), F.col("shut.pos").alias("closes"))
    patterns = needed.filter("closes is not null").select(*keys, "closes", F.col("pos").alias("at")).join(patterns, [*keys, "closes"])
    within = t.filter("reached").select(*keys, "block", "round", "pos", "token").join(patterns, [*keys, "block"])
    comma = (token == ",") & (F.col("round") == 0)
    part = F.sum(F.when(comma, 1).otherwise(0)).over(Window.partitionBy(*keys, "at").orderBy("pos"))
    pieces = within.withColumn("part", part).filter(~comma).groupBy(*keys, "at", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("parts"))
    p0, p2 = F.get("parts", F.lit(0)), F.get("parts", F.lit(2))
    short = (F.size("parts") == 1) & p0.rlike(NAME)
    pair = (F.size("parts") == 3) & p0.rlike(NAME) & (F.get("parts", F.lit(1)) == ":") & p2.rlike(NAME)
    named = F.array_sort(F.collect_list(F.struct("part", binding(p0, F.when(pair, F.nullif(p2, p0))).alias("binding"))))
    pieces = pieces.filter(short | pair).groupBy(*keys, F.col("at").alias("pos")).agg(F.transform(named, lambda x: x["binding"]).alias("named"))
    required = needed.join(pieces, [*keys, "pos"], "left").select(*keys, F.lit(None).cast("string").alias("module"), "literal", F.coalesce("named", "whole").alias("bindings"), "is_wildcard", F.array().cast("array<string>").alias("modifiers"), "start", "end")
    out = listed.unionByName(required).withColumn("range", F.struct("start", "end")).drop("start", "end")
    out = materialize(out.select("*", *[F.col("literal")[c].alias(c) for c in ("pos", "token", "start", "end")]), "syntax-modules")
    whole = spelled(out, keys, files, content, F.col("literal").isNotNull())
    module = F.coalesce("module", F.expr("substring(token, 2, length(token) - 2)"))
    return whole.select(*keys, module.alias("module"), "bindings", "is_wildcard", "modifiers", "range.start", "range.end")


def segments(t: DataFrame, keys: list[str], regions: DataFrame) -> DataFrame:
    """Tokens of regions (keys, at, from_pos, to_pos: pos, both exclusive; apart from each other), cut at commas.

    Adds at, segment (from 0) and top (in no bracket of any kind within the region). Round, square and curly brackets are nested by depth. A < opens a
    bracket too, unless an = stands before it in its segment: behind that it compares.
    """
    # A region's row stands behind the token that begins it, among the tokens of its file.
    columns = ["java", "token", "start", "end", "prev_end", "prev", "prev2"]
    none = [F.lit(None).cast(t.schema[c].dataType).alias(c) for c in columns]
    opened = regions.select(*keys, F.col("from_pos").alias("pos"), *none, F.struct("at", "from_pos", "to_pos").alias("region"))
    both = t.select(*keys, "pos", *columns, F.lit(None).cast(opened.schema["region"].dataType).alias("region")).unionByName(opened)
    order = Window.partitionBy(*keys).orderBy("pos", F.col("region").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    rows = both.withColumn("region", F.when(F.col("token").isNotNull(), F.last("region", ignorenulls=True).over(order))).filter("pos < region.to_pos")
    rows = rows.select(*keys, "pos", *columns, "region.at")
    token = F.col("token")
    here = Window.partitionBy(*keys, "at").orderBy("pos")
    upto, before = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    depth = F.sum(F.when(token.isin("(", "[", "{"), 1).when(token.isin(")", "]", "}"), -1).otherwise(0)).over(upto) - F.when(token.isin("(", "[", "{"), 1).otherwise(0)
    rows = rows.withColumn("depth", depth)
    flat = F.col("depth") == 0
    last = lambda x: F.coalesce(F.last(F.when((token == x) & flat, F.col("pos")), ignorenulls=True).over(before), F.lit(-1))
    typed = flat & (last("=") <= last(","))
    rows = rows.withColumn("turn", F.when(typed & (token == "<"), 1).when(typed & (token == ">"), -1).otherwise(0))
    rows = rows.withColumn("angle", F.sum("turn").over(upto) - F.greatest("turn", F.lit(0)))
    rows = rows.withColumn("top", flat & (F.col("angle") == 0) & (F.col("turn") == 0) & ~token.isin(")", "]", "}", "(", "[", "{"))
    rows = rows.withColumn("segment", F.coalesce(F.sum(F.when(F.col("top") & (token == ","), 1).otherwise(0)).over(before), F.lit(0)))
    return rows.filter(~(F.col("top") & (token == ",")))


def joined(cond: Column) -> Column:
    """The text of a group's tokens that meet a condition, with a blank where the source has white space or a comment; null for none."""
    text = F.concat(F.when(F.col("start") > F.col("prev_end"), " ").otherwise(""), "token").alias("text")
    found = F.array_sort(F.collect_list(F.when(F.coalesce(cond, F.lit(False)), F.struct(F.col("pos"), text))))
    return F.nullif(F.trim(F.array_join(F.transform(found, lambda x: x["text"]), "")), F.lit(""))


def parameters_of(t: DataFrame, marks: DataFrame, keys: list[str], owners: DataFrame, files: DataFrame, content: str) -> DataFrame:
    """keys, at, position, name, type_name, default_value_text of the parameters of callables (keys, at)."""
    token = F.col("token")
    opens = F.when(token == "(", F.struct("pos", "shut"))
    first = F.last(opens, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1))
    at = marks.select(*keys, "pos", "token", "shut", "bare").withColumn("first", first).join(owners.select(*keys, F.col("at").alias("pos")), [*keys, "pos"], "left_semi")
    regions = at.filter("bare is not null or first.shut is not null").select(*keys, F.col("pos").alias("at"), F.coalesce("bare.from_pos", "first.pos").alias("from_pos"), F.coalesce("bare.to_pos", "first.shut").alias("to_pos"))
    rows = segments(t, keys, regions)
    each = Window.partitionBy(*keys, "at", "segment")
    mark = lambda x: F.min(F.when(F.col("top") & (token == x), F.col("pos"))).over(each)
    far = F.lit(1 << 30)
    rows = rows.withColumn("eq", F.coalesce(mark("="), far)).withColumn("colon", F.coalesce(mark(":"), far)).withColumn("colon", F.least("colon", "eq"))
    # What annotations and decorators take: the at sign, its names, and their arguments.
    upto = Window.partitionBy(*keys, "at", "segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    within = F.last(F.when((token == "(") & (F.col("depth") == 0), F.coalesce(F.col("prev2") == "@", F.lit(False))), ignorenulls=True).over(upto)
    rows = rows.withColumn("noted", F.coalesce((token == "@") | (F.col("prev") == "@") | ((F.col("depth") > 0) | token.isin("(", ")")) & within, F.lit(False)))
    plain = ~F.col("noted") & ~token.isin("final", "public", "private", "protected", "readonly", "override")
    own = F.max(F.when(F.col("top") & token.rlike(NAME), F.col("pos"))).over(each)
    receiver = F.max(F.col("top") & (token == "this")).over(each)
    rows = rows.withColumn("plain", plain).withColumn("own", own).withColumn("receiver", receiver)
    rows = rows.withColumn("own", F.when(F.col("receiver"), F.min(F.when(F.col("top") & (token == "."), F.col("pos"))).over(each)).otherwise(F.col("own")))
    java = F.col("java")
    before_dot = F.last(F.when(F.col("receiver") & F.col("top") & token.rlike(NAME) & (F.col("pos") < F.col("own")), F.col("pos")), ignorenulls=True).over(each.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("own", F.when(F.col("receiver"), F.coalesce(before_dot, "own")).otherwise(F.col("own")))
    is_name = F.when(java, F.when(F.col("receiver"), F.col("pos") >= F.col("own")).otherwise(F.col("pos") == F.col("own"))).otherwise((F.col("pos") < F.col("colon")) & F.col("plain") & ~token.isin("...", "?"))
    is_type = F.when(java, F.col("plain") & ((F.col("pos") < F.col("own")) | ~F.col("receiver") & (F.col("pos") > F.col("own")))).otherwise((F.col("pos") > F.col("colon")) & (F.col("pos") < F.col("eq")))
    is_default = ~java & (F.col("pos") > F.col("eq"))
    rows = rows.select(*keys, "at", "segment", "pos", "token", "start", "end", "prev_end", is_name.alias("is_name"), is_type.alias("is_type"), is_default.alias("is_default"))
    rows = spelled(materialize(rows.filter("is_name or is_type or is_default"), "syntax-parameters"), keys, files, content, F.lit(True))
    out = rows.groupBy(*keys, "at", F.col("segment").cast("int").alias("position")).agg(joined(F.col("is_name")).alias("name"), joined(F.col("is_type")).alias("type_name"), joined(F.col("is_default")).alias("default_value_text"))
    return out.filter("name is not null")


def supertypes_of(t: DataFrame, marks: DataFrame, keys: list[str], owners: DataFrame, files: DataFrame, content: str) -> DataFrame:
    """keys, at, relation (base, implemented), position, type_name of the types (keys, at) named behind extends and implements."""
    at = marks.filter("head.role = 'type'").join(owners.select(*keys, F.col("at").alias("pos")), [*keys, "pos"], "left_semi")
    rows = segments(t, keys, at.select(*keys, F.col("pos").alias("at"), F.col("pos").alias("from_pos"), F.col("head.body").alias("to_pos")))
    token = F.col("token")
    clause = F.col("top") & token.isin("extends", "implements", "permits")
    order = Window.partitionBy(*keys, "at").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("clause", F.last(F.when(clause, token), ignorenulls=True).over(order)).withColumn("n", F.sum(F.when(clause, 1).otherwise(0)).over(order)).filter(~clause & F.col("clause").isin("extends", "implements"))
    rows = spelled(materialize(rows.select(*keys, "at", "clause", "n", "segment", "pos", "token", "start", "end", "prev_end"), "syntax-supertypes"), keys, files, content, F.lit(True))
    named = rows.groupBy(*keys, "at", "clause", "n", "segment").agg(joined(F.lit(True)).alias("type_name")).filter("type_name is not null")
    place = F.row_number().over(Window.partitionBy(*keys, "at", "clause").orderBy("segment")) - 1
    return named.select(*keys, "at", F.when(F.col("clause") == "extends", "base").otherwise("implemented").alias("relation"), place.alias("position"), "type_name")


class Facts:
    """Each with the keys: symbols, calls, imports and issues of the files; parameters and supertypes of the symbols. Computed when asked for.

    symbols: kind, name, qualified_name, parent_qualified_name, start, end, modifiers. calls: caller, callee, kind, start, end; the
    caller is the innermost callable around, unless a type or a barrier lies between. A scope that an issue touches is a barrier.
    """

    def __init__(self, files: DataFrame, keys: list[str], content: str, language: str):
        self.files, self.keys, self.content, self.language = files, keys, content, language

    @cached_property
    def parts(self) -> int:
        size = self.files.agg(F.sum(F.octet_length(self.content))).first()[0] or 0
        return -(-size // PART_BYTES) or 1

    @cached_property
    def tokens(self) -> DataFrame:
        return tokens(self.files, self.keys, self.content, self.language, self.parts)

    @cached_property
    def marks(self) -> DataFrame:
        t = tokens(self.files, self.keys, self.content, self.language, self.parts, kept_only=True)
        return materialize(marks_of(t, self.keys), "syntax-marks")

    @cached_property
    def issues(self) -> DataFrame:
        return materialize(syntax_issues(self.marks, self.keys), "syntax-issues")

    @cached_property
    def imports(self) -> DataFrame:
        return imports_in(self.tokens, self.keys, self.files, self.content)

    @cached_property
    def placed(self) -> DataFrame:
        """Scopes, constants and calls with the package and what is above them."""
        keys, marks = self.keys, self.marks
        found = materialize(heads(marks, keys), "syntax-heads")
        names = marks.filter("packaged").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("package"))
        names = names.withColumn("package", F.regexp_extract("package", r"([\w$.]+)$", 1))
        sites = marks.filter("site is not null").select(*keys, "site.*").join(found.filter("at is not null").select(*keys, "at"), [*keys, "at"], "left_anti")
        hurt = unsafe(found.select(*keys, "start", "end", "at"), self.issues, keys).select(*keys, "at", F.lit(True).alias("hurt")).distinct()
        scopes = found.join(hurt, [*keys, "at"], "left").withColumn("role", F.when(F.coalesce("hurt", F.lit(False)), F.when(F.col("role") == "constant", "gone").otherwise("barrier")).otherwise(F.col("role"))).filter("role <> 'gone'")
        rows = scopes.select(*keys, "role", "kind", "name", "start", "end", "at", "modifiers", F.lit(None).cast("string").alias("callee"), F.lit(False).alias("unowned"))
        rows = rows.unionByName(sites.select(*keys, F.lit("call").alias("role"), "kind", F.lit("").alias("name"), "start", "end", "at", F.lit(None).cast("array<string>").alias("modifiers"), "callee", "unowned"))
        rows = rows.withColumn("id", F.concat_ws(":", "role", "at")).withColumn("holds", F.col("role").isin("type", "callable", "barrier"))
        placed = materialize(ancestors(rows, keys, "id", ["role", "name"], "holds").join(names, keys, "left"), "syntax-placed")
        path = F.concat_ws(".", "package", F.nullif(F.array_join(F.transform("above", lambda a: a["name"]), "."), F.lit("")))
        return placed.withColumn("free", ~F.exists("above", lambda a: a["role"] == "barrier")).withColumn("path", path)

    @cached_property
    def declared(self) -> DataFrame:
        """The symbols with their role and the pos of their name or keyword."""
        above = F.when(F.size("above") > 0, F.col("path"))
        rows = self.placed.filter(F.col("role").isin("type", "callable", "constant") & F.col("free"))
        return rows.select(*self.keys, "at", "role", "kind", "name", F.concat_ws(".", F.nullif("path", F.lit("")), "name").alias("qualified_name"), above.alias("parent_qualified_name"), "start", "end", "modifiers").distinct()

    @cached_property
    def symbols(self) -> DataFrame:
        return self.declared.drop("at", "role")

    @cached_property
    def calls(self) -> DataFrame:
        owner = F.when(F.col("free") & ~F.col("unowned") & (F.try_element_at("above", F.lit(-1))["role"] == "callable"), F.col("path"))
        return self.placed.filter("role = 'call'").select(*self.keys, owner.alias("caller"), "callee", "kind", "start", "end")

    def of_symbols(self, rows: DataFrame, *columns: str) -> DataFrame:
        known = self.declared.select(*self.keys, "at", "qualified_name", F.col("start").alias("owner_start"))
        return rows.join(known, [*self.keys, "at"]).select(*self.keys, "qualified_name", "owner_start", *columns)

    @cached_property
    def parameters(self) -> DataFrame:
        found = parameters_of(self.tokens, self.marks, self.keys, self.declared.filter("role = 'callable'"), self.files, self.content)
        return self.of_symbols(found, "position", "name", "type_name", "default_value_text")

    @cached_property
    def supertypes(self) -> DataFrame:
        found = supertypes_of(self.tokens, self.marks, self.keys, self.declared.filter("role = 'type'"), self.files, self.content)
        return self.of_symbols(found, "relation", "position", "type_name")


def facts(files: DataFrame, keys: list[str], content: str = "content", language: str = "language") -> Facts:
    """Facts of Java (language java) and ECMAScript (any other) files; null content has none."""
    return Facts(files, keys, content, language)
