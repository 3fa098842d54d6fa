"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import small_batches, texts

# The base patterns of the contract, in its order of kinds.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

#: Entropy rules: characters, shortest candidate, window, bits a character that a window needs.
CLASSES = {
    "entropy_hex": (re.compile(r"[0-9A-Fa-f]{24,}"), 24, 3.0),
    "entropy_base64": (re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 3.9),
}
#: Whole strings like these are no secrets: UUIDs, paths and dashed words.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[A-Za-z]+([-_/][A-Za-z]+)*",
    r"[0-9]+",
)
#: A window that overlaps one of these is no secret; the rest of its string still can be.
PLACEHOLDER = r"(?i)example|sample|placeholder|changeme|your[-_]|x{4,}|dummy"


def windows_over(s: str, window: int, least: float) -> list[tuple[int, int, float]]:
    """Merged runs of windows whose Shannon entropy reaches `least`, each with its highest entropy.

    With counts c in a window of w characters the entropy is log2(w) - sum(c log2 c) / w; one step takes one character out
    and one in, so that two terms of the sum change.
    """
    n, w = len(s), min(window, len(s))
    if not w:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, w + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    for ch in s[:w]:
        c = counts.get(ch, 0)
        total += term[c + 1] - term[c]
        counts[ch] = c + 1
    runs: list[list] = []
    for i in range(n - w + 1):
        if i:
            gone, new = s[i - 1], s[i + w - 1]
            c = counts[gone]
            total += term[c - 1] - term[c]
            counts[gone] = c - 1
            c = counts.get(new, 0)
            total += term[c + 1] - term[c]
            counts[new] = c + 1
        bits = math.log2(w) - total / w
        if bits >= least - 1e-9:
            if runs and i <= runs[-1][1]:
                runs[-1][1] = i + w
                runs[-1][2] = max(runs[-1][2], bits)
            else:
                runs.append([i, i + w, bits])
    return [tuple(r) for r in runs]


def mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def without(s: str, placeholder: re.Pattern) -> Iterator[tuple[int, str]]:
    """The parts of s between placeholders, each with its place."""
    at = 0
    for m in placeholder.finditer(s):
        yield at, s[at : m.start()]
        at = m.end()
    yield at, s[at:]


def find_secrets(text: str, classes=CLASSES, allow=None, placeholder=re.compile(PLACEHOLDER)) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, bits) by start, then kind; offsets in code points. Base spans stay whatever is allowed."""
    allow = allow or re.compile("|".join(f"(?:{a})" if not a.startswith("(?i)") else f"(?i:{a[4:]})" for a in ALLOW))
    found = [("assign", m.start(), m.end(), 0.0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [("access", m.start(), m.end(), 0.0) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), 0.0) for m in HEX.finditer(text)]
    for kind, (pattern, window, least) in classes.items():
        for m in pattern.finditer(text):
            s = m[0]
            if not mixed(s) or allow.fullmatch(s):
                continue
            for at, part in without(s, placeholder):
                if len(part) < window:  # no whole window between placeholders
                    continue
                for a, b, bits in windows_over(part, window, least):
                    if mixed(part[a:b]) and not allow.fullmatch(part[a:b]):
                        found.append((kind, m.start() + at + a, m.start() + at + b, round(bits, 6)))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


SPAN = "array<struct<kind:string,start:int,end:int,bits:double>>"


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """doc_id and `secrets`, the spans of every whole text; one row in, one row out, no shuffle.

    Null or empty text: no spans. Very long texts: one pass, linear in the text. Repeated rows: each its own row.
    """
    small_batches(docs.sparkSession)
    parts = [f"(?i:{a[4:]})" if a.startswith("(?i)") else f"(?:{a})" for a in allow]

    @F.pandas_udf(SPAN)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        allowed = re.compile("|".join(parts) or r"(?!)")
        for batch in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end", "bits"), f, strict=True)) for f in find_secrets(t, allow=allowed)] for t in batch])

    return texts(docs, id_col, text_col).select("doc_id", scan("text").alias("secrets"))


def redact(text: str, mask: str = "[SECRET]") -> str:
    """The text with each merged run of secret spans replaced by the mask."""
    out, at = [], 0
    for _, a, b, _ in find_secrets(text):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with secrets masked in the text; a null text stays null."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def masked(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else redact(t))

    return docs.withColumn(text_col, masked(docs[text_col]))
