"""Column functions over relative paths and repository addresses."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(name: Column) -> Column:
    """As pathlib has it: from the last dot, unless that is the first or the last character; leading dots don't count."""
    bare = F.regexp_replace(name, r"^\.+", "")
    return F.when(bare.rlike(r"^.+\.[^.]+$"), F.concat(F.lit("."), F.substring_index(bare, ".", -1))).otherwise("")


def is_safe_path(path: Column) -> Column:
    """A relative POSIX path without NUL, backslash, drive letter, leading slash, or empty, `.` and `..` parts."""
    bad = path.isNull() | (path == "") | path.contains("\x00") | path.contains("\\") | path.rlike(r"^/|^[A-Za-z]:") | F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))
    return ~bad


@cache
def folding() -> dict[str, str]:
    """The characters that full case folding changes, and what they become."""
    return {chr(c): chr(c).casefold() for c in range(0x110000) if chr(c).casefold() != chr(c)}


def folded(text: Column) -> Column:
    """Full case folding, as str.casefold: letters that fold to one by one translation, those that fold to several where a text has any."""
    changed = folding()
    single = {a: b for a, b in changed.items() if len(b) == 1}
    several = sorted((a, b) for a, b in changed.items() if len(b) > 1)
    one = F.translate(text, "".join(single), "".join(single.values()))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in several])
    return F.when(text.rlike("[" + "".join(a for a, _ in several) + "]"), F.aggregate(pairs, one, lambda t, p: F.replace(t, p["a"], p["b"]))).otherwise(one)


def path_order(path: Column) -> list[Column]:
    """Sort keys of the engine's total order: folded path, then path."""
    return [folded(path), path]


def repository_address(url: Column, host: str = "github.com") -> Column:
    """struct(accepted, owner, repo, normalized) of a repository root address.

    http or https, the host in any case, no user, port, query, fragment or percent sign; exactly an owner and a name, of
    which one final `.git` is dropped.
    """
    shape = r"(?i)^https?://" + host.replace(".", r"\.") + r"/([^/?#%@:\s]+)/([^/?#%@:\s]+)$"
    owner = F.regexp_extract(url, shape, 1)
    name = F.regexp_replace(F.regexp_extract(url, shape, 2), r"\.git$", "")
    accepted = F.coalesce(
        url.rlike(shape) & owner.rlike(r"^[A-Za-z0-9]([A-Za-z0-9-]{0,37}[A-Za-z0-9])?$") & name.rlike(r"^[A-Za-z0-9._-]{1,100}$") & ~name.isin(".", "..") & ~name.endswith(".git"),
        F.lit(False),
    )
    keep = lambda c: F.when(accepted, c)
    return F.struct(accepted.alias("accepted"), keep(owner).alias("owner"), keep(name).alias("repo"), keep(F.concat(F.lit(f"https://{host}/"), owner, F.lit("/"), name)).alias("normalized"))
