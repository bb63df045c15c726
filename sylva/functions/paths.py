"""Column expressions over absolute, normal ``/``-separated path strings.

Everything here is a Catalyst built-in (no Python UDF), so it stays inside
whole-stage codegen and runs unchanged on streaming DataFrames.
"""

from __future__ import annotations

import posixpath
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fold(col: ColumnOrName) -> Column:
    """ASCII-only lower case (bytes above 127 are kept as they are)."""
    return F.translate(_c(col), string.ascii_uppercase, string.ascii_lowercase)


def parts(col: ColumnOrName) -> Column:
    """Segments of a path without the empty root element: '/a/b' -> [a, b]."""
    return F.filter(F.split(_c(col), "/"), lambda x: x != "")


def depth(col: ColumnOrName) -> Column:
    return F.size(parts(col))


def name(col: ColumnOrName) -> Column:
    return F.substring_index(_c(col), "/", -1)


def parent(col: ColumnOrName) -> Column:
    """Parent directory ('/' for top-level names, null for the root itself)."""
    c = _c(col)
    p = F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    return F.when(c == "/", F.lit(None)).when(p == "", F.lit("/")).otherwise(p)


def join_path(prefix: ColumnOrName, rel: ColumnOrName) -> Column:
    """prefix / rel for an absolute prefix (the root '/' needs no extra '/')."""
    p = _c(prefix)
    return F.when(p == "/", F.concat(F.lit("/"), _c(rel))).otherwise(F.concat(p, F.lit("/"), _c(rel)))


def is_below(col: ColumnOrName, prefix: str) -> Column:
    """True when the path lies strictly below ``prefix`` (a literal)."""
    if prefix == "/":
        return _c(col) != "/"
    return _c(col).startswith(prefix.rstrip("/") + "/")


def relative_to(col: ColumnOrName, prefix: ColumnOrName) -> Column:
    """Path with ``prefix`` and the following separator cut off."""
    p = _c(prefix)
    start = F.when(p == "/", F.lit(2)).otherwise(F.length(p) + 2)
    return F.substr(_c(col), start)


def ancestors(col: ColumnOrName, base: ColumnOrName | None = None) -> Column:
    """Array of the proper ancestors of a path, top down, without the root.

    With ``base`` only ancestors strictly below ``base`` are returned.
    """
    ps = parts(col)
    n = F.size(ps)
    if base is None:
        start = F.lit(1)
    else:
        b = _c(base)
        start = F.when(b == "/", F.lit(1)).otherwise(F.size(parts(b)) + 1)
    return F.when(
        n - 1 >= start,
        F.transform(
            F.sequence(start, n - 1),
            lambda k: F.concat(F.lit("/"), F.array_join(F.slice(ps, 1, k), "/")),
        ),
    ).otherwise(F.array().cast("array<string>"))


def sibling_key(col: ColumnOrName) -> Column:
    """Sort key giving pre-order with siblings in folded (ASCII case-blind) order.

    Each segment becomes (folded, raw), so names equal after folding still keep
    their subtrees apart.
    """
    return F.transform(parts(col), lambda x: F.struct(fold(x).alias("f"), x.alias("r")))


# ---------------------------------------------------------------------------
# Plain-Python helpers for the few rule strings handled on the driver.


def normalize_text(path: str, base: str = "/") -> str:
    """Lexical normal form of one path string, made absolute against ``base``."""
    if not path.startswith("/"):
        path = base.rstrip("/") + "/" + path
    out: list[str] = []
    for seg in path.split("/"):
        if seg in ("", "."):
            continue
        if seg == "..":
            if out:
                out.pop()
            continue
        out.append(seg)
    return "/" + "/".join(out)


def normalize_relative_text(path: str) -> str:
    """Lexical normal form that keeps a relative path relative (for ignores)."""
    if path.startswith("/"):
        return normalize_text(path)
    norm = posixpath.normpath(path) if path else ""
    return "" if norm == "." else norm
