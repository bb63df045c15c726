"""Projections on path columns: normal form, root aliases, parents, rebasing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions import paths as P

INVENTORY_COLUMNS = ["path", "is_dir", "size", "mtime", "content_hash"]


def normalize_paths(df: DataFrame, col: str = "path", base: str = "/",
                    backslash_separator: bool = False, with_parts: bool = True) -> DataFrame:
    """Lexical normal form of ``col``; adds ``parts, parent, name, depth``.

    ``.`` and empty segments are dropped, ``..`` removes the segment before it
    (never above the root), a trailing separator goes, and relative paths are
    made absolute against ``base``. ``backslash_separator`` treats ``\\`` as a
    separator too.
    """
    c = F.col(col)
    if backslash_separator:
        c = F.translate(c, "\\", "/")
    base_norm = P.normalize_text(base)
    absolute = F.when(c.startswith("/"), c).otherwise(F.concat(F.lit(base_norm.rstrip("/") + "/"), c))
    # paths in normal form (nearly all) stay in generated code; of the others only
    # those with '..' need a stack
    short = F.regexp_replace(F.regexp_replace(absolute, "/(?:\\.?/)+", "/"), "(?<!^)/\\.?\\z|(?<=^/)\\.\\z", "")
    segs = F.filter(F.split(absolute, "/"), lambda x: (x != "") & (x != "."))
    stack = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(
            x == "..",
            F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc),
        ).otherwise(F.array_append(acc, x)),
    )
    up = absolute.rlike("/\\.\\.(?:/|\\z)")
    dirty = absolute.rlike("//|/\\.(?:/|\\z)|(?<!^)/\\z")
    out = df.withColumn(col, F.when(up, F.concat(F.lit("/"), F.array_join(stack, "/"))).when(dirty, short).otherwise(absolute))
    if with_parts:
        out = (out.withColumn("parts", P.parts(col))
                  .withColumn("parent", P.parent(col))
                  .withColumn("name", P.name(col))
                  .withColumn("depth", F.size("parts")))
    return out


def resolve_roots(df: DataFrame, aliases: DataFrame, col: str = "path") -> DataFrame:
    """Replace a leading alias segment of a relative path by its replacement.

    ``aliases`` has ``alias, replacement[, seq]``; duplicates keep the lowest
    ``seq`` (first definition). Matching is case-sensitive and only the first
    segment is looked at; absolute paths are left alone.
    """
    if "seq" in aliases.columns:
        aliases = aliases.groupBy("alias").agg(F.min_by("replacement", "seq").alias("replacement"))
    a = aliases.select(F.col("alias").alias("_alias"), F.col("replacement").alias("_repl"))
    c = F.col(col)
    first = F.when(~c.startswith("/"), F.split(c, "/").getItem(0))
    rest = F.expr(f"substr(`{col}`, length(split(`{col}`, '/')[0]) + 2)")
    joined = df.withColumn("_first", first).join(a, F.col("_first") == F.col("_alias"), "left")
    resolved = F.when(F.col("_alias").isNull(), c).when(
        F.length(c) == F.length("_alias"), F.col("_repl")
    ).otherwise(F.concat(F.regexp_replace("_repl", "/+$", ""), F.lit("/"), rest))
    return joined.withColumn(col, resolved).drop("_first", "_alias", "_repl")


def expand_parents(df: DataFrame, col: str = "path", base: str | None = None) -> DataFrame:
    """Directory rows for every ancestor of every path (ancestor closure).

    Returns the inventory columns for the new directory rows only; ancestors
    strictly below ``base`` when it is given, else all but the root. Distinct
    parents are taken first (files far outnumber directories), then their
    ancestors are exploded (bounded by depth) and made distinct.
    """
    parents = df.select(P.parent(col).alias("_p")).where(F.col("_p").isNotNull() & (F.col("_p") != "/")).distinct()
    if base is not None and P.normalize_text(base) != "/":
        parents = parents.where(P.is_below("_p", P.normalize_text(base)))
        up = P.ancestors("_p", F.lit(P.normalize_text(base)))
    else:
        up = P.ancestors("_p")
    dirs = parents.select(F.explode(F.array_union(up, F.array("_p"))).alias("path")).distinct()
    return dirs.select(
        "path",
        F.lit(True).alias("is_dir"),
        F.lit(0).cast("bigint").alias("size"),
        F.lit(None).cast("timestamp").alias("mtime"),
        F.lit(None).cast("string").alias("content_hash"),
    )


def with_directories(files: DataFrame, col: str = "path", base: str | None = None) -> DataFrame:
    """Inventory of ``files`` closed over its ancestor directories.

    Rows already present in ``files`` win over derived ones, files too: on an
    object store a path can be a file and lead to others.
    """
    files = files.select(*INVENTORY_COLUMNS)
    dirs = expand_parents(files, col, base).join(files.select("path"), "path", "left_anti")
    return files.unionByName(dirs)


def rebase(df: DataFrame, from_prefix: str, to_prefix: str, col: str = "path",
           out_col: str | None = None) -> DataFrame:
    """``from_prefix/rel`` becomes ``to_prefix/rel``; other paths are unchanged."""
    src = P.normalize_text(from_prefix)
    dst = P.normalize_text(to_prefix)
    c = F.col(col)
    rel = P.relative_to(c, F.lit(src))
    new = F.when(P.is_below(c, src), P.join_path(F.lit(dst), rel)).when(c == src, F.lit(dst)).otherwise(c)
    return df.withColumn(out_col or col, new)
