"""Summaries: totals, top lists, common parents and tree views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions import paths as P
from sylva.operators.ranking import group_row_number

# fixed values: change types in the order they are reported
CHANGE_TYPES = ["delete", "add", "modify", "rename"]


def change_totals(changes: DataFrame) -> DataFrame:
    """``change, n, up_to_date``: one row per change type and one ``total`` row.

    A single aggregate (partial counts on the map side), then a 5-way unpivot.
    """
    aggs = [F.count_if(F.col("change") == t).alias(t) for t in CHANGE_TYPES]
    one = changes.agg(*aggs, F.count(F.lit(1)).alias("total"))
    stack = "stack(5, " + ", ".join(f"'{t}', `{t}`" for t in CHANGE_TYPES + ["total"]) + ") as (change, n)"
    return (one.select(F.expr(stack), F.col("total"))
               .select("change", F.col("n").cast("bigint").alias("n"), (F.col("total") == 0).alias("up_to_date")))


# Up to this limit every map task may send as many rows of a type to one task.
GROUP_LIMIT = 1000


def top_changes(changes: DataFrame, limit: int = 50) -> DataFrame:
    """First ``limit`` rows per change type in folded order of the destination
    path (renames by their new path), by type and rank; ``n_more`` = rows left out
    of that type.
    A negative limit keeps everything.

    For a small limit ``row_number() <= limit`` becomes a ``WindowGroupLimit``:
    each partition keeps at most ``limit`` rows per type before the shuffle. A
    large one, or none, cuts by rank: rows are numbered over range partitions
    and their counts, so no type goes to one task whatever the limit.
    """
    counts = changes.groupBy("change").agg(F.count(F.lit(1)).alias("_n"))
    cols = ["change", "source_path", "dest_path"]
    if 0 <= limit <= GROUP_LIMIT:
        w = Window.partitionBy("change").orderBy(P.fold("dest_path"), "dest_path")
        ranked = changes.select(*cols, F.row_number().over(w).alias("rank"))
    else:
        ranked = group_row_number(changes.select(*cols, P.fold("dest_path").alias("_f")), ["change"], ["_f", "dest_path"], "rank")
    kept = ranked if limit < 0 else ranked.where(F.col("rank") <= limit)
    more = F.lit(0) if limit < 0 else F.greatest(F.col("_n") - limit, F.lit(0))
    return kept.join(counts, "change").select("change", F.col("rank").cast("bigint").alias("rank"), "source_path", "dest_path",
                                              more.cast("bigint").alias("n_more")).orderBy("change", "rank")


def common_parent(df: DataFrame, root_col: str = "root", path_col: str = "path",
                  is_dir_col: str | None = "is_dir") -> DataFrame:
    """Longest common ancestor of the paths of each root, on segment bounds.

    The common lead of all arrays equals that of their min and max, so one
    aggregate per root suffices. When every row of a root is the same file,
    its parent is used.
    """
    parts = P.parts(path_col)
    aggs = [F.min(parts).alias("_lo"), F.max(parts).alias("_hi")]
    if is_dir_col is not None:
        aggs.append(F.min(F.col(is_dir_col).cast("int")).alias("_dir"))
    g = df.groupBy(root_col).agg(*aggs)
    same = F.zip_with("_lo", "_hi", lambda a, b: F.coalesce(a == b, F.lit(False)))
    pos = F.array_position(same, False)
    n = F.when(pos > 0, pos - 1).otherwise(F.least(F.size("_lo"), F.size("_hi")))
    lead = F.slice("_lo", 1, n)
    whole = (F.size("_lo") == F.size("_hi")) & (n == F.size("_lo"))
    if is_dir_col is not None:
        is_file = whole & (F.col("_dir") == 0)
        lead = F.when(is_file, F.slice("_lo", 1, F.greatest(n - 1, F.lit(0)))).otherwise(lead)
    return g.select(root_col, F.concat(F.lit("/"), F.array_join(lead, "/")).alias("common_path"))


def tree_counts(rows: DataFrame, search_path: str) -> DataFrame:
    """Directories, files and their untracked ("ignored") shares below the
    search path: ``search_path, n_dirs, n_files, n_ignored_dirs, n_ignored_files``.
    ``rows``: ``path, is_dir, tracked`` (see ``select.flagged``); one aggregate."""
    d, t = F.col("is_dir"), F.col("tracked")
    return rows.where(P.is_below("path", search_path)).agg(
        F.count_if(d).alias("n_dirs"), F.count_if(~d).alias("n_files"),
        F.count_if(d & ~t).alias("n_ignored_dirs"), F.count_if(~d & ~t).alias("n_ignored_files"),
    ).select(F.lit(search_path).alias("search_path"), "*")


def _nothing_below():
    """Non-empty directories with nothing tracked below them."""
    return F.col("is_dir") & (F.col("n_below") > 0) & (F.col("n_tracked_below") == 0)


def pruned_subtrees(sets: DataFrame) -> DataFrame:
    """Topmost non-empty directories below the search path with nothing tracked
    below them: ``path, depth``. Their content collapses to one "(...)" row.
    ``sets``: the tree as nested sets (see ``tree.nested_sets``)."""
    return sets.where(_nothing_below() & F.col("parent_has")).select("path", "depth")


def tree_listing(sets: DataFrame, verbose: bool = False, prune: bool = False) -> DataFrame:
    """The tree as rows, in pre-order with siblings in folded order:
    ``path, depth, name, is_dir, tracked, is_last, pruned, dest, pre, n_below``.

    ``pre`` is the row's place in the whole tree (the order as a column),
    ``n_below`` the rows below it. ``dest`` (verbose) is the write path of
    tracked files and tracked empty directories. With ``prune`` a non-empty
    directory with nothing tracked below it is flagged ``pruned`` and the
    rows below it are dropped: those whose parent has nothing tracked below.
    """
    empty = F.col("n_below") == 0
    dest = F.when(F.col("tracked") & (~F.col("is_dir") | empty), F.col("write_path")) if verbose else F.lit(None).cast("string")
    rows = sets.where("parent_has") if prune else sets
    return rows.select("path", "depth", P.name("path").alias("name"), "is_dir", "tracked", "is_last",
                       (_nothing_below() if prune else F.lit(False)).alias("pruned"), dest.alias("dest"), "pre", "n_below").orderBy("pre")
