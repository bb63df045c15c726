"""Pairing of file deletions with file additions of equal content (renames).

The reference walks additions in folded order of their destination path and
gives each the first still-unpaired deletion (in segment order) of equal size
that compares equal. Directories never take part.

* exact mode: equality (size + content hash) is transitive, so the k-th
  addition of a (size, hash) group gets the k-th deletion of that group. Both
  sides are numbered in one pass by the skew-safe :func:`group_row_number`,
  and one aggregate on (size, hash, k), with a row of either side at most in a
  group, makes the rename row: nothing is joined back.
* fast mode: equality is |mtime difference| < 2 s (sizes must still agree). It
  is not transitive, so the greedy order matters; see ``renames_fast``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions import paths as P
from sylva.operators.diff import FAST_TOLERANCE_US, WIDE_COLUMNS
from sylva.operators.ranking import group_row_number
from sylva.operators.renames_fast import pair_keys


def _file(kind: str) -> Column:
    return (F.col("change") == kind) & ~F.col("is_dir") & F.col("size").isNotNull()


def order_key() -> Column:
    """One string sort key for either side, so both are numbered in one pass.

    * additions: folded destination path, then the raw path as tie-break;
    * deletions: segment order, i.e. '/' replaced by a character below every
      other one, so a parent sorts before ``parent-x`` and ``parent/x``.
    """
    return (F.when(F.col("change") == "add", F.concat(P.fold("dest_path"), F.lit("\u0000"), F.col("dest_path")))
             .otherwise(F.translate(F.col("dest_path"), "/", "\u0001")))


def merge_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Wide change rows of additions and deletions, where an addition and a
    deletion of equal ``keys`` become one rename row. A group holds at most
    one row of either side."""
    whole = F.struct(*WIDE_COLUMNS)
    g = rows.groupBy(*keys).agg(F.any_value(F.when(F.col("change") == "add", whole), True).alias("a"),
                                F.any_value(F.when(F.col("change") == "delete", whole), True).alias("d"))
    both = F.col("a").isNotNull() & F.col("d").isNotNull()
    values = {c: F.coalesce(F.col(f"a.{c}"), F.col(f"d.{c}")) for c in WIDE_COLUMNS}
    values["change"] = F.when(both, F.lit("rename")).otherwise(values["change"])
    values["source_path"] = F.when(both, F.col("d.dest_path")).otherwise(values["source_path"])
    values["kind_changed"] = F.when(both, F.lit(False)).otherwise(values["kind_changed"])
    for c in ("d_is_dir", "d_size", "d_mtime", "d_hash"):
        values[c] = F.coalesce(F.col(f"d.{c}"), F.col(f"a.{c}"))
    return g.select(*[values[c].alias(c) for c in WIDE_COLUMNS])


def numbered(changes: DataFrame) -> DataFrame:
    """Additions and deletions whose (size, hash) the other side may have too,
    with their number ``rn`` on their side. Additions with no deletion of their
    size and hash (all of a first sync's) are not numbered."""
    dels = changes.where(_file("delete") & F.col("content_hash").isNotNull())
    wanted = dels.select("size", "content_hash").distinct()
    adds = changes.where(_file("add") & F.col("content_hash").isNotNull()).join(wanted, ["size", "content_hash"], "left_semi")
    rows = adds.select(*WIDE_COLUMNS).unionByName(dels.select(*WIDE_COLUMNS)).withColumn("_k", order_key())
    return group_row_number(rows, ["change", "size", "content_hash"], ["_k"], "rn")


def detect_renames(changes: DataFrame) -> DataFrame:
    """Exact-mode renames applied to wide changes.

    ``changes`` is read three times and should be a written table (``check``
    writes it)."""
    can_pair = (_file("add") | _file("delete")) & F.col("content_hash").isNotNull()
    wanted = changes.where(_file("delete") & F.col("content_hash").isNotNull()).select("size", "content_hash").distinct()
    unmatched = changes.where(_file("add") & F.col("content_hash").isNotNull()).join(wanted, ["size", "content_hash"], "left_anti")
    rest = changes.where(~F.coalesce(can_pair, F.lit(False)))
    return (merge_pairs(numbered(changes), ["size", "content_hash", "rn"])
            .unionByName(unmatched.select(*WIDE_COLUMNS)).unionByName(rest.select(*WIDE_COLUMNS)))


def rename_pairs(changes: DataFrame) -> DataFrame:
    """Exact-mode pairs ``old_path, new_path, size``."""
    merged = merge_pairs(numbered(changes), ["size", "content_hash", "rn"])
    return merged.where(F.col("change") == "rename").select(
        F.col("source_path").alias("old_path"), F.col("dest_path").alias("new_path"), "size")


# --------------------------------------------------------------------------
# fast mode


def _keyed_fast(changes: DataFrame, tolerance_us: int) -> tuple[DataFrame, DataFrame]:
    """File additions and deletions with a ``_pair`` key, and the other rows."""
    can_pair = F.coalesce((_file("add") | _file("delete")) & F.col("mtime").isNotNull(), F.lit(False))
    rows = changes.where(can_pair).select(*WIDE_COLUMNS)
    return pair_keys(rows, order_key(), tolerance_us), changes.where(~can_pair).select(*WIDE_COLUMNS)


def rename_pairs_fast(changes: DataFrame, tolerance_us: int = FAST_TOLERANCE_US) -> DataFrame:
    """Fast-mode pairs ``old_path, new_path``."""
    keyed, _ = _keyed_fast(changes, tolerance_us)
    return merge_pairs(keyed, ["_pair"]).where(F.col("change") == "rename").select(
        F.col("source_path").alias("old_path"), F.col("dest_path").alias("new_path"))


def detect_renames_fast(changes: DataFrame, tolerance_us: int = FAST_TOLERANCE_US) -> DataFrame:
    """Fast-mode renames applied to wide changes (a written table, as for ``detect_renames``)."""
    keyed, rest = _keyed_fast(changes, tolerance_us)
    return merge_pairs(keyed, ["_pair"]).unionByName(rest)
