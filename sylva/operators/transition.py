"""From a change set to an ordered plan and the destination snapshot after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions import paths as P
from sylva.operators.paths import INVENTORY_COLUMNS

# fixed values: execution phase of each change type
PHASES = {"add": 1, "rename": 2, "delete": 3, "modify": 4}


def operation_plan(changes: DataFrame) -> DataFrame:
    """Execution order: additions (parents first), renames, deletions in
    reverse (children first), modifications. Each phase is in folded order of
    the destination path (renames by the new path).

    ``phase, change, source_path, dest_path`` sorted by one range sort; no
    global row numbers (they would need a single task).
    """
    phase = F.lit(None).cast("int")
    for k, v in PHASES.items():
        phase = F.when(F.col("change") == k, F.lit(v)).otherwise(phase)
    fold = P.fold("dest_path")
    is_del = F.col("change") == "delete"
    out = changes.select(phase.alias("phase"), "change", "source_path", "dest_path")
    return out.orderBy(
        F.col("phase"),
        F.when(~is_del, fold).asc_nulls_last(), F.when(~is_del, F.col("dest_path")).asc_nulls_last(),
        F.when(is_del, fold).desc_nulls_last(), F.when(is_del, F.col("dest_path")).desc_nulls_last(),
    )


def apply_changes(actual: DataFrame, changes: DataFrame) -> DataFrame:
    """The destination snapshot after running the plan, as a table.

    Removed: deleted paths, renamed-away paths and modified paths; added:
    copies of additions and modifications (source attributes, mtime kept as
    with a preserving copy) and renamed files (attributes of the moved file).
    Takes the wide change rows (see ``diff.WIDE_COLUMNS``).
    """
    gone = changes.where(F.col("change").isin("delete", "rename", "modify")).select(
        F.when(F.col("change") == "rename", F.col("source_path")).otherwise(F.col("dest_path")).alias("path"))
    kept = actual.select(*INVENTORY_COLUMNS).join(gone, "path", "left_anti")
    copied = changes.where(F.col("change").isin("add", "modify")).select(
        F.col("dest_path").alias("path"), "is_dir",
        F.when(F.col("is_dir"), F.lit(0).cast("bigint")).otherwise(F.col("size")).alias("size"),
        "mtime", "content_hash")
    moved = changes.where(F.col("change") == "rename").select(
        F.col("dest_path").alias("path"), F.col("d_is_dir").alias("is_dir"), F.col("d_size").alias("size"),
        F.col("d_mtime").alias("mtime"), F.col("d_hash").alias("content_hash"))
    return kept.unionByName(copied).unionByName(moved)
