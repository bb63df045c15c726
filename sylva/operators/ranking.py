"""Row numbers inside groups that may be very large.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends a whole group to one
task. When one group may hold a third of all rows (all empty files, say) that
task is the job. Here the rows are range-partitioned on ``(g, o)`` instead,
so a hot group spreads over many partitions; each row gets its position
inside its partition, and a small table of per-(partition, group) counts
gives the offset of each partition's piece of the group. The sorted, numbered
rows are written once below ``spark.checkpoint.dir`` and read back, so
partition ids and positions stay fixed if an executor is lost and a stage
is recomputed.

There is one way for groups of every size. Its offsets are a window over the
pieces of a group, which are at most as many as there are partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.session import materialize


def group_row_number(df: DataFrame, group_cols: list[str], order_cols: list[str], out_col: str = "rn") -> DataFrame:
    """``row_number()`` per group in ``order_cols`` order. Null group keys are
    equal; order keys should be unique within a group (paths are), else the
    order of equal rows is open (but stays as it was written)."""
    keys = [F.col(c) for c in [*group_cols, *order_cols]]
    # the place in the sorted partition: ids of a partition follow each other
    rows = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                         .withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_mid", 33)
    pieces = rows.groupBy(part.alias("_pid"), *group_cols).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("_pid", *[F.col(c).alias(f"_g_{c}") for c in group_cols],
                            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_off"))
    cond = part == F.col("_pid")
    for c in group_cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return rows.join(offsets, cond).select(*df.columns, (F.col("_mid") + F.col("_off")).alias(out_col))
