"""Stateless selection on a stream of inventory rows.

Normalising paths, resolving aliases, globs, ignores and the first-claim
``CASE`` are all row-wise, so they run unchanged on a streaming DataFrame
(for example new manifest files landing in a folder). Parent closure and the
diff need the whole snapshot and stay batch operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions import paths as P
from sylva.operators.paths import INVENTORY_COLUMNS
from sylva.operators.select import claimed
from sylva.plans.rules import RulePlan
from sylva.sources.inventory import INVENTORY_SCHEMA


def read_inventory_stream(spark: SparkSession, location: str, format: str = "parquet",
                          max_files_per_trigger: int | None = None) -> DataFrame:
    """Inventory manifests arriving as files below ``location``."""
    r = spark.readStream.format(format).schema(INVENTORY_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(location)


def select_stream(stream: DataFrame, plan: RulePlan) -> DataFrame:
    """Rows claimed by the rules with their destination path:
    ``rule_seq, read_path, write_path, rel_path`` and the inventory columns."""
    c = claimed(stream.select(*INVENTORY_COLUMNS), plan).withColumnRenamed("path", "read_path")
    rel = P.relative_to("read_path", "read_prefix")
    return (c.withColumn("rel_path", rel)
             .withColumn("write_path", P.join_path("write_prefix", "rel_path"))
             .select("rule_seq", "read_path", "write_path", "rel_path", "is_dir", "size", "mtime",
                     "content_hash"))


def start_selection(stream: DataFrame, plan: RulePlan, sink: str, checkpoint_location: str,
                    available_now: bool = True, format: str = "parquet"):
    """Write the selected rows to ``sink`` (files, append mode) with a
    checkpoint so a restarted query resumes where it stopped."""
    w = (select_stream(stream, plan).writeStream.format(format).outputMode("append")
         .option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(sink)


def ignored_stream(stream: DataFrame, plan: RulePlan, col: str = "path") -> DataFrame:
    """Rows the final ignores protect on the destination side (a row-wise
    filter, for monitoring a destination listing)."""
    rx = plan.final_ignore_regex
    return stream.where(F.lit(False)) if rx is None else stream.where(F.col(col).rlike(rx))
