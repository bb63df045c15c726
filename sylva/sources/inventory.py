"""Inventory sources: Parquet (or any table) manifests and raw file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.operators.paths import INVENTORY_COLUMNS, normalize_paths, with_directories
from sylva.sources.listing import read_listing

INVENTORY_SCHEMA = "path string, is_dir boolean, size bigint, mtime timestamp, content_hash string"


def one_row_per_path(rows: DataFrame) -> DataFrame:
    """An inventory as a set of paths. Of several rows of a path, files win over directories, then the latest
    mtime, the largest size and the greatest hash (nulls last)."""
    order = F.struct(~F.col("is_dir"), F.col("mtime"), F.col("size"), F.col("content_hash"))
    best = rows.groupBy("path").agg(F.max(order).alias("b"))
    return best.select("path", (~F.col("b.col1")).alias("is_dir"), F.col("b.size").alias("size"),
                       F.col("b.mtime").alias("mtime"), F.col("b.content_hash").alias("content_hash"))


def scan_inventory(spark: SparkSession, location: str, format: str = "parquet", base: str = "/",
                   add_directories: bool = True, strip_prefix: str | None = None, normal: bool = False,
                   options: dict | None = None) -> DataFrame:
    """An inventory table ``path, is_dir, size, mtime, content_hash``.

    * ``parquet`` / ``orc`` / ``json`` / ...: a manifest with those columns.
      Paths are brought to normal form and made distinct (``one_row_per_path``
      says which row wins). ``normal=True`` declares that they are so
      already: the path column is read as it is, so filters on it are pushed
      to the scan, and nothing is shuffled.
    * ``listing``: the complete tree below ``location``, hidden names and empty
      directories too (see ``listing``); hashes are null and come from
      ``content.equal_by_content`` where sizes agree.
    * ``binaryFile``: the files that Spark lists (names that start with ``.``
      or ``_`` and empty directories are missing); the content hash is SHA-256
      of the bytes. A listing that isn't complete must not drive deletions, so
      ``sync.check`` wants a manifest or a ``listing``.

    ``strip_prefix`` cuts a scheme and prefix off the path. With
    ``add_directories`` the rows are closed over their parent directories.
    """
    opts = dict(options or {})
    if format in ("binaryFile", "listing"):
        if format == "listing":
            raw = read_listing(spark, location, **opts).withColumn("content_hash", F.lit(None).cast("string"))
        else:
            opts.setdefault("recursiveFileLookup", "true")
            raw = spark.read.format("binaryFile").options(**opts).load(location).select(
                "path", F.lit(False).alias("is_dir"), F.col("length").cast("bigint").alias("size"),
                F.col("modificationTime").alias("mtime"), F.sha2(F.col("content"), 256).alias("content_hash"))
        path = F.col("path")
        if strip_prefix:
            path = F.when(path.startswith(strip_prefix), F.substr(path, F.lit(len(strip_prefix) + 1))).otherwise(path)
        else:
            path = F.regexp_replace(path, r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "")
        files = raw.withColumn("path", path).select(*INVENTORY_COLUMNS)
        files = normalize_paths(files, "path", base, with_parts=False)
    else:
        files = spark.read.format(format).options(**opts).load(location).select(*INVENTORY_COLUMNS)
        if not normal:
            files = one_row_per_path(normalize_paths(files, "path", base, with_parts=False).select(*INVENTORY_COLUMNS))
    return with_directories(files) if add_directories else files.select(*INVENTORY_COLUMNS)
