"""Inventories and keyed snapshots derived from the driver's parquet tables.

Each frame is a pure projection of a given table, so its size grows with the
table. The derivations follow FIXTURES.md section 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.operators.paths import INVENTORY_COLUMNS, with_directories

# fixed values: file extensions chosen by doc_id % 5, in order 0..4
DOC_EXTENSIONS = [".txt", ".md", ".json", ".tmp", ".log"]
# fixed values: 2024-01-01T00:00:00Z in microseconds, the mtime origin
MTIME_ORIGIN_US = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ext(doc_id: Column) -> Column:
    return F.element_at(F.array(*[F.lit(e) for e in DOC_EXTENSIONS]), (doc_id % 5 + 1).cast("int"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files: one per document under ``/lake/<source>/<lang>/``."""
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    path = F.concat(
        F.lit("/lake/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"),
        F.when(doc % 17 == 0, F.lit(".")).otherwise(F.lit("")),
        F.lit("doc"), doc.cast("string"), _ext(doc),
    )
    return d.select(
        path.alias("path"),
        F.lit(False).alias("is_dir"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.timestamp_micros(F.lit(MTIME_ORIGIN_US) + doc * 1_000_000).alias("mtime"),
        F.sha2("text", 256).alias("content_hash"),
        doc.alias("doc_id"),
    )


def document_dest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destination files: the source under ``/backup`` with changes by doc_id % 10.

    3: left out; 4: '/doc' -> '/old' (rename); 5: size + 1 and hash changed;
    6: '/doc' -> '/stale', size + 7, hash changed. mtime moves by doc_id % 4 s.
    """
    s = document_files(spark, sf_dir)
    doc = F.col("doc_id")
    k = doc % 10
    p0 = F.concat(F.lit("/backup/"), F.expr("substr(path, 7)"))
    path = (F.when(k == 4, F.replace(p0, F.lit("/doc"), F.lit("/old")))
             .when(k == 6, F.replace(p0, F.lit("/doc"), F.lit("/stale")))
             .otherwise(p0))
    size = F.when(k == 5, F.col("size") + 1).when(k == 6, F.col("size") + 7).otherwise(F.col("size"))
    h = F.when(k.isin(5, 6), F.concat(F.lit("x"), F.col("content_hash"))).otherwise(F.col("content_hash"))
    mtime = F.timestamp_micros(F.lit(MTIME_ORIGIN_US) + doc * 1_000_000 + (doc % 4) * 1_000_000)
    return s.where(k != 3).select(
        path.alias("path"), F.lit(False).alias("is_dir"), size.alias("size"),
        mtime.alias("mtime"), h.alias("content_hash"), doc.alias("doc_id"),
    )


def documents_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source inventory (files and their directories)."""
    return with_directories(document_files(spark, sf_dir).select(*INVENTORY_COLUMNS))


def documents_dst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destination inventory (files and their directories)."""
    return with_directories(document_dest_files(spark, sf_dir).select(*INVENTORY_COLUMNS))


def pages_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, root, path`` with root = protocol + host and the URL path (both null for an invalid URL)."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id",
        F.concat(F.expr("try_parse_url(url, 'PROTOCOL')"), F.lit("://"), F.expr("try_parse_url(url, 'HOST')")).alias("root"),
        F.expr("try_parse_url(url, 'PATH')").alias("path"),
    )


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files ``/<user_id>/<event_type>/<event_id>``: ts as mtime,
    value in cents as size."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"),
                 F.lit("/"), F.col("event_id").cast("string")).alias("path"),
        F.lit(False).alias("is_dir"),
        F.round(F.col("value") * 100).cast("bigint").alias("size"),
        F.col("ts").cast("timestamp").alias("mtime"),
        F.sha2(F.coalesce(F.col("props"), F.lit("")), 256).alias("content_hash"),
        F.col("event_id"),
    )


def event_dest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second event inventory by event_id % 10: 3 left out; 4 renamed to
    ``r<id>``; 5 size + 1; 6 renamed to ``x<id>`` with size + 7. mtime moves by
    (event_id % 4) * 700 ms, so pairs 0-2.1 s apart occur."""
    s = event_files(spark, sf_dir)
    k = F.col("event_id") % 10
    path = (F.when(k == 4, F.regexp_replace("path", "/([0-9]+)$", "/r$1"))
             .when(k == 6, F.regexp_replace("path", "/([0-9]+)$", "/x$1"))
             .otherwise(F.col("path")))
    size = F.when(k == 5, F.col("size") + 1).when(k == 6, F.col("size") + 7).otherwise(F.col("size"))
    mtime = F.timestamp_micros(F.unix_micros("mtime") + (F.col("event_id") % 4) * 700_000)
    return s.where(k != 3).select(path.alias("path"), "is_dir", size.alias("size"),
                                  mtime.alias("mtime"), "content_hash", "event_id")


def events_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_directories(event_files(spark, sf_dir).select(*INVENTORY_COLUMNS))


def events_dst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_directories(event_dest_files(spark, sf_dir).select(*INVENTORY_COLUMNS))


def document_contents(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Documents as files with their text and no hash. At the destination, by doc_id % 10: 3 left out; 5 a character
    longer; 7 reversed (equal size, other bytes)."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    k, text, root = F.col("doc_id") % 10, F.col("text"), "/lake/"
    if side == "dst":
        d, root = d.where(k != 3), "/backup/"
        text = F.when(k == 5, F.concat(text, F.lit("!"))).when(k == 7, F.reverse(text)).otherwise(text)
    return d.select(F.concat(F.lit(root), "source", F.lit("/doc"), F.col("doc_id").cast("string")).alias("path"), F.lit(False).alias("is_dir"),
                    F.octet_length(text).cast("bigint").alias("size"), F.lit(None).cast("timestamp").alias("mtime"),
                    F.lit(None).cast("string").alias("content_hash"), text.alias("text"))


def chunks_of(contents: DataFrame, length: int = 1000) -> DataFrame:
    """``path, k, bytes``: texts as chunks of ``length`` characters."""
    last = F.greatest(F.floor((F.length("text") - 1) / length), F.lit(0)).cast("int")
    at = F.explode(F.sequence(F.lit(0), last)).alias("k")
    return contents.select("path", "text", at).select("path", "k", F.substring("text", F.col("k") * length + 1, F.lit(length)).cast("binary").alias("bytes"))


def dirty_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document files as a manifest that isn't in normal form: by doc_id % 5 relative, with ``./``, ``//``, ``..`` or a
    trailing separator; every seventh twice, the second a second younger and a byte larger; every 23rd also as a directory."""
    f = document_files(spark, sf_dir)
    k, p = F.col("doc_id"), F.col("path")
    rest = F.expr("substr(path, 7)")
    dirty = (F.when(k % 5 == 0, rest).when(k % 5 == 1, F.concat(F.lit("/lake/./"), rest)).when(k % 5 == 2, F.concat(F.lit("//lake//"), rest))
              .when(k % 5 == 3, F.concat(F.lit("/x/.hid/../../lake/"), rest)).otherwise(F.concat(p, F.lit("/"))))
    first = f.withColumn("path", dirty)
    again = f.where(k % 7 == 0).withColumn("size", F.col("size") + 1).withColumn("mtime", F.timestamp_micros(F.unix_micros("mtime") + 1_000_000))
    folder = f.where(k % 23 == 0).withColumn("is_dir", F.lit(True)).withColumn("mtime", F.timestamp_micros(F.unix_micros("mtime") + 9_000_000))
    cols = INVENTORY_COLUMNS
    return first.select(*cols).unionByName(again.select(*cols)).unionByName(folder.select(*cols))


def crowded_files(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Files of two sizes whose mtimes crowd, from ``documents``; every name differs between the sides.

    Even ids make a chain (size 7, 1.5 s apart, shifted by doc_id % 5 half seconds at the destination), odd ids a
    burst (size 8, all within 1.9 s). Ids divisible by 13 lack at the source, by 11 at the destination."""
    src = side == "src"
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k")).where(f"k % {13 if src else 11} <> 0")
    k, even = F.col("k"), F.col("k") % 2 == 0
    name = F.concat(F.lit("/lake/" if src else "/backup/"), F.when(even, "chain").otherwise("burst"), F.lit("/n" if src else "/o"), k.cast("string"))
    late = F.when(even, k * 750_000 + (0 if src else k % 5 * 500_000)).otherwise(k * (7919 if src else 104729) % 1900 * 1000)
    return d.select(name.alias("path"), F.lit(False).alias("is_dir"), F.when(even, 7).otherwise(8).cast("bigint").alias("size"),
                    F.timestamp_micros(F.lit(MTIME_ORIGIN_US) + late).alias("mtime"), F.lit(None).cast("string").alias("content_hash"))


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def orders_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(expected, actual) keyed snapshots of ``orders``.

    actual by o_orderkey % 10: 3 left out; 5 o_totalprice + 1; 6 key moved by
    +100,000,000 (a delete and an add); 7 o_orderpriority changed to null.
    """
    o = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    k = F.col("o_orderkey") % 10
    actual = o.where(k != 3).select(
        F.when(k == 6, F.col("o_orderkey") + 100_000_000).otherwise(F.col("o_orderkey")).alias("o_orderkey"),
        "o_custkey", "o_orderstatus",
        F.when(k == 5, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(k == 7, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    return o, actual
