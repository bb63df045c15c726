"""Session settings shared by the library, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def builder(master: str | None = None, app: str = "sylva", shuffle_partitions: int | None = None,
            initial_partitions: int | None = None):
    """Session builder with the settings the operators rely on.

    On a cluster leave ``shuffle_partitions`` unset and give
    ``initial_partitions`` (e.g. inventory bytes / 128 MB): AQE starts from
    that many shuffle partitions, coalesces small ones to the advisory size
    and splits skewed join partitions.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf["spark.driver.memory"] = "8g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if initial_partitions:
        conf["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(initial_partitions)
        conf["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = "128m"
        conf["spark.sql.files.maxPartitionBytes"] = "256m"
    for k, v in conf.items():
        b = b.config(k, v)
    return b


def get_spark(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    spark = builder(master, shuffle_partitions=shuffle_partitions).getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is used as is; a
    cluster without it is an error, as executors don't share local folders. Only
    a local master (tests) gets a folder of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    local = fallback or tempfile.mkdtemp(prefix="sylva-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and read
    it back: the lineage is cut (a lost executor re-reads files instead of
    recomputing joins), the plan of later steps stays small, and the re-read
    carries file statistics the planner and AQE can use.

    One job (unlike an eager ``checkpoint()``, which computes the plan twice
    unless it is cached first).
    """
    import uuid

    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    target = f"{root}/sylva/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(target)
    _WRITTEN.append(target)
    return spark.read.parquet(target)


_WRITTEN: list[str] = []


def clear_materialized(spark: SparkSession, since: int = 0) -> int:
    """Delete the intermediate tables written by :func:`materialize` in this
    process (after the first ``since``). Call it once the results that read
    them have been written; any DataFrame still reading them becomes invalid.
    Returns the number removed."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while len(_WRITTEN) > since:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            fs.delete(path, True)
            n += 1
    return n


@contextmanager
def intermediates(spark: SparkSession):
    """Intermediate tables written inside the block go when it ends. Write what you want to keep before::

        with intermediates(spark):
            sync.check(src, dst, rules).public.write.parquet(out)
    """
    since = len(_WRITTEN)
    try:
        yield
    finally:
        clear_materialized(spark, since)
