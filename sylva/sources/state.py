"""Persistent tables: the equivalence state and the change set.

State is written under a commit protocol. A save writes its rows to a folder of
its own (``data-<id>``) and then creates ``commits/<n>``, a file that names
the folder; the file is created only if it doesn't exist, so of two writers
that started from the same version one gets a :class:`StateConflict`. Readers
follow the last commit. A save that died half-way has no commit: nothing reads
its rows, nothing waits for it, and ``vacuum_state`` removes them. The folder
must be on storage that the cluster shares, whose create-if-absent is atomic
(HDFS, and object stores with conditional puts).

``save_bucketed`` writes a table in buckets by a path column. Where the
destination snapshot (by ``path``) and the state (by ``dest_path``) have as
many buckets, ``check`` looks verdicts up without an exchange.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.operators.diff import CHANGE_COLUMNS, STATE_COLUMNS

STATE_SCHEMA = ("source_path string, dest_path string, source_mtime timestamp, "
                "dest_mtime timestamp, equal boolean, rules_version string")


class StateConflict(RuntimeError):
    """Another writer has committed the version that this one meant to."""


def _fs(spark: SparkSession, directory: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _names(fs, path) -> list[str]:
    return [st.getPath().getName() for st in fs.listStatus(path)] if fs.exists(path) else []


def _commits(spark: SparkSession, directory: str) -> dict[int, str]:
    """Version -> data folder; '' for a commit whose writer died before it named one."""
    fs, path_of = _fs(spark, directory)
    root = directory.rstrip("/") + "/commits"
    out = {}
    for name in _names(fs, path_of(root)):
        if name.isdigit():
            with_lines = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
            stream = fs.open(path_of(f"{root}/{name}"))
            try:
                out[int(name)] = with_lines.toString(stream, "UTF-8").strip()
            finally:
                stream.close()
    return out


def live_version(spark: SparkSession, directory: str) -> int:
    """The last version that has a commit; 0 if there is none."""
    return max(_commits(spark, directory), default=0)


def load_equivalence_state(spark: SparkSession, directory: str, rules_version: str) -> DataFrame | None:
    """The live state, or None where nothing has been committed. A state written
    under other rules is void as a whole: the frame is empty then."""
    named = {n: folder for n, folder in _commits(spark, directory).items() if folder}
    if not named:
        return None
    df = spark.read.schema(STATE_SCHEMA).parquet(f"{directory.rstrip('/')}/{named[max(named)]}")
    return df.where(F.col("rules_version") == rules_version).select(*STATE_COLUMNS)


def save_equivalence_state(state: DataFrame, directory: str, based_on: int | None = None) -> int:
    """Write ``state`` and commit it as the version after ``based_on`` (the live one at the start of the save
    if not given; give the version that was loaded to notice saves since then). Returns the version."""
    spark, root = state.sparkSession, directory.rstrip("/")
    version = (live_version(spark, root) if based_on is None else based_on) + 1
    folder = f"data-{uuid.uuid4().hex}"
    state.select(*STATE_COLUMNS).write.mode("errorifexists").parquet(f"{root}/{folder}")
    commit(spark, root, version, folder)
    return version


def commit(spark: SparkSession, directory: str, version: int, folder: str) -> None:
    """Make a data folder the live version, if nobody has committed that version."""
    fs, path_of = _fs(spark, directory)
    try:
        out = fs.create(path_of(f"{directory.rstrip('/')}/commits/{version}"), False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise StateConflict(f"version {version} of {directory} has been committed by another writer") from None
        raise
    out.write(bytearray(folder.encode()))
    out.close()


def vacuum_state(spark: SparkSession, directory: str, keep: int = 1, min_age_seconds: float = 86_400) -> int:
    """Delete data folders that none of the last ``keep`` commits names and that nothing has been added to
    for ``min_age_seconds`` (a save may be writing them). Returns how many."""
    fs, path_of = _fs(spark, directory)
    named = {n: folder for n, folder in _commits(spark, directory).items() if folder}
    wanted = {named[n] for n in sorted(named)[-keep:]}
    root, n = path_of(directory), 0
    for st in fs.listStatus(root) if fs.exists(root) else []:
        name = st.getPath().getName()
        if name.startswith("data-") and name not in wanted and time.time() - st.getModificationTime() / 1000 >= min_age_seconds:
            fs.delete(st.getPath(), True)
            n += 1
    return n


def save_bucketed(df: DataFrame, table: str, column: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in sorted buckets by ``column`` and read it back."""
    writer = df.write.bucketBy(buckets, column).sortBy(column).mode("errorifexists")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def write_changes(changes: DataFrame, directory: str, mode: str = "errorifexists") -> None:
    """The change set, one folder per change type (``change=<type>``)."""
    changes.select(*CHANGE_COLUMNS).write.mode(mode).partitionBy("change").parquet(directory)


def read_changes(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.parquet(directory).select(*CHANGE_COLUMNS)
