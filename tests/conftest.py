from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sylva.session import builder, ensure_checkpoint_dir  # noqa: E402

INV_SCHEMA = "path string, is_dir boolean, size bigint, mtime timestamp, content_hash string"
EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="session")
def spark():
    s = (builder("local[4]", shuffle_partitions=4)
         .config("spark.driver.memory", "4g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    # tests set their own checkpoint folder only because none is configured
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="sylva-test-ckpt-"))
    yield s
    s.stop()


def ts(seconds: float) -> dt.datetime:
    return EPOCH + dt.timedelta(seconds=seconds)


def inventory(spark, rows):
    """Rows ``(path, is_dir, size, mtime_seconds, hash)``; files may omit the
    last three (size 1, mtime 0, hash = path name)."""
    out = []
    for r in rows:
        path, is_dir = r[0], r[1]
        size = r[2] if len(r) > 2 else (0 if is_dir else 1)
        mtime = ts(r[3]) if len(r) > 3 and r[3] is not None else (None if is_dir else ts(0))
        h = r[4] if len(r) > 4 else (None if is_dir else "h:" + path.rsplit("/", 1)[-1])
        out.append((path, is_dir, size, mtime, h))
    return spark.createDataFrame(out, INV_SCHEMA)


def tree(spark, files, dirs=()):
    """Inventory of the given files plus every ancestor directory."""
    from sylva.operators.paths import with_directories

    return with_directories(inventory(spark, list(files) + [(d, True) for d in dirs]))
