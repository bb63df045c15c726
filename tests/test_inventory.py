"""Listings, manifests, normal form."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import ts
from sylva.functions.paths import normalize_text
from sylva.operators.paths import normalize_paths
from sylva.sources import inventory as Inv
from sylva.sources.listing import ListingReader, read_listing

COLUMNS = "path string, is_dir boolean, size bigint, mtime timestamp, content_hash string"


def grow(root, names):
    for n in names:
        p = os.path.join(root, n)
        if n.endswith("/"):
            os.makedirs(p, exist_ok=True)
        else:
            os.makedirs(os.path.dirname(p), exist_ok=True)
            with open(p, "w") as f:
                f.write(n)


NAMES = ["a.txt", ".hidden", "_SUCCESS", "empty/", ".dot/empty/", "d/e/f/g.txt", "d/e/f/.h", "d/_x/y", *(f"many/{k}/n{k}" for k in range(30))]


@pytest.mark.parametrize("groups", [1, 3, 500])
def test_a_listing_has_every_name_and_empty_directories(spark, tmp_path, groups):
    root = str(tmp_path)
    grow(root, NAMES)
    os.symlink(os.path.join(root, "d"), os.path.join(root, "d/e/back"))  # a cycle
    os.symlink(os.path.join(root, "nowhere"), os.path.join(root, "broken"))
    want = {}
    for d, dirs, files in os.walk(root):
        for n in dirs + files:
            p = os.path.join(d, n)
            want[p] = os.path.isdir(p), 0 if os.path.isdir(p) or not os.path.exists(p) else os.path.getsize(p)
    rows = read_listing(spark, root, groups).collect()
    assert {r.path: (r.is_dir, r.size) for r in rows} == want and len(rows) == len(want)
    parts = ListingReader({"path": root, "groups": str(groups)}).partitions()
    assert len(parts) <= max(1, groups)


def test_a_listing_of_nothing_or_of_no_directory_is_empty(spark, tmp_path):
    assert read_listing(spark, str(tmp_path)).count() == 0
    assert read_listing(spark, str(tmp_path / "none")).count() == 0


def test_scan_listing_strips_the_prefix(spark, tmp_path):
    grow(str(tmp_path), NAMES)
    inv = Inv.scan_inventory(spark, str(tmp_path), "listing", strip_prefix=str(tmp_path))
    got = {r.path: r.is_dir for r in inv.collect()}
    assert got["/.dot/empty"] and got["/d"] and not got["/_SUCCESS"] and len(got) == inv.count()


def manifest(spark, tmp_path, rows):
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "m"))
    return str(tmp_path / "m")


def test_a_dirty_manifest_is_a_set_of_normal_paths(spark, tmp_path):
    at = manifest(spark, tmp_path, [
        ("/b/old", False, 1, ts(1), "x"), ("/b/./old", False, 2, ts(5), "y"), ("/b//old/", False, 3, ts(2), "z"),
        ("/b/c", True, 0, None, None), ("/b/x/../c", False, 7, ts(0), "f"),
        ("rel/q", False, 1, ts(0), "r"), ("/b/old", False, 1, ts(1), "x"), ("/", True, 0, None, None)])
    got = {r.path: (r.is_dir, r.size, r.content_hash) for r in Inv.scan_inventory(spark, at, base="/base").collect()}
    assert got == {"/b/old": (False, 2, "y"), "/b/c": (False, 7, "f"), "/base/rel/q": (False, 1, "r"), "/": (True, 0, None),
                   "/b": (True, 0, None), "/base": (True, 0, None), "/base/rel": (True, 0, None)}


def test_a_normal_manifest_keeps_its_filters(spark, tmp_path):
    at = manifest(spark, tmp_path, [("/b/c", False, 7, ts(0), "f")])
    inv = Inv.scan_inventory(spark, at, normal=True, add_directories=False).where(F.col("path").startswith("/b/"))
    plan = inv._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,/b/)" in plan and "Exchange" not in plan
    assert inv.count() == 1


def test_normal_form_equals_the_plain_one(spark):
    rng = random.Random(2)
    texts = ["/", "", ".", "..", "/.", "/..", "//", "/a", "a", "/a/", "/a/.", "/a/..", "/./", "/../a", "/a/./b//c/../d", "/...", "/a/..b", "/.a", "a/."]
    texts += ["".join(rng.choices(["/", ".", "..", "a", "bc", "/", "...", "\n"], k=rng.randint(1, 9))) for _ in range(1500)]
    df = spark.createDataFrame([(t, t) for t in texts], "raw string, path string")
    for r in normalize_paths(df, base="/base/x").collect():
        assert r.path == normalize_text(r.raw, "/base/x"), r.raw
