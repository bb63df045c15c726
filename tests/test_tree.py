"""Nested sets against a plain walk."""

from __future__ import annotations

import random

import pytest

from conftest import tree
from sylva.operators.tree import nested_sets
from sylva.plans import sync


def fold(p):
    return p.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def plain(rows, search):
    """path -> (depth, pre, n_below, n_tracked_below, is_last, parent_has) by walking the tree."""
    inside = {p: t for p, _, t in rows if p.startswith(search.rstrip("/") + "/")}
    key = lambda p: [(fold(x), x) for x in p.split("/")]
    base = 0 if search == "/" else search.count("/")
    out = {}
    for i, p in enumerate(sorted(inside, key=key)):
        under = [q for q in inside if q.startswith(p + "/")]
        parent = p.rsplit("/", 1)[0] or "/"
        siblings = [q for q in inside if (q.rsplit("/", 1)[0] or "/") == parent]
        has = parent == search or any(inside[q] for q in inside if q.startswith(parent + "/"))
        out[p] = (p.count("/") - base, i, len(under), sum(inside[q] for q in under), p == max(siblings, key=key), has)
    return out


@pytest.mark.parametrize("parts", [1, 5, 23])
def test_nested_sets_equal_a_walk(spark, parts):
    rng = random.Random(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        names = ["a", "A", "b", "a-b", "a.b", "ä", "b c", "z"]
        files = {"/" + "/".join(rng.choices(names, k=rng.randint(1, 6))) for _ in range(160)}
        dirs = {f.rsplit("/", k)[0] for f in files for k in range(1, f.count("/"))} - {""}
        dirs |= {"/" + "/".join(f[1:].split("/")[:k]) for f in files for k in range(1, f.count("/"))}
        rows = [(p, p in dirs, rng.random() < 0.2) for p in sorted(files | dirs)]
        df = spark.createDataFrame([(p, d, t, "w" + p) for p, d, t in rows], "path string, is_dir boolean, tracked boolean, write_path string")
        for search in ("/", "/a", "/a/b", "/none"):
            got = {r.path: (r.depth, r.pre, r.n_below, r.n_tracked_below, r.is_last, r.parent_has) for r in nested_sets(df, search).collect()}
            assert got == plain(rows, search), search
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_listing_joins_no_files(spark):
    src = tree(spark, [("/x/a/f", False), ("/x/b/g", False)])
    res = sync.tree(src, [(1, "in", "/d", None), (2, "add", "/x/a/**", None)], search_path="/x", prune=True)
    plan = res.listing._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert [(r.path, r.pruned, r.pre) for r in res.listing.collect()] == [("/x/a", False, 0), ("/x/a/f", False, 1), ("/x/b", True, 2)]


def test_a_search_path_must_be_a_directory(spark):
    src = tree(spark, [("/x/a/f", False)])
    rules = [(1, "in", "/d", None), (2, "add", "/x/a/**", None)]
    with pytest.raises(FileNotFoundError):
        sync.tree(src, rules, search_path="/y")
    with pytest.raises(NotADirectoryError):
        sync.tree(src, rules, search_path="/x/a/f")
    assert sync.tree(src, rules, search_path="/x/").counts.first()["n_dirs"] == 1
