"""Diff, equality, state, orphans, renames, reports and convergence."""

from __future__ import annotations

import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import inventory, tree, ts
from sylva.operators import diff as D
from sylva.operators import renames as R
from sylva.operators import renames_fast as RF
from sylva.operators import report as Rep
from sylva.plans import sync
from sylva.sources import inventory as Inv
from sylva.sources import state as St
from sylva.streaming import select_stream as SS
from sylva.plans.rules import compile_rules

PLAIN = [(1, "in", "/d", None), (2, "add", "/r/**", None)]
WIDE = ("change string, source_path string, dest_path string, size bigint, kind_changed boolean, "
        "is_dir boolean, content_hash string, mtime timestamp, d_is_dir boolean, d_size bigint, "
        "d_mtime timestamp, d_hash string")


def wide(spark, adds, dels):
    """Wide change rows: adds/dels as (dest_path, size, hash, mtime_seconds)."""
    rows = [("add", "/src" + p, p, s, False, False, h, ts(t), None, None, None, None) for p, s, h, t in adds]
    rows += [("delete", None, p, s, False, False, h, ts(t), False, s, ts(t), h) for p, s, h, t in dels]
    return spark.createDataFrame(rows, WIDE)


def fold(p):
    return p.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def greedy(adds, dels, equal):
    """The plain loop: additions in folded order, deletions in segment order."""
    pairs, taken = [], set()
    for a in sorted(adds, key=lambda x: (fold(x[0]), x[0])):
        for d in sorted(dels, key=lambda x: x[0].split("/")):
            if d[0] not in taken and d[1] == a[1] and equal(a, d):
                taken.add(d[0])
                pairs.append((d[0], a[0]))
                break
    return sorted(pairs)


def _rand_paths(rng, n, prefix):
    return [f"/{rng.choice('abAB')}{prefix}/{rng.choice(['x', 'X', 'y-z', 'y'])}/{i}" for i in range(n)]


def test_exact_renames_match_greedy_loop(spark):
    rng = random.Random(3)
    for _ in range(2):
        adds = [(p, rng.choice([0, 0, 1, 2]), rng.choice("hk"), 0) for p in _rand_paths(rng, 40, "n")]
        dels = [(p, rng.choice([0, 0, 1, 2]), rng.choice("hk"), 0) for p in _rand_paths(rng, 40, "o")]
        got = sorted((r.old_path, r.new_path) for r in R.rename_pairs(wide(spark, adds, dels)).collect())
        assert got == greedy(adds, dels, lambda a, d: a[2] == d[2])


@pytest.mark.parametrize("block_rows", [100_000, 12])
def test_fast_renames_match_greedy_loop(spark, monkeypatch, block_rows):
    """Blocks of a few rows: most of an island is decided over several rounds."""
    monkeypatch.setattr(RF.pair_keys, "__defaults__", (block_rows,))
    rng = random.Random(5)
    # a chain 1.5 s apart at one size whose names follow the times, a burst, plus random rows
    adds = [(f"/n/c{i:03d}", 7, "h", i * 1.5) for i in range(60)]
    dels = [(f"/o/c{i:03d}", 7, "h", i * 1.5 + 0.7) for i in range(60)]
    adds += [(p, 8, "h", 100 + rng.uniform(0, 1.9)) for p in _rand_paths(rng, 30, "bn")]
    dels += [(p, 8, "h", 100 + rng.uniform(0, 1.9)) for p in _rand_paths(rng, 20, "bo")]
    adds += [(p, rng.choice([1, 2]), "h", rng.uniform(-30, 30)) for p in _rand_paths(rng, 120, "n")]
    dels += [(p, rng.choice([1, 2]), "h", rng.choice([rng.uniform(-30, 30), rng.randint(-9, 9)])) for p in _rand_paths(rng, 120, "o")]
    got = sorted((r.old_path, r.new_path) for r in R.rename_pairs_fast(wide(spark, adds, dels)).collect())
    assert got == greedy(adds, dels, lambda a, d: abs(a[3] - d[3]) < 2)


def test_a_block_decides_only_what_the_whole_loop_does():
    rng = random.Random(17)
    tol = 2_000_000
    for _ in range(300):
        n = rng.randint(1, 40)
        adds, dels = ([rng.randrange(0, 16 * tol, 250_000) for _ in range(n)] for _ in range(2))
        taken, want = set(), []
        for t in adds:
            d = next((k for k, x in enumerate(dels) if k not in taken and abs(x - t) < tol), None)
            taken.add(d)
            want.append(d)
        lo, hi = 5, 9
        near = [[k for k, t in enumerate(ts) if lo - 2 <= t // tol <= hi + 2] for ts in (adds, dels)]
        a, d = ([ts[k] for k in ks] for ts, ks in zip((adds, dels), near))
        own, whole = (np.array([x <= t // tol <= y for t in ts], bool) for ts, x, y in ((a, lo, hi), (d, lo - 1, hi + 1)))
        state, partner = RF.decide(np.array(a, np.int64), own, np.array(d, np.int64), whole, tol)
        for i, k in enumerate(near[0]):
            if state[i] == RF.TAKEN:
                assert near[1][partner[i]] == want[k] and own[i]
            elif state[i] == RF.FREE:
                assert want[k] is None and own[i]
        everything = np.ones(n, bool)
        state, partner = RF.decide(np.array(adds, np.int64), everything, np.array(dels, np.int64), everything, tol)
        assert [int(p) if s == RF.TAKEN else None for s, p in zip(state, partner)] == want


def test_a_first_sync_numbers_nothing(spark):
    adds = [(f"/n/{i}", 1, "h", 0) for i in range(20)]
    changes = wide(spark, adds, [])
    assert R.numbered(changes).count() == 0
    assert R.detect_renames(changes).count() == 20


def test_renames_join_nothing_back(spark):
    """After numbering, one exchange makes the rename rows."""
    changes = wide(spark, [("/n/a", 1, "h", 0)], [("/o/a", 1, "h", 0)])
    plan = R.merge_pairs(R.numbered(changes), ["size", "content_hash", "rn"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("LeftAnti") == 0  # the numbering's offsets


def test_three_empty_files_renamed(spark):
    src = tree(spark, [(f"/r/new{i}", False, 0, 0, "e") for i in range(3)])
    dst = tree(spark, [(f"/d/old{i}", False, 0, 0, "e") for i in range(3)])
    ch = sync.check(src, dst, PLAIN).public.collect()
    assert sorted((r.source_path, r.dest_path) for r in ch if r.change == "rename") == \
        [("/d/old0", "/d/new0"), ("/d/old1", "/d/new1"), ("/d/old2", "/d/new2")]
    assert all(r.change == "rename" for r in ch)


def test_fast_equal_tolerance_boundary(spark):
    src = tree(spark, [("/r/a", False, 1, 0), ("/r/b", False, 1, 0)])
    dst = tree(spark, [("/d/a", False, 1, 1.999999), ("/d/b", False, 1, 2.0)])
    ch = sync.check(src, dst, PLAIN, mode="fast", renames=False).public.collect()
    assert [(r.change, r.dest_path) for r in ch] == [("modify", "/d/b")]


def test_orphan_ignore_protects_ancestors(spark):
    src = tree(spark, [("/r/a", False)])
    dst = tree(spark, [("/d/a", False, 1, 0, "h:a"), ("/d/old/deep/er/keep.log", False), ("/d/old/x", False),
                       ("/d/gone/y", False)])
    rules = PLAIN + [(3, "ignore", "*.log", None)]
    dels = sorted(r.dest_path for r in sync.check(src, dst, rules).public.collect() if r.change == "delete")
    assert dels == ["/d/gone", "/d/gone/y", "/d/old/x"]


def test_empty_inventory_and_no_rules(spark):
    empty = inventory(spark, [])
    dst = tree(spark, [("/d/a", False)])
    assert sync.check(empty, dst, PLAIN).public.collect()[0].change == "delete"
    assert sync.check(tree(spark, [("/r/a", False)]), dst, []).public.count() == 0


def test_incremental_state_reuse(spark):
    src = tree(spark, [("/r/a", False, 1, 0, "h1"), ("/r/b", False, 1, 0, "h2")])
    dst = tree(spark, [("/d/a", False, 1, 5, "h1"), ("/d/b", False, 1, 5, "zz")])
    plan = compile_rules(PLAIN)
    first = sync.check(src, dst, plan, state=spark.createDataFrame([], St.STATE_SCHEMA))
    folder = tempfile.mkdtemp(prefix="sylva-state-")
    St.save_equivalence_state(first.state, folder)
    stored = St.load_equivalence_state(spark, folder, plan.version)
    pairs, new_state = D.incremental_equal(D.pair(first.expected, dst), stored, plan.version)
    hits = {r.dest_path: r.state_hit for r in pairs.where("source_path is not null and not s_is_dir").collect()}
    assert hits == {"/d/a": True, "/d/b": True}  # nothing compared again
    touched = tree(spark, [("/d/a", False, 1, 6, "h1"), ("/d/b", False, 1, 5, "zz")])
    pairs2, _ = D.incremental_equal(D.pair(first.expected, touched), stored, plan.version)
    hits2 = {r.dest_path: r.state_hit for r in pairs2.where("source_path is not null and not s_is_dir").collect()}
    assert hits2 == {"/d/a": False, "/d/b": True}
    assert St.load_equivalence_state(spark, folder, "other-rules").count() == 0  # void under new rules
    St.save_equivalence_state(new_state, folder)
    assert St.live_version(spark, folder) == 2
    gone = sync.check(src, tree(spark, [("/d/a", False, 1, 5, "h1")]), plan, state=stored, evict=True)
    assert [r.dest_path for r in gone.state.collect()] == ["/d/a"]
    kept = sync.check(src, tree(spark, [("/d/a", False, 1, 5, "h1")]), plan, state=stored)
    assert sorted(r.dest_path for r in kept.state.collect()) == ["/d/a", "/d/b"]


def test_state_commits(spark):
    """Dead saves block nothing, and of two writers from one version the second is told."""
    folder = tempfile.mkdtemp(prefix="sylva-commit-")
    row = lambda eq, v="r": spark.createDataFrame([("/r/a", "/d/a", ts(0), ts(0), eq, v)], St.STATE_SCHEMA)
    assert St.load_equivalence_state(spark, folder, "r") is None
    row(True).write.parquet(folder + "/data-dead")  # died before its commit
    assert St.load_equivalence_state(spark, folder, "r") is None
    assert St.save_equivalence_state(row(True), folder) == 1
    seen = St.live_version(spark, folder)
    assert St.save_equivalence_state(row(False), folder, based_on=seen) == 2
    with pytest.raises(St.StateConflict):
        St.save_equivalence_state(row(True), folder, based_on=seen)
    assert [r.equal for r in St.load_equivalence_state(spark, folder, "r").collect()] == [False]
    open(folder + "/commits/3", "w").close()  # died between creating the commit and naming its rows
    assert [r.equal for r in St.load_equivalence_state(spark, folder, "r").collect()] == [False]
    assert St.save_equivalence_state(row(True), folder) == 4
    assert [r.equal for r in St.load_equivalence_state(spark, folder, "r").collect()] == [True]
    assert St.vacuum_state(spark, folder) == 0  # too young
    assert St.vacuum_state(spark, folder, min_age_seconds=0) == 4
    assert [r.equal for r in St.load_equivalence_state(spark, folder, "r").collect()] == [True]
    assert St.load_equivalence_state(spark, folder, "other").count() == 0


def test_verdicts_are_looked_up_without_an_exchange(spark, tmp_path):
    """Snapshot and state in buckets by destination path: the state adds no exchange to the diff."""
    plan = compile_rules(PLAIN)
    src = tree(spark, [(f"/r/{i}", False, 1, 0, f"h{i}") for i in range(30)])
    dst = tree(spark, [(f"/d/{i}", False, 1, 5, f"h{i % 20}") for i in range(30)])
    state = sync.check(src, dst, plan, state=spark.createDataFrame([], St.STATE_SCHEMA)).state
    dst_t = St.save_bucketed(dst, "t_snapshot", "path", 4, str(tmp_path / "a"))
    state_t = St.save_bucketed(state, "t_state", "dest_path", 4, str(tmp_path / "b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        exchanges = []
        for st in (None, state_t):
            res = sync.check(src, dst_t, plan, state=st, renames=False)
            text = res.pairs._jdf.queryExecution().executedPlan().toString()
            exchanges.append(text.count("Exchange hashpartitioning"))
        assert exchanges[0] == exchanges[1], exchanges
        assert res.pairs.where("state_hit").count() == 30
        assert sorted(r.dest_path for r in res.public.collect()) == sorted(f"/d/{i}" for i in range(20, 30))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE t_snapshot")
        spark.sql("DROP TABLE t_state")


def test_backup_converges_and_is_idempotent(spark):
    src = tree(spark, [("/r/a", False, 1, 0, "h1"), ("/r/s/b", False, 2, 0, "h2"), ("/r/c", False, 3, 0, "h3")])
    dst = tree(spark, [("/d/a", False, 1, 0, "old"), ("/d/moved", False, 2, 0, "h2"), ("/d/junk/j", False)])
    res = sync.backup(src, dst, PLAIN)
    assert res.remaining.count() == 0
    assert sync.check(src, res.new_dst, PLAIN).public.count() == 0
    plan = [(r.phase, r.change) for r in res.plan.collect()]
    assert plan == sorted(plan)
    dels = [r.dest_path for r in res.plan.collect() if r.change == "delete"]
    assert dels == ["/d/junk/j", "/d/junk"]  # children first


def test_common_parent_matches_commonpath(spark):
    rng = random.Random(11)
    groups = []
    for g in range(30):
        ps = ["/" + "/".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 5))]
        groups += [(f"g{g}", p) for p in ps]
    df = spark.createDataFrame(groups, "root string, path string").withColumn("is_dir", F.lit(True))
    got = {r.root: r.common_path for r in Rep.common_parent(df, "root", "path", "is_dir").collect()}
    want = {}
    for g in {x[0] for x in groups}:
        want[g] = os.path.commonpath([p for r, p in groups if r == g])
    assert got == want


def test_totals_and_top(spark):
    src = tree(spark, [(f"/r/f{i}", False) for i in range(4)])
    dst = tree(spark, [], dirs=["/d"])
    ch = sync.check(src, dst, PLAIN).public
    tot = {r.change: (r.n, r.up_to_date) for r in Rep.change_totals(ch).collect()}
    assert tot["add"] == (4, False) and tot["total"] == (4, False) and tot["delete"] == (0, False)
    top = Rep.top_changes(ch, 2).collect()
    assert [(r.rank, r.dest_path, r.n_more) for r in top] == [(1, "/d/f0", 2), (2, "/d/f1", 2)]
    assert len(Rep.top_changes(ch, -1).collect()) == 4


def test_write_changes_and_binary_scan(spark):
    base = tempfile.mkdtemp(prefix="sylva-files-")
    for rel, data in [("a.txt", b"hello world\n"), ("tmp.txt", b"hello world\n"), ("source/tmp.txt", b"x" * 42),
                      (".hidden", b"h")]:
        os.makedirs(os.path.dirname(os.path.join(base, rel)), exist_ok=True)
        with open(os.path.join(base, rel), "wb") as f:
            f.write(data)
    inv = Inv.scan_inventory(spark, base, format="binaryFile")
    rows = {r.path: r for r in inv.collect()}
    assert rows[base + "/a.txt"].size == 12 and rows[base + "/source"].is_dir
    assert rows[base + "/a.txt"].content_hash == rows[base + "/tmp.txt"].content_hash
    assert base + "/.hidden" not in rows  # the binaryFile source skips dot names
    out = tempfile.mkdtemp(prefix="sylva-changes-") + "/c"
    ch = sync.check(inv, tree(spark, [], dirs=["/d"]), [(1, "in", "/d", None), (2, "add", base + "/**", None)]).public
    St.write_changes(ch, out)
    assert "_SUCCESS" in os.listdir(out) and "change=add" in os.listdir(out)
    assert St.read_changes(spark, out).count() == ch.count()


def test_streaming_selection_equals_batch(spark):
    folder = tempfile.mkdtemp(prefix="sylva-stream-")
    src = tree(spark, [("/r/a.txt", False), ("/r/s/b.md", False), ("/r/.h", False)])
    src.write.parquet(folder + "/in")
    plan = compile_rules([(1, "in", "/d", None), (2, "set", "match-hidden", "false"), (3, "add", "/r/**", None)])
    q = SS.start_selection(SS.read_inventory_stream(spark, folder + "/in"), plan, folder + "/out",
                           folder + "/ckpt")
    q.awaitTermination(120)
    got = sorted(r.write_path for r in spark.read.parquet(folder + "/out").collect())
    assert got == ["/d/a.txt", "/d/s", "/d/s/b.md"]
    ign = compile_rules([(1, "ignore", "*.md", None)])
    kept = SS.ignored_stream(SS.read_inventory_stream(spark, folder + "/in"), ign)
    q2 = kept.writeStream.format("memory").queryName("ignored_rows").trigger(availableNow=True).start()
    q2.awaitTermination(120)
    assert sorted(r.path for r in spark.table("ignored_rows").collect()) == ["/r/s/b.md"]


def test_numbering_matches_window(spark):
    from pyspark.sql import Window

    from sylva.operators.ranking import group_row_number

    rows = [("hot" if i % 3 else (f"g{i % 7}" if i % 2 else None), f"p{i:05d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k string")
    want = {(r.g, r.k): r.rn for r in df.select("g", "k", F.row_number().over(Window.partitionBy("g").orderBy("k")).alias("rn")).collect()}
    assert {(r.g, r.k): r.rn for r in group_row_number(df, ["g"], ["k"], "rn").collect()} == want


def test_clear_materialized(spark):
    from sylva.session import clear_materialized, materialize

    df = materialize(spark.range(10), "t")
    folder = df.inputFiles()[0].rsplit("/", 1)[0].replace("file:", "")
    assert os.path.isdir(folder) and df.count() == 10
    assert clear_materialized(spark) >= 1
    assert not os.path.exists(folder)


def test_d9_state_is_keyed_by_pair(spark):
    src = tree(spark, [("/r/a", False, 1, 0, "h1")])
    dst = tree(spark, [("/d/a", False, 1, 0, "other")])
    plan = compile_rules(PLAIN)
    exp = sync.check(src, dst, plan, renames=False).expected
    state = spark.createDataFrame([("/r/a", "/d/elsewhere", ts(0), ts(0), True, plan.version)], St.STATE_SCHEMA)
    pairs, _ = D.incremental_equal(D.pair(exp, dst), state, plan.version)
    row = pairs.where("dest_path = '/d/a'").collect()[0]
    assert row.state_hit is False and row.equal is False


def test_streaming_selection_resumes_from_checkpoint(spark):
    folder = tempfile.mkdtemp(prefix="sylva-stream2-")
    plan = compile_rules([(1, "in", "/d", None), (2, "add", "/r/**", None)])
    inventory(spark, [("/r/a", False)]).write.parquet(folder + "/in/batch=1")
    SS.start_selection(SS.read_inventory_stream(spark, folder + "/in/*"), plan, folder + "/out",
                       folder + "/ckpt").awaitTermination(120)
    inventory(spark, [("/r/b", False), ("/x/c", False)]).write.parquet(folder + "/in/batch=2")
    SS.start_selection(SS.read_inventory_stream(spark, folder + "/in/*"), plan, folder + "/out",
                       folder + "/ckpt").awaitTermination(120)
    got = sorted(r.write_path for r in spark.read.parquet(folder + "/out").collect())
    assert got == ["/d/a", "/d/b"]  # each file once, /x/c not selected


def test_keyed_diff_of_duplicate_and_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (2, None)], "k int, v string")
    assert D.snapshot_diff(a, a, ["k"]).collect() == []
    b = spark.createDataFrame([(1, "x"), (1, "x"), (3, "n")], "k int, v string")
    got = {(r["change"], r["k"]) for r in D.snapshot_diff(a, b, ["k"]).collect()}
    assert got == {("modify", 1), ("add", None), ("add", 2), ("delete", 3)}


def test_keyed_diff_tells_nulls_apart_in_one_shuffle(spark):
    schema = "k int, a string, b string, x double"
    a = spark.createDataFrame([(1, None, "x", 0.0), (2, "x", None, 1.0), (3, "p", "q", None), (4, "p", "q", None)], schema)
    b = spark.createDataFrame([(1, "x", None, -0.0), (2, "x", None, 1.0), (3, "p", "q", 0.0), (4, "p", "q", None)], schema)
    out = D.snapshot_diff(a, b, ["k"])
    assert sorted((r["change"], r["k"]) for r in out.collect()) == [("modify", 1), ("modify", 3)]
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # initial and current plan


def test_intermediates_go_when_a_block_ends(spark):
    from sylva.session import intermediates, materialize

    kept = materialize(spark.range(3), "kept")
    with intermediates(spark):
        inner = materialize(spark.range(4), "inner")
        folder = inner.inputFiles()[0].rsplit("/", 1)[0].replace("file:", "")
        assert os.path.isdir(folder)
    assert not os.path.exists(folder) and kept.count() == 3
