"""Benchmark of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default
8), BENCH_RUNS (measured runs per query, median reported; default 3) and
BENCH_WARMUP (default 1). Each query is built and fully executed into the
``noop`` sink, so the time covers planning, eager materialisations and the
whole execution, without collecting rows to the driver.

Setup (not timed): the inventories derived from ``documents`` and ``events``
(FIXTURES section 2) are written once as Parquet manifests, which is the form
in which a lake inventory arrives; every timed query then starts from those
manifests. ``keyed_diff_orders`` reads ``orders`` directly.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sylva.operators import diff as D  # noqa: E402
from sylva.operators import renames as R  # noqa: E402
from sylva.operators import report as Rep  # noqa: E402
from sylva.operators import select as S  # noqa: E402
from sylva.plans import catalog as C  # noqa: E402
from sylva.plans import sync  # noqa: E402
from sylva.plans.rules import compile_rules  # noqa: E402
from sylva.session import clear_materialized, ensure_checkpoint_dir, get_spark, materialize  # noqa: E402
from sylva.sources import testdata as T  # noqa: E402
from sylva.sources.inventory import scan_inventory  # noqa: E402
from sylva.sources.state import load_equivalence_state, save_equivalence_state  # noqa: E402

# fixed values: extensions used by the generated selection rules
EXTS = ["txt", "md", "json", "tmp", "log"]


def selection_rules(n: int) -> list[tuple]:
    """``n`` add rules over the document tree (plus an ignore), built from a rule."""
    rows = [(1, "in", "/backup", None), (2, "ignore", "*.tmp", None)]
    for k in range(n):
        src = f"src{k % 20}"
        ext = EXTS[(k // 20) % len(EXTS)]
        pattern = f"/lake/{src}/**/*.{ext}" if k // 100 == 0 else f"/lake/{src}/*/doc{k % 10}*"
        rows.append((3 + k, "add", pattern, None))
    return rows


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    warm = int(os.environ.get("BENCH_WARMUP", "1"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus * 2)
    spark.sparkContext.setLogLevel("ERROR")
    root = ensure_checkpoint_dir(spark).rstrip("/")

    def manifest(inventory, name):
        """Written once, as a lake inventory arrives, and scanned by every query."""
        inventory.write.parquet(f"{root}/{name}")
        return scan_inventory(spark, f"{root}/{name}", normal=True, add_directories=False)

    src, dst = manifest(T.documents_src(spark, sf_dir), "bench-src"), manifest(T.documents_dst(spark, sf_dir), "bench-dst")
    ev_src, ev_dst = manifest(T.events_src(spark, sf_dir), "bench-ev-src"), manifest(T.events_dst(spark, sf_dir), "bench-ev-dst")
    plain = [(1, "in", "/backup", None), (2, "add", "/lake/**", None)]
    plain_plan = compile_rules(plain)

    # a stored state from a first run (exact mode), for the incremental check
    first = sync.check(src, dst, plain_plan, state=spark.createDataFrame([], "source_path string, dest_path string, "
                       "source_mtime timestamp, dest_mtime timestamp, equal boolean, rules_version string"))
    state_dir = f"{root}/bench-state"
    save_equivalence_state(first.state, state_dir)
    stored = load_equivalence_state(spark, state_dir, plain_plan.version)
    stored = materialize(stored, "bench-state")

    def q_check():
        return sync.check(src, dst, C.FIXTURE_RULES).public

    def q_check_state():
        return sync.check(src, dst, plain_plan, state=stored).public

    def q_select(n):
        plan = compile_rules(selection_rules(n))
        return lambda: S.expected(S.track(src, plan))

    def q_renames():
        res = sync.check(src, dst, plain_plan, renames=False)
        return R.rename_pairs(res.changes)

    def q_orders():
        exp, act = T.orders_snapshots(spark, sf_dir)
        return Rep.change_totals(D.snapshot_diff(exp, act, ["o_orderkey"]))

    def q_fast():
        return sync.check(ev_src, ev_dst, [(1, "in", "/", None), (2, "add", "/**", None)], mode="fast").public

    def q_tree():
        return sync.tree(src, C.TREE_RULES, verbose=True, prune=True).listing

    def q_backup():
        return sync.backup(src, dst, C.FIXTURE_RULES).remaining

    cases = {
        "check": q_check,
        "check_with_state": q_check_state,
        "select_1_rule": q_select(1),
        "select_10_rules": q_select(10),
        "select_100_rules": q_select(100),
        "rename_pairing": q_renames,
        "keyed_diff_orders": q_orders,
        "check_fast_events": q_fast,
        "tree_listing": q_tree,
        "backup_converge": q_backup,
    }
    only = set(sys.argv[1:])
    times = {}
    for name, build in cases.items():
        if only and name not in only:
            continue
        samples = []
        for i in range(warm + runs):
            t0 = time.perf_counter()
            run(build())
            dt = time.perf_counter() - t0
            if i >= warm:
                samples.append(dt)
        times[name] = round(statistics.median(samples), 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    clear_materialized(spark)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "sum_of_median_query_sec", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
                      "runs": runs}))


if __name__ == "__main__":
    main()
