"""Registered queries over the driver's tables, and their DuckDB oracles.

Every query reads the given parquet tables (through the derivations in
``sylva.sources.testdata``) and runs the library's operators on the whole
tables. Oracles are written independently in DuckDB SQL with ``LIKE``,
``split_part`` and friends (DuckDB's RE2 has no look-ahead, and pasting our
generated regexes would check nothing).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.operators import content as Co
from sylva.operators import diff as D
from sylva.operators import filters as Fl
from sylva.operators import paths as Pa
from sylva.operators import report as Rep
from sylva.operators import select as S
from sylva.operators import transition as Tr
from sylva.plans import sync
from sylva.plans.rules import compile_rules
from sylva.sources import testdata as T

# fixed values: the rule table of FIXTURES.md section 2
FIXTURE_RULES = [
    (1, "root", "SRC", "/lake"),
    (2, "root", "DST", "/backup"),
    (3, "ignore", "*.tmp", None),
    (4, "in", "DST", None),
    (5, "add", "SRC/**/*.md", None),
    (6, "include", "*.tmp", None),
    (7, "ignore", "SRC/src1/**", None),
    (8, "add", "SRC/**", None),
]
# a selection that leaves most of the tree untracked (tree views)
TREE_RULES = [(1, "in", "/backup", None), (2, "add", "/lake/src1*/en/**", None)]
# a destination-side ignore that protects leftovers and their parents
ORPHAN_RULES = [(1, "in", "/backup", None), (2, "add", "/lake/src2", None), (3, "ignore", "*.json", None)]
# aliases with a shadowed second definition
ALIASES = [("SRC", "/lake", 1), ("SRC", "/elsewhere", 2), ("DST", "/backup", 3)]

TOP_LIMIT, WIDE_LIMIT = 5, 1500
PLAIN_RULES = [(1, "in", "/backup", None), (2, "add", "/lake/**", None)]


# --------------------------------------------------------------------------
# Spark side


def _src(spark, sf):
    return T.documents_src(spark, sf)


def _dst(spark, sf):
    return T.documents_dst(spark, sf)


def _check(spark, sf, rules=FIXTURE_RULES, **kw):
    return sync.check(_src(spark, sf), _dst(spark, sf), rules, **kw)


def q_inventory_src(spark, sf):
    return _src(spark, sf)


def q_inventory_dst(spark, sf):
    return _dst(spark, sf)


def q_normalize_paths(spark, sf):
    d = T.table(spark, sf, "documents")
    raw = d.select("doc_id", F.concat(F.lit("lake/./"), F.col("source"), F.lit("/x/../"), F.col("lang"),
                                      F.lit("//doc"), F.col("doc_id").cast("string"), F.lit("/")).alias("path"))
    out = Pa.normalize_paths(raw, "path", base="/data")
    return out.select("doc_id", "path", "parent", "name", F.col("depth").cast("bigint").alias("depth"))


def q_resolve_roots(spark, sf):
    d = T.table(spark, sf, "documents")
    raw = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0,
                                    F.concat(F.lit("SRC/"), F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string")))
                               .when(F.col("doc_id") % 3 == 0, F.lit("DST"))
                               .otherwise(F.concat(F.lit("/abs/"), F.col("source"))).alias("path"))
    return Pa.resolve_roots(raw, spark.createDataFrame(ALIASES, "alias string, replacement string, seq int"))


def q_expand_parents(spark, sf):
    return Pa.expand_parents(T.document_files(spark, sf).select(*Pa.INVENTORY_COLUMNS)).select("path", "is_dir")


def q_rebase(spark, sf):
    f = T.document_files(spark, sf).select("path")
    return Pa.rebase(f, "/lake", "/backup", out_col="rebased")


def q_glob_filter(spark, sf):
    return Fl.glob_filter(_src(spark, sf), "path", "/lake/src1?/*/*.json", match_hidden=False).select("path")


def q_globstar_filter(spark, sf):
    return Fl.globstar_filter(_src(spark, sf), "path", "/lake/**/doc*[05].txt").select("path")


def q_subtree_filter(spark, sf):
    return Fl.subtree_filter(_src(spark, sf), "path", "/lake/src3").select("path", "is_dir")


def q_ignore_filter(spark, sf):
    plan = compile_rules(FIXTURE_RULES)
    return Fl.ignore_filter(_src(spark, sf), "path", plan, as_of_seq=5).select("path", "is_dir")


def q_ignore_filter_end(spark, sf):
    plan = compile_rules(FIXTURE_RULES)
    return Fl.ignore_filter(_src(spark, sf), "path", plan).select("path", "is_dir")


def q_track(spark, sf):
    plan = compile_rules(FIXTURE_RULES)
    return S.expected(S.track(_src(spark, sf), plan)).select(
        "rule_seq", "read_path", "write_path", "rel_path", "is_parent", "is_dir")


def many_rules(n: int = 1000) -> list[tuple]:
    """Two adds for each of ``n`` source folders, most of which don't exist."""
    adds = [(f"/lake/src{k}/**/*.md", f"/lake/src{k}/en/**") for k in range(n)]
    return [(1, "in", "/backup", None), (2, "ignore", "/lake/src3/**/*.log", None),
            *((3 + i, "add", a, None) for i, a in enumerate(a for pair in adds for a in pair))]


def q_track_many_rules(spark, sf):
    """Thousands of adds, found by the prefixes of a path."""
    return S.track(_src(spark, sf), compile_rules(many_rules()), parents=False).select("rule_seq", "read_path", "write_path")


def q_duplicate_claims(spark, sf):
    return S.duplicate_claims(_src(spark, sf), compile_rules(FIXTURE_RULES))


def q_case_collisions(spark, sf):
    f = T.document_files(spark, sf)
    variants = f.where(F.col("doc_id") % 7 == 0).select(F.replace("path", F.lit("/doc"), F.lit("/Doc")).alias("path"))
    return S.case_collisions(f.select("path").unionByName(variants), "path")


def q_snapshot_diff_orders(spark, sf):
    exp, act = T.orders_snapshots(spark, sf)
    return D.snapshot_diff(exp, act, ["o_orderkey"])


def _plain_pairs(spark, sf):
    plan = compile_rules([(1, "in", "/backup", None), (2, "add", "/lake/**", None)])
    exp = S.expected(S.track(_src(spark, sf), plan))
    return D.pair(exp, D.in_scope(_dst(spark, sf), plan.write_prefixes))


def q_snapshot_diff(spark, sf):
    return _check(spark, sf, [(1, "in", "/backup", None), (2, "add", "/lake/**", None)], renames=False).public


def q_content_equal(spark, sf):
    p = _plain_pairs(spark, sf)
    return p.where(F.col("source_path").isNotNull() & F.col("d_is_dir").isNotNull()).select(
        "dest_path", D.content_equal().alias("equal"))


def q_content_equal_chunks(spark, sf):
    """Contents without stored hashes, as tables of chunks: sizes first, then the bytes of pairs of equal size."""
    src, dst = T.document_contents(spark, sf, "src"), T.document_contents(spark, sf, "dst")
    pairs = D.pair(src.select(F.col("path").alias("read_path"), F.replace("path", F.lit("/lake/"), F.lit("/backup/")).alias("write_path"), *Pa.INVENTORY_COLUMNS[1:]),
                   dst.select(*Pa.INVENTORY_COLUMNS))
    out = Co.equal_by_content(pairs, lambda files: Co.table_chunks(T.chunks_of(src), files), lambda files: Co.table_chunks(T.chunks_of(dst), files))
    return out.select("dest_path", "equal", "n_read")


def q_scan_inventory(spark, sf):
    """A written manifest with paths in all forms, several rows of a path and a clash of file and directory."""
    from sylva.sources.inventory import scan_inventory

    folder = _scratch(spark, "manifest")
    T.dirty_manifest(spark, sf).write.parquet(folder)
    return scan_inventory(spark, folder, base="/lake")


def q_fast_equal(spark, sf):
    p = _plain_pairs(spark, sf)
    return p.where(F.col("source_path").isNotNull() & F.col("d_is_dir").isNotNull()).select(
        "dest_path", D.fast_equal().alias("equal"))


def stored_state(spark, sf, rules_version: str) -> DataFrame:
    """A previous run's state derived from ``documents``: verdicts for files
    with doc_id % 3 != 0; for doc_id % 3 == 1 the stored destination mtime is
    one second off (so the verdict is stale); stored verdict = doc_id even."""
    f = T.document_files(spark, sf)
    doc = F.col("doc_id")
    return f.where(doc % 3 != 0).select(
        F.col("path").alias("source_path"),
        F.concat(F.lit("/backup/"), F.expr("substr(path, 7)")).alias("dest_path"),
        F.col("mtime").alias("source_mtime"),
        F.timestamp_micros(F.unix_micros("mtime") + (doc % 4) * 1_000_000
                           + F.when(doc % 3 == 1, 1_000_000).otherwise(0)).alias("dest_mtime"),
        (doc % 2 == 0).alias("equal"),
        F.lit(rules_version).alias("rules_version"),
    )


def q_incremental_equal(spark, sf):
    plan = compile_rules([(1, "in", "/backup", None), (2, "add", "/lake/**", None)])
    pairs = _plain_pairs(spark, sf)
    out, _ = D.incremental_equal(pairs, stored_state(spark, sf, plan.version), plan.version)
    return out.where(F.col("source_path").isNotNull() & F.col("d_is_dir").isNotNull()
                     & ~F.col("s_is_dir") & ~F.col("d_is_dir")).select("dest_path", "equal", "state_hit")


def q_orphans(spark, sf):
    res = _check(spark, sf, ORPHAN_RULES, renames=False)
    return res.public.where("change = 'delete'").select(F.col("dest_path").alias("path"))


def q_detect_renames(spark, sf):
    res = _check(spark, sf, [(1, "in", "/backup", None), (2, "add", "/lake/**", None)])
    return res.public.where("change = 'rename'").select("source_path", "dest_path", "size")


def q_detect_renames_fast(spark, sf):
    src, dst = T.events_src(spark, sf), T.events_dst(spark, sf)
    res = sync.check(src, dst, [(1, "in", "/", None), (2, "add", "/**", None)], mode="fast")
    return res.public.where("change = 'rename'").select("source_path", "dest_path", "size")


def q_detect_renames_crowded(spark, sf):
    """Fast renames where mtimes crowd: one long chain and one dense burst, each of files of one size."""
    src, dst = (T.with_directories(T.crowded_files(spark, sf, side)) for side in ("src", "dst"))
    res = sync.check(src, dst, PLAIN_RULES, mode="fast")
    return res.public.where("change = 'rename'").select("source_path", "dest_path", "size")


def q_change_totals(spark, sf):
    return Rep.change_totals(_check(spark, sf).public)


def q_tree_counts(spark, sf):
    return sync.tree(_src(spark, sf), TREE_RULES).counts


def q_common_parent(spark, sf):
    pg = T.pages_paths(spark, sf)
    norm = Pa.normalize_paths(pg.withColumn("path", F.coalesce("path", F.lit(""))), "path", with_parts=False)
    return Rep.common_parent(norm.withColumn("is_dir", F.lit(False)), "root", "path", "is_dir")


def q_pruned_subtrees(spark, sf):
    return sync.tree(_src(spark, sf), TREE_RULES).pruned


def q_top_changes(spark, sf):
    return Rep.top_changes(_check(spark, sf).public, TOP_LIMIT)


def q_top_changes_wide(spark, sf):
    """A limit above half of the rows: cut by rank."""
    return Rep.top_changes(_check(spark, sf).public, WIDE_LIMIT)


def q_tree_listing(spark, sf):
    return sync.tree(_src(spark, sf), TREE_RULES, verbose=True, prune=True).listing


def q_operation_plan(spark, sf):
    return Tr.operation_plan(_check(spark, sf).public)


def q_apply_changes(spark, sf):
    res = _check(spark, sf)
    return Tr.apply_changes(_dst(spark, sf), res.changes)


def q_verify_converged(spark, sf):
    res = sync.backup(_src(spark, sf), _dst(spark, sf), FIXTURE_RULES)
    return Rep.change_totals(res.remaining)


def q_verify_interrupted(spark, sf):
    """A run that stopped after its additions and renames: what a second check still finds."""
    res = _check(spark, sf)
    part = Tr.apply_changes(_dst(spark, sf), res.changes.where(F.col("change").isin("add", "rename")))
    return sync.verify_converged(_src(spark, sf), part, res.plan)


def q_sync_report(spark, sf):
    return _check(spark, sf).public


def _scratch(spark, label: str) -> str:
    import uuid

    from sylva.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sylva/{label}-{uuid.uuid4().hex}"


def q_state_roundtrip(spark, sf):
    """State of a first exact run, saved as a version and loaded back."""
    from sylva.sources import state as St

    plan = compile_rules(PLAIN_RULES)
    res = sync.check(_src(spark, sf), _dst(spark, sf), plan, renames=False,
                     state=spark.createDataFrame([], St.STATE_SCHEMA))
    folder = _scratch(spark, "state")
    St.save_equivalence_state(res.state, folder)
    return St.load_equivalence_state(spark, folder, plan.version)


def q_write_changes(spark, sf):
    """The change set written by type (``change=<type>`` folders) and read back."""
    from sylva.sources import state as St

    folder = _scratch(spark, "changes")
    St.write_changes(_check(spark, sf).public, folder)
    return St.read_changes(spark, folder)


def q_sync_report_fast(spark, sf):
    return _check(spark, sf, mode="fast").public


def q_keyed_totals_orders(spark, sf):
    exp, act = T.orders_snapshots(spark, sf)
    return Rep.change_totals(D.snapshot_diff(exp, act, ["o_orderkey"]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "inventory_src": q_inventory_src,
    "inventory_dst": q_inventory_dst,
    "normalize_paths": q_normalize_paths,
    "resolve_roots": q_resolve_roots,
    "expand_parents": q_expand_parents,
    "rebase": q_rebase,
    "glob_filter": q_glob_filter,
    "globstar_filter": q_globstar_filter,
    "subtree_filter": q_subtree_filter,
    "ignore_filter": q_ignore_filter,
    "ignore_filter_end": q_ignore_filter_end,
    "track": q_track,
    "track_many_rules": q_track_many_rules,
    "snapshot_diff": q_snapshot_diff,
    "snapshot_diff_orders": q_snapshot_diff_orders,
    "keyed_totals_orders": q_keyed_totals_orders,
    "content_equal": q_content_equal,
    "content_equal_chunks": q_content_equal_chunks,
    "scan_inventory": q_scan_inventory,
    "fast_equal": q_fast_equal,
    "incremental_equal": q_incremental_equal,
    "orphans": q_orphans,
    "detect_renames": q_detect_renames,
    "detect_renames_fast": q_detect_renames_fast,
    "detect_renames_crowded": q_detect_renames_crowded,
    "change_totals": q_change_totals,
    "tree_counts": q_tree_counts,
    "common_parent": q_common_parent,
    "pruned_subtrees": q_pruned_subtrees,
    "duplicate_claims": q_duplicate_claims,
    "case_collisions": q_case_collisions,
    "top_changes": q_top_changes,
    "top_changes_wide": q_top_changes_wide,
    "tree_listing": q_tree_listing,
    "operation_plan": q_operation_plan,
    "apply_changes": q_apply_changes,
    "verify_converged": q_verify_converged,
    "verify_interrupted": q_verify_interrupted,
    "sync_report": q_sync_report,
    "state_roundtrip": q_state_roundtrip,
    "write_changes": q_write_changes,
    "sync_report_fast": q_sync_report_fast,
}
