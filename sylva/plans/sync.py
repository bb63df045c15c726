"""Whole commands: ``check``, ``tree`` and ``backup``. Each writes what several steps read.

``check``: select (claim CASE) -> expected (one row per destination path) ->
full outer join with the in-scope destination -> equality (exact, fast or
incremental with stored verdicts) -> orphans with ignore protection -> rename
pairing -> change rows. Shuffles: the join on the destination path (the
expected aggregate shares its partitioning), the anti joins of the orphan
step and the pairing of renames.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions import paths as P
from sylva.functions.paths import normalize_text
from sylva.operators import diff as D
from sylva.operators import renames as R
from sylva.operators import report as Rep
from sylva.operators import select as S
from sylva.operators.paths import INVENTORY_COLUMNS
from sylva.operators.tree import nested_sets
from sylva.operators.transition import apply_changes, operation_plan
from sylva.plans.rules import RulePlan, compile_rules
from sylva.session import materialize


@dataclass
class CheckResult:
    changes: DataFrame          # wide change rows (diff.WIDE_COLUMNS)
    pairs: DataFrame            # judged expected/actual pairs
    tracked: DataFrame          # all tracked rows (per rule, with parents)
    expected: DataFrame         # one row per destination path
    state: DataFrame | None     # refreshed equivalence state (exact mode)
    plan: RulePlan

    @property
    def public(self) -> DataFrame:
        return D.public(self.changes)


def _plan(rules, base: str) -> RulePlan:
    return rules if isinstance(rules, RulePlan) else compile_rules(rules, base)


def check(src: DataFrame, dst: DataFrame, rules, *, base: str = "/", mode: str = "exact",
          state: DataFrame | None = None, renames: bool = True,
          tolerance_us: int = D.FAST_TOLERANCE_US, cut: bool = True, evict: bool = False) -> CheckResult:
    """The ``check`` command over two inventories and a rule table. ``evict`` drops stored verdicts
    about pairs that this check doesn't see."""
    plan = _plan(rules, base)
    tracked = S.track(src, plan)
    exp = S.expected(tracked)
    actual = D.in_scope(dst, plan.write_prefixes)
    with_state = mode == "exact" and state is not None
    if with_state:
        actual = D.with_verdicts(actual.select(*INVENTORY_COLUMNS), state, plan.version)
    pairs = D.pair(exp, actual)
    new_state = None
    if mode == "fast":
        pairs = pairs.withColumn("equal", D.fast_equal(tolerance_us))
    elif mode == "exact":
        pairs = D.judged_by_verdicts(pairs) if with_state else pairs.withColumn("equal", D.content_equal())
    else:
        raise ValueError(f"unknown mode {mode!r}")
    diff = D.diff_rows(pairs, keep_same_files=with_state)
    if cut:
        # the only consumer of the full outer join; written once so the orphan
        # step, rename pairing, reports and the apply step read a small table
        # (and a lost executor re-reads files instead of redoing the join)
        diff = materialize(diff, "diff")
    if with_state:
        # the refreshed state comes from the same pass, not a second join
        new_state = D.state_from_diff(diff, state, plan.version, evict)
        diff = diff.where(F.col("change") != "same")
    deletions = D.orphans(D.leftovers(diff), plan.final_ignore_regex)
    roots = plan.destination_roots
    if roots:
        # a nested write prefix lies inside another prefix's scope; it is a
        # destination root, not a leftover
        deletions = deletions.where(~F.col("path").isin(roots))
    if renames and cut and plan.final_ignore_regex is not None:
        # the pairing reads deletions several times; without ignores they are a scan of the diff
        deletions = materialize(deletions, "deletions")
    changes = D.changes_from_diff(diff, deletions)
    if renames:
        changes = R.detect_renames_fast(changes, tolerance_us) if mode == "fast" else R.detect_renames(changes)
    return CheckResult(changes, pairs, tracked, exp, new_state, plan)


def sync_report(src: DataFrame, dst: DataFrame, rules, **kw) -> DataFrame:
    """Flagship: the change set of ``check`` (``change, source_path, dest_path,
    size, kind_changed``)."""
    return check(src, dst, rules, **kw).public


@dataclass
class TreeResult:
    search_paths: DataFrame
    counts: DataFrame
    pruned: DataFrame
    listing: DataFrame


def tree(src: DataFrame, rules, *, base: str = "/", search_path: str | None = None,
         verbose: bool = False, prune: bool = False, cut: bool = True) -> TreeResult:
    """The ``tree`` command: where the tracked paths are rooted and the real
    tree below that point, with tracked / untracked marks.

    ``search_path`` is the common parent of the tracked read paths; it is one
    row (one root on POSIX) and is read on the driver to anchor the listing.
    A given one must be a directory of the inventory.
    """
    plan = _plan(rules, base)
    rows = S.flagged(src, plan)
    if cut:
        # read by the anchor, the counts and the nested sets
        rows = materialize(rows, "flagged")
    kinds = rows.where("tracked").select(F.lit("/").alias("root"), "path", "is_dir")
    roots = Rep.common_parent(kinds, "root", "path", "is_dir")
    if search_path is None:
        row = roots.first()
        search_path = row["common_path"] if row else "/"
    else:
        search_path = normalize_text(search_path, base)
        found = rows.where((F.col("path") == search_path) | P.is_below("path", search_path)).agg(
            F.count(F.lit(1)).alias("n"), F.max((F.col("path") == search_path) & ~F.col("is_dir")).alias("file")).first()
        if found["file"]:
            raise NotADirectoryError(search_path)
        if not found["n"] and search_path != "/":
            raise FileNotFoundError(search_path)
    sets = nested_sets(rows, search_path)
    if cut:
        sets = materialize(sets, "sets")
    return TreeResult(roots, Rep.tree_counts(rows, search_path), Rep.pruned_subtrees(sets),
                      Rep.tree_listing(sets, verbose=verbose, prune=prune))


@dataclass
class BackupResult:
    check: CheckResult
    plan: DataFrame
    new_dst: DataFrame
    remaining: DataFrame


def backup(src: DataFrame, dst: DataFrame, rules, *, base: str = "/", mode: str = "exact",
           checkpoint: bool = True) -> BackupResult:
    """The ``backup`` command as tables: the ordered plan, the destination
    snapshot after it, and what a second check still finds (empty when the
    rules converge). The new snapshot is written once before it is diffed
    again, so the second check does not recompute the first."""
    res = check(src, dst, rules, base=base, mode=mode)
    if checkpoint:
        # read by the plan and three times by the new snapshot: the pairing runs once
        res = replace(res, changes=materialize(res.changes, "renamed"))
    new_dst = apply_changes(dst, res.changes)
    if checkpoint:
        new_dst = materialize(new_dst, "snapshot")
    again = check(src, new_dst, res.plan, mode=mode)
    return BackupResult(res, operation_plan(res.public), new_dst, again.public)


def verify_converged(src: DataFrame, new_dst: DataFrame, rules, *, base: str = "/",
                     mode: str = "exact") -> DataFrame:
    """Totals of a second check against the new destination (all zero and
    ``up_to_date`` when converged)."""
    return Rep.change_totals(check(src, new_dst, rules, base=base, mode=mode).public)
