"""Selection: which inventory rows the rules track, and where they go.

The reference walks the tree once per ``add`` and lets the first ``add`` that
reaches a path claim it. Here all ``add``s are one ordered ``CASE WHEN`` over
literal regexes, evaluated in a single projection of the inventory: the first
branch that matches (and is not ignored as of that ``add``) is the claiming
rule. No join, no window and no shuffle is needed to select; the OR of the
literal read prefixes is pushed into the Parquet scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.functions import paths as P
from sylva.operators.paths import INVENTORY_COLUMNS
from sylva.plans.rules import RulePlan

TRACKED_COLUMNS = ["rule_seq", "read_path", "write_path", "rel_path", "is_parent",
                   "is_dir", "size", "mtime", "content_hash"]


def _prefix_cond(c: Column, literal_prefix: str) -> Column | None:
    return None if literal_prefix == "/" else c.startswith(literal_prefix)


def _rule_cond(c: Column, add) -> Column:
    cond = c.rlike(add.regex)
    pre = _prefix_cond(c, add.literal_prefix)
    if pre is not None:
        cond = pre & cond
    if add.ignore_regex is not None:
        cond = cond & ~c.rlike(add.ignore_regex)
    return cond


def reach_column(plan: RulePlan, col: str = "path") -> Column:
    """Seqs of every ``add`` that reaches the path (before first-claim)."""
    c = F.col(col)
    arr = F.array(*[F.when(_rule_cond(c, a), F.lit(a.seq)) for a in plan.adds]) if plan.adds \
        else F.array().cast("array<int>")
    return F.filter(arr, lambda x: x.isNotNull())


def scan_pruning(plan: RulePlan, col: str = "path") -> Column | None:
    """OR of the literal read prefixes (pushed to the scan); None if some add
    starts at the root."""
    conds = [_prefix_cond(F.col(col), a.literal_prefix) for a in plan.adds]
    if not conds or any(x is None for x in conds):
        return None
    return reduce(lambda a, b: a | b, conds)


def _by_seq(plan: RulePlan, attr: str) -> Column:
    expr = None
    for a in plan.adds:
        v = F.lit(getattr(a, attr))
        expr = F.when(F.col("rule_seq") == a.seq, v) if expr is None else expr.when(F.col("rule_seq") == a.seq, v)
    return expr if expr is not None else F.lit(None).cast("string")


def claim_struct(plan: RulePlan, col: str = "path") -> Column:
    """``struct(rule_seq, read_prefix, write_prefix)`` of the claiming ``add``."""
    c = F.col(col)
    expr = None
    for a in plan.adds:
        cond = _rule_cond(c, a)
        v = F.struct(F.lit(a.seq).alias("rule_seq"), F.lit(a.read_prefix).alias("read_prefix"),
                     F.lit(a.write_prefix).alias("write_prefix"))
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    return expr


# Up to this many adds are one CASE; more are looked up by prefix.
CASE_RULES = 32


def adds_frame(spark: SparkSession, plan: RulePlan) -> DataFrame:
    """The compiled adds as a table keyed by their read prefix."""
    rows = [(a.seq, a.read_prefix, a.write_prefix, a.regex, a.ignore_regex) for a in plan.adds]
    return spark.createDataFrame(rows, "rule_seq int, read_prefix string, write_prefix string, regex string, ignore_regex string")


def claimed_by_prefix(inventory: DataFrame, plan: RulePlan) -> DataFrame:
    """:func:`claimed` for rule tables with very many adds.

    An add can only claim paths below its read prefix, so a path's ancestors
    are the keys of all adds that may claim it: an equi join finds those, their
    regexes decide, and the first ``seq`` wins in one aggregate by path.
    Work grows with a path's depth and the adds on its way, not with the table.
    """
    inv = inventory.select(*INVENTORY_COLUMNS)
    keys = F.concat(F.array(F.lit("/")), P.ancestors("path"))
    near = inv.select(*INVENTORY_COLUMNS, F.explode(keys).alias("read_prefix")).join(adds_frame(inventory.sparkSession, plan), "read_prefix")
    hit = near.where(F.expr("path rlike regex AND NOT coalesce(path rlike ignore_regex, false)"))
    best = hit.groupBy("path").agg(F.min_by(F.struct(*INVENTORY_COLUMNS[1:], "rule_seq", "read_prefix", "write_prefix"), "rule_seq").alias("b"))
    return best.select("path", "b.*")


def claimed(inventory: DataFrame, plan: RulePlan) -> DataFrame:
    """Inventory rows with the claiming ``rule_seq`` and read/write prefixes.

    Rule tables with more than ``CASE_RULES`` adds go through :func:`claimed_by_prefix`.

    The claim is produced by a generator (explode of a one-element array), not
    a projection plus filter: Catalyst would push such a filter below the
    projection and evaluate every rule's regexes twice per row.
    """
    if len(plan.adds) > CASE_RULES:
        return claimed_by_prefix(inventory, plan)
    inv = inventory.select(*INVENTORY_COLUMNS)
    prune = scan_pruning(plan)
    if prune is not None:
        inv = inv.where(prune)
    if not plan.adds:
        return inv.limit(0).withColumn("rule_seq", F.lit(None).cast("int")) \
            .withColumn("read_prefix", F.lit(None).cast("string")) \
            .withColumn("write_prefix", F.lit(None).cast("string"))
    # explode(array(...)) keeps the CASE in generated code (a higher-order
    # function such as filter() would interpret it row by row); the null
    # check sits on the generator output, which no filter can be pushed past
    return (inv.select(*INVENTORY_COLUMNS, F.explode(F.array(claim_struct(plan))).alias("_c"))
               .where(F.col("_c").isNotNull())
               .select(*INVENTORY_COLUMNS, "_c.rule_seq", "_c.read_prefix", "_c.write_prefix"))


def flagged(inventory: DataFrame, plan: RulePlan) -> DataFrame:
    """Every inventory row with ``tracked`` and, if so, the ``write_path`` of the earliest rule that claims it or
    brings it as a parent: ``path, is_dir, rule_seq, tracked, write_path``.

    Claims come from the same pass over the inventory as its rows; only directories are joined, with the parents that
    rules bring."""
    inv = inventory.select(*INVENTORY_COLUMNS)
    if len(plan.adds) > CASE_RULES:
        c = claimed_by_prefix(inv, plan).select("path", F.struct("rule_seq", "read_prefix", "write_prefix").alias("_c"))
        own = inv.join(c, "path", "left")
    elif plan.adds:
        own = inv.select("path", "is_dir", F.explode(F.array(claim_struct(plan))).alias("_c"))
    else:
        own = inv.withColumn("_c", F.lit(None).cast("struct<rule_seq:int,read_prefix:string,write_prefix:string>"))
    to = P.join_path(F.col("_c.write_prefix"), P.relative_to("path", F.col("_c.read_prefix")))
    own = own.select("path", "is_dir", F.col("_c.rule_seq").alias("rule_seq"), F.when(F.col("_c").isNotNull(), to).alias("write_path"))
    if not plan.adds:
        return own.select("path", "is_dir", "rule_seq", F.lit(False).alias("tracked"), "write_path")
    parents = track(inventory, plan).where("is_parent").groupBy(F.col("read_path").alias("path")).agg(
        F.min("rule_seq").alias("_seq"), F.min_by("write_path", "rule_seq").alias("_to"))
    by_parent = F.col("_seq").isNotNull() & (F.col("rule_seq").isNull() | (F.col("_seq") < F.col("rule_seq")))
    dirs = own.where("is_dir").join(parents, "path", "left").select(
        "path", "is_dir", F.when(by_parent, F.col("_seq")).otherwise(F.col("rule_seq")).alias("rule_seq"),
        F.when(by_parent, F.col("_to")).otherwise(F.col("write_path")).alias("write_path"))
    both = own.where("NOT is_dir").select("path", "is_dir", "rule_seq", "write_path").unionByName(dirs)
    return both.select("path", "is_dir", "rule_seq", F.col("rule_seq").isNotNull().alias("tracked"), "write_path")


def _finish(df: DataFrame, is_parent: bool) -> DataFrame:
    rel = P.relative_to("read_path", "read_prefix")
    return df.select("rule_seq", "read_path", P.join_path("write_prefix", rel).alias("write_path"),
                     rel.alias("rel_path"), F.lit(is_parent).alias("is_parent"),
                     "is_dir", "size", "mtime", "content_hash")


def track(inventory: DataFrame, plan: RulePlan, parents: bool = True) -> DataFrame:
    """Tracked rows: ``rule_seq, read_path, write_path, rel_path, is_parent`` plus
    the inventory attributes.

    Each path is claimed by at most one ``add`` (the first). With ``parents``,
    every directory between a claimed path and its rule's read prefix is added
    for that rule (``is_parent``; the prefix itself is left out). Distinct
    parents are taken before the ancestors are exploded, so the explode works
    on directories, not files.
    """
    m = claimed(inventory, plan).withColumnRenamed("path", "read_path")
    out = _finish(m, False)
    if not parents:
        return out
    par = (m.select("rule_seq", "read_prefix", "write_prefix", P.parent("read_path").alias("_p"))
            .where(F.col("_p") != F.col("read_prefix"))
            .distinct())
    anc = (par.select("rule_seq", "read_prefix", "write_prefix",
                      F.explode(F.array_union(P.ancestors("_p", "read_prefix"), F.array("_p"))).alias("read_path"))
              .distinct()
              .select("*", F.lit(True).alias("is_dir"), F.lit(0).cast("bigint").alias("size"),
                      F.lit(None).cast("timestamp").alias("mtime"), F.lit(None).cast("string").alias("content_hash")))
    return out.unionByName(_finish(anc, True))


def expected(tracked: DataFrame) -> DataFrame:
    """One row per destination path: the earliest rule wins, a matched entry
    beats a parent of the same rule.

    A window over ``write_path`` (not an aggregate): its exchange and sort on
    ``write_path`` are exactly what the following sort-merge join on the
    destination path needs, so the dedupe adds no shuffle and no extra sort.
    """
    w = Window.partitionBy("write_path").orderBy("rule_seq", "is_parent")
    return (tracked.select("*", F.row_number().over(w).alias("_rn"))
                   .where(F.col("_rn") == 1).select(*tracked.columns))


def duplicate_claims(inventory: DataFrame, plan: RulePlan) -> DataFrame:
    """Read paths reached by more than one rule (as a match or as a parent).

    ``read_path, n_rules, first_seq, write_path`` where ``write_path`` is the
    mapping that is kept (the earliest rule's).
    """
    inv = inventory.select("path")
    prune = scan_pruning(plan)
    if prune is not None:
        inv = inv.where(prune)
    reach = (inv.select(F.col("path").alias("read_path"), F.explode(reach_column(plan)).alias("rule_seq"))
                .withColumn("read_prefix", _by_seq(plan, "read_prefix"))
                .withColumn("write_prefix", _by_seq(plan, "write_prefix"))
                .withColumn("read_path", F.col("read_path")))
    reach = _finish(reach.withColumn("is_dir", F.lit(None).cast("boolean"))
                         .withColumn("size", F.lit(None).cast("bigint"))
                         .withColumn("mtime", F.lit(None).cast("timestamp"))
                         .withColumn("content_hash", F.lit(None).cast("string")), False)
    parents = track(inventory, plan).where("is_parent")
    allr = reach.select("rule_seq", "read_path", "write_path").unionByName(
        parents.select("rule_seq", "read_path", "write_path"))
    return (allr.groupBy("read_path")
                .agg(F.count_distinct("rule_seq").alias("n_rules"),
                     F.min("rule_seq").alias("first_seq"),
                     F.min_by("write_path", "rule_seq").alias("write_path"))
                .where(F.col("n_rules") > 1))


def case_collisions(df: DataFrame, col: str = "path") -> DataFrame:
    """Paths equal after ASCII case folding: ``folded, n_paths, first_path, last_path``."""
    return (df.groupBy(P.fold(col).alias("folded"))
              .agg(F.count_distinct(col).alias("n_paths"),
                   F.min(col).alias("first_path"),
                   F.max(col).alias("last_path"))
              .where(F.col("n_paths") > 1))
