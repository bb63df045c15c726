"""Diff of an expected against an actual snapshot.

``pair`` is one full outer equi join on the destination path; equality is a
column expression on the joined row; leftovers on the actual side become
deletions unless an ignore protects them (``orphans``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions import paths as P
from sylva.operators.filters import ignored

CHANGE_COLUMNS = ["change", "source_path", "dest_path", "size", "kind_changed"]
# Internal columns carried along for rename pairing and the apply step.
WIDE_COLUMNS = CHANGE_COLUMNS + ["is_dir", "content_hash", "mtime", "d_is_dir", "d_size", "d_mtime", "d_hash"]

FAST_TOLERANCE_US = 2_000_000


def in_scope(actual: DataFrame, write_prefixes: list[str], col: str = "path") -> DataFrame:
    """Destination rows strictly below one of the write prefixes (pushed down as
    ``StringStartsWith``)."""
    if not write_prefixes:
        return actual.limit(0)
    cond = None
    for wp in write_prefixes:
        c = P.is_below(col, wp)
        cond = c if cond is None else cond | c
    return actual.where(cond)


def pair(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Full outer join of expected (``write_path``) and actual (``path``) rows.

    Output: ``source_path, dest_path, s_*`` and ``d_*`` attributes, null on the
    missing side (and ``verdicts``, if the actual rows have them).
    """
    e = expected.select(
        F.col("write_path").alias("dest_path"), F.col("read_path").alias("source_path"),
        F.col("is_dir").alias("s_is_dir"), F.col("size").alias("s_size"),
        F.col("mtime").alias("s_mtime"), F.col("content_hash").alias("s_hash"),
    )
    a = actual.select(
        F.col("path").alias("dest_path"), F.col("is_dir").alias("d_is_dir"),
        F.col("size").alias("d_size"), F.col("mtime").alias("d_mtime"),
        F.col("content_hash").alias("d_hash"), *[c for c in actual.columns if c == "verdicts"],
    )
    return e.join(a, "dest_path", "full_outer")


def content_equal(s_is_dir="s_is_dir", d_is_dir="d_is_dir", s_size="s_size", d_size="d_size",
                  s_hash="s_hash", d_hash="d_hash") -> Column:
    """Exact equality: directories equal when both are directories (same name
    by construction); files when sizes agree and then the content hashes."""
    sd, dd = F.col(s_is_dir), F.col(d_is_dir)
    return (F.when(sd.isNull() | dd.isNull(), F.lit(False))
             .when(sd | dd, sd & dd)
             .when(F.col(s_size) != F.col(d_size), F.lit(False))
             .otherwise(F.coalesce(F.col(s_hash) == F.col(d_hash), F.lit(False))))


def fast_equal(tolerance_us: int = FAST_TOLERANCE_US, s_is_dir="s_is_dir", d_is_dir="d_is_dir",
               s_mtime="s_mtime", d_mtime="d_mtime") -> Column:
    """Fast equality: files equal when their mtimes differ by less than the
    tolerance (2 s); directories as in :func:`content_equal`."""
    sd, dd = F.col(s_is_dir), F.col(d_is_dir)
    delta = F.abs(F.unix_micros(F.col(s_mtime)) - F.unix_micros(F.col(d_mtime)))
    return (F.when(sd.isNull() | dd.isNull(), F.lit(False))
             .when(sd | dd, sd & dd)
             .otherwise(F.coalesce(delta < tolerance_us, F.lit(False))))


STATE_COLUMNS = ["source_path", "dest_path", "source_mtime", "dest_mtime", "equal", "rules_version"]


def with_verdicts(actual: DataFrame, state: DataFrame, rules_version: str) -> DataFrame:
    """Destination rows with the stored ``verdicts`` about them (one for each source they have been paired with).

    Both sides are keyed by destination path, as the diff that follows is, so the
    lookup comes before it: over tables in buckets by that path it adds no
    exchange, else one of the state's rows."""
    verdict = F.struct("source_path", "source_mtime", "dest_mtime", "equal")
    known = (state.where(F.col("rules_version") == rules_version)
                  .groupBy(F.col("dest_path").alias("path")).agg(F.collect_list(verdict).alias("verdicts")))
    return actual.join(known, "path", "left")


def _both_files() -> Column:
    return F.col("source_path").isNotNull() & F.col("d_is_dir").isNotNull() & ~F.col("s_is_dir") & ~F.col("d_is_dir")


def judged_by_verdicts(pairs: DataFrame) -> DataFrame:
    """Pairs with ``equal`` and ``state_hit``: a stored verdict about the pair's source is reused when both mtimes
    are unchanged; only the other file pairs are compared."""
    same = F.filter("verdicts", lambda v: (v["source_path"] == F.col("source_path")) & (v["source_mtime"] == F.col("s_mtime"))
                    & (v["dest_mtime"] == F.col("d_mtime")))
    known = F.when(_both_files(), F.get(same, F.lit(0)).getField("equal"))
    return (pairs.withColumn("_known", known).withColumn("state_hit", F.col("_known").isNotNull())
                 .withColumn("equal", F.coalesce("_known", content_equal())).drop("_known", "verdicts"))


def incremental_equal(pairs: DataFrame, state: DataFrame | None, rules_version: str, evict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Exact equality that reuses stored verdicts.

    A stored verdict for (source, dest) is reused when both mtimes are
    unchanged; only the other file pairs are compared. Returns the pairs with
    an ``equal`` column and the refreshed state (compared pairs, plus stored
    entries not seen this time unless ``evict``).
    """
    if state is None:
        out = pairs.withColumn("equal", content_equal()).withColumn("state_hit", F.lit(False))
    elif "verdicts" in pairs.columns:
        out = judged_by_verdicts(pairs)
    else:
        known = with_verdicts(pairs.select(F.col("dest_path").alias("path"), *[c for c in pairs.columns if c != "dest_path"]), state, rules_version)
        out = judged_by_verdicts(known.withColumnRenamed("path", "dest_path"))
    fresh = out.where(_both_files()).select(
        "source_path", "dest_path", F.col("s_mtime").alias("source_mtime"),
        F.col("d_mtime").alias("dest_mtime"), "equal", F.lit(rules_version).alias("rules_version"))
    return out, _refreshed(fresh, state, rules_version, evict)


def _refreshed(fresh: DataFrame, state: DataFrame | None, rules_version: str, evict: bool) -> DataFrame:
    """Compared pairs, plus stored ones not seen this time unless ``evict``."""
    if state is None or evict:
        return fresh
    kept = state.where(F.col("rules_version") == rules_version).select(*STATE_COLUMNS) \
        .join(fresh.select("source_path", "dest_path"), ["dest_path", "source_path"], "left_anti")
    return fresh.unionByName(kept)


def orphans(leftovers: DataFrame, ignore_regex: str | None, col: str = "path") -> DataFrame:
    """Leftover destination rows that are deleted.

    An ignored leftover (it or an ancestor matches an active ignore) survives
    and keeps all its ancestors alive. Ancestors are exploded from the distinct
    parents of ignored leftovers only (bounded by depth).
    """
    if ignore_regex is None:
        return leftovers
    flagged = leftovers.withColumn("_ign", ignored(col, ignore_regex))
    keep = flagged.where("_ign")
    protected = (keep.select(P.parent(col).alias("_p")).where(F.col("_p").isNotNull()).distinct()
                     .select(F.explode(F.array_union(P.ancestors("_p"), F.array("_p"))).alias(col))
                     .distinct())
    return flagged.where(~F.col("_ign")).drop("_ign").join(protected, col, "left_anti")


def diff_rows(pairs: DataFrame, keep_same_files: bool = False) -> DataFrame:
    """The rows of judged pairs that are not "same", labelled in one pass:
    ``add`` (no destination row), ``modify`` (both, unequal) and
    ``leftover`` (destination row nobody expects). The full outer join is
    consumed exactly once here; everything after works on these rows.

    ``keep_same_files`` also keeps equal file pairs (``same``), so the
    refreshed equivalence state can be derived from the same pass."""
    label = (F.when(F.col("source_path").isNull(), F.lit("leftover"))
              .when(F.col("d_is_dir").isNull(), F.lit("add"))
              .when(~F.col("equal"), F.lit("modify")))
    if keep_same_files:
        label = label.when(~F.col("s_is_dir") & ~F.col("d_is_dir"), F.lit("same"))
    # of equal files only the paths and times are read again
    changed = {c: F.when(F.col("change") != "same", F.col(c)).alias(c) for c in ("s_size", "s_hash", "d_size", "d_hash")}
    return pairs.withColumn("change", label).where(F.col("change").isNotNull()).select(*[
        changed.get(c, F.col(c)) if keep_same_files else F.col(c) for c in (
            "change", "source_path", "dest_path", "s_is_dir", "s_size", "s_mtime", "s_hash",
            "d_is_dir", "d_size", "d_mtime", "d_hash")])


def state_from_diff(diff: DataFrame, state: DataFrame | None, rules_version: str, evict: bool = False) -> DataFrame:
    """Refreshed state: every compared file pair (``same`` / ``modify`` rows of
    a ``keep_same_files`` diff) plus stored entries not seen this time, unless ``evict``."""
    both_files = F.col("change").isin("same", "modify") & ~F.col("s_is_dir") & ~F.col("d_is_dir")
    fresh = diff.where(both_files).select(
        "source_path", "dest_path", F.col("s_mtime").alias("source_mtime"), F.col("d_mtime").alias("dest_mtime"),
        (F.col("change") == "same").alias("equal"), F.lit(rules_version).alias("rules_version"))
    return _refreshed(fresh, state, rules_version, evict)


def leftovers(diff: DataFrame) -> DataFrame:
    return diff.where(F.col("change") == "leftover").select(
        F.col("dest_path").alias("path"), F.col("d_is_dir").alias("is_dir"), F.col("d_size").alias("size"),
        F.col("d_mtime").alias("mtime"), F.col("d_hash").alias("content_hash"))


def changes_from_diff(diff: DataFrame, deletions: DataFrame) -> DataFrame:
    """Wide change rows (``WIDE_COLUMNS``) from labelled diff rows and the
    deletions left after ignore protection."""
    upd = diff.where(F.col("change").isin("add", "modify")).select(
        "change", "source_path", "dest_path",
        F.col("s_size").alias("size"),
        F.when(F.col("change") == "modify", F.col("s_is_dir") != F.col("d_is_dir"))
         .otherwise(F.lit(False)).alias("kind_changed"),
        F.col("s_is_dir").alias("is_dir"), F.col("s_hash").alias("content_hash"), F.col("s_mtime").alias("mtime"),
        "d_is_dir", "d_size", "d_mtime", "d_hash",
    )
    dels = deletions.select(
        F.lit("delete").alias("change"), F.lit(None).cast("string").alias("source_path"),
        F.col("path").alias("dest_path"), "size", F.lit(False).alias("kind_changed"),
        "is_dir", "content_hash", "mtime",
        F.col("is_dir").alias("d_is_dir"), F.col("size").alias("d_size"),
        F.col("mtime").alias("d_mtime"), F.col("content_hash").alias("d_hash"),
    )
    return upd.unionByName(dels)


def public(changes: DataFrame) -> DataFrame:
    return changes.select(*CHANGE_COLUMNS)


def _row_marks(cols: list[str]) -> list[Column]:
    """128 bits of a row's values in four longs of 32 bits, whose sums can't overflow below 2**31 rows of a key.
    Null flags go in: the hash function alone skips nulls."""
    values = [x for c in cols for x in (F.col(c), F.col(c).isNull())]
    out = []
    for seed in (0, 1):
        h = F.xxhash64(F.lit(seed), *values)
        out += [h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned(h, 32)]
    return out


def snapshot_diff(expected: DataFrame, actual: DataFrame, keys: list[str],
                  value_cols: list[str] | None = None) -> DataFrame:
    """Keyed snapshot diff: ``change`` (add / modify / delete) plus the keys.

    Absent in actual -> add; present and some value differs (null-safe) ->
    modify; only in actual -> delete. Null keys equal each other. A key with
    several rows is compared as a multiset of rows: one ``modify`` if they differ.

    One aggregate by key, combined before its only shuffle: the counts of
    either side, and the signed sums of each row's 128-bit mark, which are all
    zero where the two multisets are equal (and else by a chance of 2**-128).
    """
    if value_cols is None:
        value_cols = [c for c in expected.columns if c not in keys]
    marks = [f"_m{i}" for i in range(4)]

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*keys, F.lit(sign).alias("_s"), *[(m * sign).alias(n) for m, n in zip(_row_marks(value_cols), marks)])

    both = side(expected, 1).unionByName(side(actual, -1))
    by_key = both.groupBy(*keys).agg(F.count_if(F.col("_s") > 0).alias("_e"), F.count_if(F.col("_s") < 0).alias("_a"),
                                     *[F.sum(m).alias(m) for m in marks])
    differs = F.col("_e") != F.col("_a")
    for m in marks:
        differs = differs | (F.col(m) != 0)
    change = (F.when(F.col("_a") == 0, F.lit("add"))
               .when(F.col("_e") == 0, F.lit("delete"))
               .when(differs, F.lit("modify")))
    return by_key.select(change.alias("change"), *keys).where(F.col("change").isNotNull())
