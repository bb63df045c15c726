"""Filters on path columns: glob, globstar, subtree and ignore.

Every pattern is turned into one literal regex on the driver; the filter is a
plain ``rlike`` (codegen, no Python). A literal lead of the pattern is added as
``startswith`` so Parquet can skip row groups (``StringStartsWith`` pushdown).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions import globs
from sylva.functions.paths import normalize_text


def literal_lead(pattern: str, glob_on: bool = True) -> str:
    """Longest wildcard-free run of leading directories, with its trailing '/'."""
    segs = pattern.split("/")
    lead = []
    for s in segs[:-1]:
        if s == globs.GLOBSTAR or (glob_on and globs.contains_wildcard(s)):
            break
        lead.append(s)
    return "/".join(lead) + "/" if lead else ""


def _with_lead(c: Column, regex: str, lead: str) -> Column:
    cond = c.rlike(regex)
    return c.startswith(lead) & cond if lead else cond


def glob_filter(df: DataFrame, col: str, pattern: str, match_hidden: bool = True,
                glob_on: bool = True) -> DataFrame:
    """Rows whose ``col`` matches ``pattern`` segment for segment (no globstar)."""
    regex = globs.glob_regex(pattern, match_hidden, glob_on, globstar=False)
    return df.where(_with_lead(F.col(col), regex, literal_lead(pattern, glob_on)))


def globstar_filter(df: DataFrame, col: str, pattern: str, match_hidden: bool = True,
                    glob_on: bool = True) -> DataFrame:
    """As :func:`glob_filter`, with a whole-segment ``**`` = zero or more directories."""
    regex = globs.glob_regex(pattern, match_hidden, glob_on, globstar=True)
    return df.where(_with_lead(F.col(col), regex, literal_lead(pattern, glob_on)))


def subtree_filter(df: DataFrame, col: str, path: str, match_hidden: bool = True,
                   glob_on: bool = True, base: str = "/") -> DataFrame:
    """Rows an ``add path`` selects: a last name without wildcards takes the
    entry itself and everything below it."""
    comp = globs.compile_add(normalize_text(path, base), match_hidden, glob_on)
    return df.where(_with_lead(F.col(col), comp.regex, comp.literal_prefix if comp.read_prefix != "/" else ""))


def ignored(col: Column | str, regex: str | None) -> Column:
    """True when the path (or an ancestor) matches the ignore alternation."""
    c = F.col(col) if isinstance(col, str) else col
    if regex is None:
        return F.lit(False)
    return c.rlike(regex)


def ignore_filter(df: DataFrame, col: str, plan, as_of_seq: int | None = None,
                  as_of_col: str | None = None) -> DataFrame:
    """Drop rows ignored by the rules.

    * ``as_of_seq=None`` and no ``as_of_col``: the ignores active at the end of
      the rules with the final flags (the destination side);
    * ``as_of_seq=n``: those active just before rule ``n``, flags as then;
    * ``as_of_col``: per row, the ignores active at that row's rule seq. The
      few distinct rule positions become one CASE over literal regexes, so no
      per-row regex compilation and no join is needed.
    """
    c = F.col(col)
    if as_of_col is not None:
        cond = None
        for seq in sorted({r[0] for r in plan.rows}):
            rx = plan.ignore_regex_at(seq)
            branch = ignored(c, rx)
            cond = (F.when(F.col(as_of_col) == seq, branch) if cond is None
                    else cond.when(F.col(as_of_col) == seq, branch))
        if cond is None:
            return df
        return df.where(~F.coalesce(cond, F.lit(False)))
    rx = plan.final_ignore_regex if as_of_seq is None else plan.ignore_regex_at(as_of_seq)
    return df if rx is None else df.where(~ignored(c, rx))
