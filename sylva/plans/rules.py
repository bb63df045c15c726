"""Rule tables: ``seq int, verb string, arg1 string, arg2 string``.

Verbs, applied in ``seq`` order:

* ``set glob-matching|match-hidden <bool>``  flags for what follows
* ``root <alias> <replacement>``  alias for a leading path segment (first wins)
* ``in <write path> [<read path>]``  destination for later ``add``s (and one add)
* ``add <read path>``  track entries matching a pattern
* ``ignore <pattern>`` / ``include <pattern>``  start / end an ignore

A rule table is configuration, of tens to thousands of rows. It is collected once and
compiled into a :class:`RulePlan`: per ``add`` a read prefix, an anchored regex
and the alternation of the ignores active at that point; for the destination
side the ignores active at the end under the final flags. All heavy work then
runs in Spark against those literal patterns.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sylva.functions import globs
from sylva.functions.paths import normalize_relative_text, normalize_text

RULE_SCHEMA = "seq int, verb string, arg1 string, arg2 string"

# fixed values: spellings accepted for booleans in ``set`` rules
_TRUE = {"true", "t", "1", "yes", "y"}
_FALSE = {"false", "f", "0", "no", "n"}


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Ignore:
    seq: int
    pattern: str
    match_hidden: bool
    glob_on: bool

    @property
    def regex(self) -> str:
        return globs.ignore_regex(self.pattern, self.match_hidden, self.glob_on)


@dataclass(frozen=True)
class AddRule:
    seq: int
    read_pattern: str
    write_prefix: str
    read_prefix: str
    regex: str
    literal_prefix: str
    match_hidden: bool
    glob_on: bool
    ignores: tuple[Ignore, ...]

    @property
    def ignore_regex(self) -> str | None:
        return globs.any_of([i.regex for i in self.ignores])


@dataclass
class RulePlan:
    adds: list[AddRule]
    aliases: list[tuple[str, str, int]]
    final_ignores: list[Ignore]
    match_hidden: bool
    glob_on: bool
    version: str
    base: str = "/"
    rows: list[tuple] = field(default_factory=list)
    intervals: list[tuple[str, int, int | None]] = field(default_factory=list)
    flag_log: list[tuple[int, bool, bool]] = field(default_factory=list)

    def flags_at(self, seq: int) -> tuple[bool, bool]:
        """(glob_on, match_hidden) in force when rule ``seq`` is read."""
        glob_on, hidden = True, True
        for s, g, h in self.flag_log:
            if s < seq:
                glob_on, hidden = g, h
        return glob_on, hidden

    def ignores_at(self, seq: int) -> list[Ignore]:
        """Ignores active when rule ``seq`` is read, with the flags then."""
        glob_on, hidden = self.flags_at(seq)
        return [Ignore(f, p, hidden, glob_on) for p, f, t in self.intervals
                if f < seq and (t is None or t > seq)]

    def ignore_regex_at(self, seq: int) -> str | None:
        return globs.any_of([i.regex for i in self.ignores_at(seq)])

    @property
    def final_ignore_regex(self) -> str | None:
        return globs.any_of([i.regex for i in self.final_ignores])

    @property
    def write_prefixes(self) -> list[str]:
        return sorted({a.write_prefix for a in self.adds})

    @property
    def destination_roots(self) -> list[str]:
        """Write prefixes and their ancestors: created, never deleted."""
        out = set()
        for wp in self.write_prefixes:
            segs = [x for x in wp.split("/") if x]
            for k in range(1, len(segs) + 1):
                out.add("/" + "/".join(segs[:k]))
        return sorted(out)


def rules_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A rule table from ``(seq, verb, arg1, arg2)`` tuples."""
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _bool(text: str | None) -> bool:
    v = (text or "").strip().lower()
    if v in _TRUE:
        return True
    if v in _FALSE:
        return False
    raise RuleError(f"cannot read {text!r} as a boolean")


def collect_rules(rules) -> list[tuple]:
    """Rules are configuration, compiled on the driver: a rule table is read whole there."""
    if isinstance(rules, DataFrame):
        rows = [tuple(r) for r in rules.select("seq", "verb", "arg1", "arg2").collect()]
    else:
        rows = [tuple(r) + (None,) * (4 - len(r)) for r in rules]
    return sorted(rows, key=lambda r: r[0])


def compile_rules(rules, base: str = "/") -> RulePlan:
    """Compile a rule table (DataFrame or tuples) into a :class:`RulePlan`.

    Relative paths are made absolute against ``base`` (the working directory
    of the rules); relative ignores stay relative (they match at any depth).
    """
    rows = collect_rules(rules)
    base = normalize_text(base)
    glob_on = True
    hidden = True
    aliases: dict[str, tuple[str, int]] = {}
    active: dict[str, Ignore] = {}
    opened: dict[str, int] = {}
    intervals: list[tuple[str, int, int | None]] = []
    write_prefix: str | None = None
    adds: list[AddRule] = []
    flag_log: list[tuple[int, bool, bool]] = []

    def subst(p: str) -> str:
        p = normalize_relative_text(p)
        if p.startswith("/"):
            return p
        first, _, rest = p.partition("/")
        if first in aliases:
            repl = aliases[first][0]
            return repl if not rest else repl.rstrip("/") + "/" + rest
        return p

    def add(seq: int, pattern: str) -> None:
        if write_prefix is None:
            raise RuleError(f"rule {seq}: 'add' before any 'in'")
        read = normalize_text(subst(pattern), base)
        comp = globs.compile_add(read, hidden, glob_on)
        ign = tuple(Ignore(i.seq, i.pattern, hidden, glob_on) for i in active.values())
        adds.append(AddRule(seq, read, write_prefix, comp.read_prefix, comp.regex,
                            comp.literal_prefix, hidden, glob_on, ign))

    for seq, verb, arg1, arg2 in rows:
        verb = (verb or "").strip().lower()
        if verb == "set":
            opt = (arg1 or "").strip()
            if opt == "glob-matching":
                glob_on = _bool(arg2)
            elif opt == "match-hidden":
                hidden = _bool(arg2)
            else:
                raise RuleError(f"rule {seq}: unknown option {opt!r}")
            flag_log.append((seq, glob_on, hidden))
        elif verb == "root":
            if not arg1 or arg2 is None:
                raise RuleError(f"rule {seq}: 'root' needs an alias and a replacement")
            alias = normalize_relative_text(arg1)
            if alias not in aliases:
                aliases[alias] = (normalize_text(arg2, base), seq)
        elif verb == "in":
            if not arg1:
                raise RuleError(f"rule {seq}: 'in' needs a write path")
            write_prefix = normalize_text(subst(arg1), base)
            if arg2:
                add(seq, arg2)
        elif verb == "add":
            if not arg1:
                raise RuleError(f"rule {seq}: 'add' needs a read path")
            add(seq, arg1)
        elif verb == "ignore":
            if not arg1:
                raise RuleError(f"rule {seq}: 'ignore' needs a path")
            p = subst(arg1).rstrip("/") or "/"
            if p not in active:
                active[p] = Ignore(seq, p, hidden, glob_on)
                opened[p] = seq
        elif verb == "include":
            if not arg1:
                raise RuleError(f"rule {seq}: 'include' needs a path")
            p = subst(arg1).rstrip("/") or "/"
            if p not in active:
                raise RuleError(f"rule {seq}: no ignore {p!r} to include")
            del active[p]
            intervals.append((p, opened.pop(p), seq))
        else:
            raise RuleError(f"rule {seq}: unknown verb {verb!r}")

    for p, s in opened.items():
        intervals.append((p, s, None))
    final = [Ignore(i.seq, i.pattern, hidden, glob_on) for i in active.values()]
    digest = hashlib.sha256(repr((base, rows)).encode()).hexdigest()[:16]
    return RulePlan(adds, [(a, r, s) for a, (r, s) in aliases.items()], final, hidden,
                    glob_on, digest, base, rows, intervals, flag_log)
