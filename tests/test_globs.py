"""Glob matching: the fixed expectations, the wildcard test and a brute-force
matcher on random cases."""

from __future__ import annotations

import json
import os
import random

from pyspark.sql import functions as F

from sylva.functions import globs

HERE = os.path.dirname(os.path.abspath(__file__))
CASES = json.load(open(os.path.join(HERE, "fixtures", "glob_cases.json"), encoding="utf-8"))


def test_all_glob_expectations(spark):
    rows = [(i, p, t, h, e, globs.glob_regex(p, h)) for i, (p, t, h, e) in enumerate(CASES["glob"])]
    assert len(rows) == 460
    df = spark.createDataFrame(rows, "i int, p string, t string, h boolean, e boolean, r string")
    bad = df.where(F.expr("(t rlike r) != e")).collect()
    assert bad == []


def test_wildcard_expectations():
    assert len(CASES["wildcard"]) == 17
    for pattern, expected in CASES["wildcard"]:
        assert globs.contains_wildcard(pattern) == expected, pattern


# ---------------------------------------------------------------- brute force


def _seg_match(p: str, s: str, hidden: bool) -> bool:
    """Straightforward recursive matcher of one segment (our semantics)."""
    if not hidden and p[:1] in ("*", "?") and s[:1] == ".":
        return False

    def rec(i: int, j: int) -> bool:
        if i == len(p):
            return j == len(s)
        c = p[i]
        if c == "*":
            return any(rec(i + 1, k) for k in range(j, len(s) + 1))
        if c == "?":
            return j < len(s) and rec(i + 1, j + 1)
        if c == "[":
            k = i + 1
            neg = k < len(p) and p[k] in "!^"
            if neg:
                k += 1
            if k >= len(p):
                return s[j:] == p[i:]
            close = p.find("]", k + 1)
            if close < 0:
                if p[k] == "]":
                    lit = p[k - 1] if neg else "[]"
                    return s.startswith(lit, j) and rec(k + 1, j + len(lit))
                return j < len(s) and s[j] == "[" and rec(i + 1, j + 1)
            if j >= len(s):
                return False
            mem, m, hit = p[k:close], 0, False
            while m < len(mem):
                if m + 2 < len(mem) and mem[m + 1] == "-":
                    hit |= mem[m] <= s[j] <= mem[m + 2]
                    m += 3
                else:
                    hit |= mem[m] == s[j]
                    m += 1
            return hit != neg and rec(close + 1, j + 1)
        return j < len(s) and s[j] == c and rec(i + 1, j + 1)

    return rec(0, 0)


def _path_match(p: str, s: str, hidden: bool) -> bool:
    ps, ss = p.split("/"), s.split("/")
    return len(ps) == len(ss) and all(_seg_match(a, b, hidden) for a, b in zip(ps, ss))


def _globstar_match(p: str, s: str, hidden: bool) -> bool:
    ps, ss = p.split("/"), s.split("/")

    def rec(i: int, j: int) -> bool:
        if i == len(ps):
            return j == len(ss)
        if ps[i] == "**":
            if i == len(ps) - 1:  # trailing: one or more names
                rest = ss[j:]
                return len(rest) >= 1 and all(x and (hidden or not x.startswith(".")) for x in rest)
            k = j
            while True:
                if rec(i + 1, k):
                    return True
                if k < len(ss) and ss[k] and (hidden or not ss[k].startswith(".")):
                    k += 1
                else:
                    return False
        return j < len(ss) and _seg_match(ps[i], ss[j], hidden) and rec(i + 1, j + 1)

    return rec(0, 0)


ALPHA = "ab.[]!^-*?"


def _rand_pattern(rng):
    segs = []
    for _ in range(rng.randint(1, 3)):
        if rng.random() < 0.15:
            segs.append("**")
        else:
            segs.append("".join(rng.choice(ALPHA) for _ in range(rng.randint(0, 4))))
    return "/".join(segs)


def _rand_text(rng):
    return "/".join("".join(rng.choice("ab.[]!^-") for _ in range(rng.randint(0, 4)))
                    for _ in range(rng.randint(1, 4)))


def test_random_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(3000):
        p, t, h = _rand_pattern(rng), _rand_text(rng), rng.random() < 0.5
        if "**" in p.split("/"):
            rows.append((p, t, h, _globstar_match(p, t, h), globs.glob_regex(p, h, globstar=True)))
        else:
            rows.append((p, t, h, _path_match(p, t, h), globs.glob_regex(p, h)))
    df = spark.createDataFrame(rows, "p string, t string, h boolean, e boolean, r string")
    bad = df.where(F.expr("(t rlike r) != e")).limit(10).collect()
    assert bad == []


def test_ignore_regex_forms():
    import re

    def m(rx, s):  # Java's \\A / \\z as Python's \\A / \\Z
        return re.match(rx.replace(r"\z", r"\Z"), s) is not None

    rx = globs.ignore_regex("a/b")
    assert m(rx, "/x/a/b") and m(rx, "/a/b/c") and m(rx, "/x/a/a/b")  # D1: true globstar
    assert not m(rx, "/a/x/b")
    below = globs.ignore_regex("/p/**")
    assert not m(below, "/p") and m(below, "/p/x") and m(below, "/p/x/y")
    star = globs.ignore_regex("*/*")  # D11: the root is no segment
    assert not m(star, "/a") and m(star, "/a/b")
    assert m(globs.ignore_regex("**"), "/anything/at/all")


def test_many_stars_fail_fast(spark):
    import time

    from pyspark.sql import functions as F

    began = time.time()
    row = spark.range(1).select(F.lit("a" * 100).rlike(globs.glob_regex("*a" * 12 + "*b")).alias("x"),
                                F.lit("xa" * 50 + "b").rlike(globs.glob_regex("*a" * 12 + "*b")).alias("y")).first()
    assert (row["x"], row["y"]) == (False, True) and time.time() - began < 20


def test_deep_paths_end_at_once(spark):
    """A ``**`` neither recurses nor backtracks over the segments of a deep path."""
    import time

    deep = "/" + "/".join(["dir"] * 5000)
    texts = [deep + "/x", deep + "/y", deep + "/.h/x", "/.h" + deep + "/x", deep + "/x/y/z/x"]
    df = spark.createDataFrame([(t,) for t in texts], "path string").coalesce(1)
    began = time.time()
    for pattern, hidden, want in (("/**/x", True, [1, 0, 1, 1, 1]), ("/**/x", False, [1, 0, 0, 0, 1]), ("/**", False, [1, 1, 0, 0, 1]),
                                  ("/**/dir/**/x", False, [1, 0, 0, 0, 1]), ("/**/.h/**", False, [0, 0, 1, 1, 0]),
                                  ("/**/x/**/z/*", True, [0, 0, 0, 0, 1]), ("/**/q/**/x/**/y", True, [0] * 5)):
        got = [r.m for r in df.select(F.col("path").rlike(globs.glob_regex(pattern, hidden, globstar=True)).alias("m")).collect()]
        assert got == [bool(w) for w in want], (pattern, hidden)
    for pattern, want in (("x", [1, 0, 1, 1, 1]), ("**/y/z", [0, 0, 0, 0, 1]), ("/**/.h", [0, 0, 1, 1, 0])):
        got = [r.m for r in df.select(F.col("path").rlike(globs.ignore_regex(pattern)).alias("m")).collect()]
        assert got == [bool(w) for w in want], pattern
    assert time.time() - began < 60
