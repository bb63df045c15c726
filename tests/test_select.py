"""Rules, selection and the documented deviations D1-D11 on small trees."""

from __future__ import annotations

import pytest

from conftest import inventory, tree
from sylva.operators import filters as Fl
from sylva.operators import paths as Pa
from sylva.operators import select as S
from sylva.plans import sync
from sylva.plans.rules import RuleError, compile_rules


def paths(df, col="path"):
    return sorted(r[0] for r in df.select(col).collect())


def tracked(spark, files, rules, dirs=()):
    return S.expected(S.track(tree(spark, files, dirs), compile_rules(rules)))


def test_rules_aliases_first_definition_wins():
    p = compile_rules([(1, "root", "X", "/a"), (2, "root", "X", "/b"), (3, "in", "X/out", None),
                       (4, "add", "X/src/**", None)])
    assert p.adds[0].write_prefix == "/a/out"
    assert p.adds[0].read_prefix == "/a/src"


def test_rules_from_a_dataframe(spark):
    from sylva.plans.rules import rules_frame

    rows = [(2, "add", "/r/**", None), (1, "in", "/d", None), (3, "ignore", "*.tmp", None)]
    a, b = compile_rules(rules_frame(spark, rows)), compile_rules(rows)
    assert a.adds == b.adds and a.version == b.version and a.final_ignore_regex == b.final_ignore_regex


def test_rules_include_unknown_is_an_error():
    with pytest.raises(RuleError):
        compile_rules([(1, "include", "*.exe", None)])


def test_rules_add_needs_in():
    with pytest.raises(RuleError):
        compile_rules([(1, "add", "/x", None)])


def test_rules_relative_paths_use_base():
    p = compile_rules([(1, "root", "x", "dest"), (2, "in", "x", None), (3, "add", "source/**", None)], base="/w")
    assert p.adds[0].write_prefix == "/w/dest"  # D8: made absolute
    assert p.adds[0].read_prefix == "/w/source"


def test_read_prefix_keeps_named_directory():
    p = compile_rules([(1, "in", "/d", None), (2, "add", "/r/x", None), (3, "add", "/r/d1/d2*/d3", None),
                       (4, "add", "/r/d1/d2*/f*", None)])
    assert [a.read_prefix for a in p.adds] == ["/r", "/r", "/r/d1"]


def test_track_first_claim_and_write_paths(spark):
    files = [("/r/a.txt", False), ("/r/s/b.txt", False), ("/r/s/c.md", False)]
    rules = [(1, "in", "/d1", None), (2, "add", "/r/**/*.md", None), (3, "in", "/d2", None), (4, "add", "/r/**", None)]
    t = {(r.read_path, r.rule_seq, r.write_path, r.is_parent) for r in tracked(spark, files, rules).collect()}
    assert ("/r/s/c.md", 2, "/d1/s/c.md", False) in t
    assert ("/r/a.txt", 4, "/d2/a.txt", False) in t
    # the directory is a parent for the first rule and a match for the second
    assert ("/r/s", 2, "/d1/s", True) in t and ("/r/s", 4, "/d2/s", False) in t
    assert not any(r[0] == "/r/s/c.md" and r[1] == 4 for r in t)


def test_d1_ignore_with_repeated_name(spark):
    files = [("/r/a/a/b/f", False), ("/r/a/c", False)]
    rules = [(1, "in", "/d", None), (2, "ignore", "a/b", None), (3, "add", "/r/**", None)]
    got = paths(tracked(spark, files, rules), "read_path")
    assert "/r/a/a/b" not in got and "/r/a/a/b/f" not in got and "/r/a/c" in got


def test_d2_empty_add_does_not_stop_later_rules(spark):
    files = [("/r/x", False)]
    rules = [(1, "in", "/d", None), (2, "add", "/nothing/**", None), (3, "add", "/r/**", None)]
    assert paths(tracked(spark, files, rules), "read_path") == ["/r/x"]


def test_d3_shared_parent_is_expected_once(spark):
    src = tree(spark, [("/r/s/a.txt", False), ("/r/s/b.md", False)])
    dst = tree(spark, [("/d/s/a.txt", False, 1, 0, "h:a.txt"), ("/d/s/b.md", False, 1, 0, "h:b.md")])
    rules = [(1, "in", "/d", None), (2, "add", "/r/**/*.txt", None), (3, "add", "/r/**/*.md", None)]
    assert sync.check(src, dst, rules).public.count() == 0


def test_d4_nested_write_prefixes(spark):
    src = tree(spark, [("/r1/a", False), ("/r2/b", False)])
    dst = tree(spark, [("/d/a", False, 1, 0, "h:a"), ("/d/sub/b", False, 1, 0, "h:b")])
    rules = [(1, "in", "/d", None), (2, "add", "/r1/**", None), (3, "in", "/d/sub", None), (4, "add", "/r2/**", None)]
    assert sync.check(src, dst, rules).public.count() == 0


def test_d5_case_sensitive_keys_and_collisions(spark):
    src = tree(spark, [("/r/A.txt", False), ("/r/a.txt", False), ("/r/É.txt", False), ("/r/é.txt", False)])
    dst = tree(spark, [], dirs=["/d"])
    ch = sync.check(src, dst, [(1, "in", "/d", None), (2, "add", "/r/**", None)]).public
    assert sorted(r.dest_path for r in ch.where("change = 'add'").collect()) == \
        ["/d/A.txt", "/d/a.txt", "/d/É.txt", "/d/é.txt"]
    col = S.case_collisions(src).collect()
    assert [(r.folded, r.n_paths) for r in col] == [("/r/a.txt", 2)]  # non-ASCII capitals do not fold


def test_d6_trailing_bracket_is_literal(spark):
    df = inventory(spark, [("a[", False), ("a[x", False), ("a[!", False), ("a[!y", False)])
    assert paths(Fl.glob_filter(df, "path", "a[")) == ["a["]
    assert paths(Fl.glob_filter(df, "path", "a[!")) == ["a[!"]


def test_d7_kind_change_is_a_modify(spark):
    src = tree(spark, [("/r/x/child", False)])
    dst = tree(spark, [("/d/x", False, 1, 0, "h:x")])
    ch = sync.check(src, dst, [(1, "in", "/d", None), (2, "add", "/r/**", None)]).public
    rows = {(r.change, r.dest_path): r.kind_changed for r in ch.collect()}
    assert rows[("modify", "/d/x")] is True
    assert ("add", "/d/x/child") in rows


def test_d8_absolute_ignore_reaches_relative_destination(spark):
    src = tree(spark, [("/w/src/a", False)])
    dst = tree(spark, [("/w/dest/a", False, 1, 0, "h:a"), ("/w/dest/keep/k", False)])
    rules = [(1, "in", "dest", None), (2, "add", "src/**", None), (3, "ignore", "/w/dest/keep", None)]
    ch = sync.check(src, dst, rules, base="/w").public
    assert ch.count() == 0


def test_d10_prune_only_without_tracked_below(spark):
    src = tree(spark, [("/x/p1/a", False), ("/x/p2/b", False), ("/x/q/c", False)])
    res = sync.tree(src, [(1, "in", "/d", None), (2, "add", "/x/p1/**", None), (3, "add", "/x/p2/**", None)],
                    prune=True)
    assert res.search_paths.collect()[0].common_path == "/x"
    assert paths(res.pruned) == ["/x/q"]
    listing = {r.path: r for r in res.listing.collect()}
    assert listing["/x/p1"].tracked is False and listing["/x/p1/a"].tracked is True
    assert "/x/q/c" not in listing and listing["/x/q"].pruned is True
    counts = res.counts.collect()[0]
    assert (counts.n_dirs, counts.n_files, counts.n_ignored_dirs, counts.n_ignored_files) == (3, 3, 3, 1)


def test_d11_root_is_no_segment(spark):
    df = tree(spark, [("/a", False), ("/b/c", False)])
    plan = compile_rules([(1, "ignore", "*/*", None)])
    assert paths(Fl.ignore_filter(df, "path", plan)) == ["/a", "/b"]


def test_hidden_names_and_globstar(spark):
    df = tree(spark, [("/r/.h/x.txt", False), ("/r/v/.y.txt", False), ("/r/v/z.txt", False)])
    got = paths(Fl.globstar_filter(df, "path", "/r/**/*.txt", match_hidden=False))
    assert got == ["/r/v/z.txt"]
    assert len(paths(Fl.globstar_filter(df, "path", "/r/**/*.txt"))) == 3


def test_subtree_and_normalize(spark):
    df = inventory(spark, [("/r/s", True), ("/r/s/a", False), ("/r/sx", False)])
    assert paths(Fl.subtree_filter(df, "path", "/r/s")) == ["/r/s", "/r/s/a"]
    raw = spark.createDataFrame([("a/./b/../c//d/",), ("/../x",), ("y",)], "path string")
    assert paths(Pa.normalize_paths(raw, "path", base="/base")) == ["/base/a/c/d", "/base/y", "/x"]


def test_resolve_roots(spark):
    df = spark.createDataFrame([("X/a",), ("X",), ("/X/a",), ("Y/b",)], "path string")
    al = spark.createDataFrame([("X", "/root", 2), ("X", "/other", 1)], "alias string, replacement string, seq int")
    assert paths(Pa.resolve_roots(df, al)) == ["/X/a", "/other", "/other/a", "Y/b"]


def test_ignore_include_validity(spark):
    df = tree(spark, [("/r/a.exe", False), ("/r/b.txt", False)])
    rules = [(1, "in", "/d", None), (2, "ignore", "*.exe", None), (3, "add", "/r/*.txt", None),
             (4, "include", "*.exe", None), (5, "add", "/r/*.exe", None)]
    plan = compile_rules(rules)
    assert paths(Fl.ignore_filter(df, "path", plan, as_of_seq=3)) == ["/r", "/r/b.txt"]
    assert paths(Fl.ignore_filter(df, "path", plan)) == ["/r", "/r/a.exe", "/r/b.txt"]
    assert paths(S.expected(S.track(df, plan)), "read_path") == ["/r/a.exe", "/r/b.txt"]


def test_duplicate_claims(spark):
    df = tree(spark, [("/r/s/a.md", False), ("/r/t/b.txt", False)])
    rules = [(1, "in", "/d", None), (2, "add", "/r/**/*.md", None), (3, "add", "/r/**", None)]
    got = {r.read_path: (r.n_rules, r.first_seq) for r in S.duplicate_claims(df, compile_rules(rules)).collect()}
    assert got == {"/r/s/a.md": (2, 2), "/r/s": (2, 2)}


def test_small_rule_file_on_three_file_tree(spark):
    """A rule table with a relative alias, an add that matches nothing, a path
    claimed twice and an ignore/include pair, on a tree of two equal 12-byte
    files and one 42-byte file in a sub-directory."""
    base = "/tree"
    src = tree(spark, [(base + "/a.txt", False, 12, 0, "same"), (base + "/tmp.txt", False, 12, 0, "same"),
                       (base + "/source/tmp.txt", False, 42, 0, "big")])
    rules = [(3, "root", "x", "dest"), (19, "ignore", "ignore.txt", None),
             (20, "ignore", "**/beans/a/**/thing.txt", None), (22, "in", "dest2", "nonexistent.dat"),
             (23, "in", "x", "source/**"), (24, "in", "dest2", "source/tmp.txt"),
             (26, "ignore", "*.exe", None), (33, "include", "*.exe", None)]
    plan = compile_rules(rules, base=base)
    t = [(r.rule_seq, r.read_path, r.write_path) for r in S.expected(S.track(src, plan)).collect()]
    # line 24 asks for a path line 23 already claimed; line 22 matches nothing
    assert t == [(23, "/tree/source/tmp.txt", "/tree/dest/tmp.txt")]
    ch = sync.check(src, tree(spark, [], dirs=[base]), plan).public.collect()
    assert [(r.change, r.dest_path) for r in ch] == [("add", "/tree/dest/tmp.txt")]


def test_many_adds_by_prefix_claim_what_the_case_does(spark, monkeypatch):
    """Random rules and trees, once as one CASE and once through the prefix join."""
    import random

    rng = random.Random(21)
    names = ["a", "b", ".h", "x.md", "y.md", "c d"]
    files = sorted({"/" + "/".join(rng.choices(names, k=rng.randint(1, 5))) for _ in range(150)})
    inv = tree(spark, [(f, False) for f in files if not any(g.startswith(f + "/") for g in files)])
    for _ in range(3):
        rules = [(1, "in", "/d", None)]
        for seq in range(2, 40):
            pat = "/" + "/".join(rng.choices([*names, "**", "*", "?", "*.md", "[ab]"], k=rng.randint(1, 4)))
            rules.append((seq, rng.choice(["add", "add", "add", "ignore"]), pat, None))
        seen, plan = set(), []
        for r in rules:  # an ignore may not be repeated with another meaning
            if r[1] != "ignore" or r[2] not in seen:
                plan.append(r)
                seen.add(r[2])
        got = []
        for limit in (10_000, 0):
            monkeypatch.setattr(S, "CASE_RULES", limit)
            got.append(sorted((r.rule_seq, r.read_path, r.write_path, r.is_parent) for r in S.track(inv, compile_rules(plan)).collect()))
        assert got[0] == got[1] and got[0]
    monkeypatch.setattr(S, "CASE_RULES", 0)
    text = S.claimed(inv, compile_rules([(1, "in", "/d", None), (2, "add", "/a/**", None)]))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN (StartsWith" not in text and "Join Inner" in text
