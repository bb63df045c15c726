"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sylva.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, at long, code string, conv string"
WS = "[^\x20\x09-\x0d]"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def damaged(rows):
    """conv_id -> rows (turn, role, text) after damage, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv] = out[conv]
        role, text = (" " if x is None else x for x in (role, text))
        do = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if do == 1 else re.sub("[.!?]", "", text) if do == 2 else text
        out[conv] += [(turn, "user" if do == 4 else role, text)] * (0 if do == 0 else 2 if do == 3 else 1)
    for conv in out:
        out[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = re.findall(WS, text)
        out.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


GOES_ON = re.compile("(s?(ua)*u?)?")


def cheapest(rows):
    """(cost, audit, repaired rows) by Dijkstra over whole edit sequences."""
    bad = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, roles, kept = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, list(kept)
        if (i, roles[-2:], roles == "", roles[:1] == "s" and len(roles) == 1) in done:
            continue
        done.add((i, roles[-2:], roles == "", roles[:1] == "s" and len(roles) == 1))
        ways = [(2, "I", i, r, ((r, ""),)) for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            ways.append((3, "D", i + 1, "", ()))
            if bad[i] not in ("b", "d"):
                extra = bad[i] == "t"
                ways.append((extra, "K", i + 1, role or "?", ((role, text),)))
                ways += [(2 + extra, "R", i + 1, r, ((r, text),)) for r in ("user", "assistant")]
        for c, letter, j, role, row in ways:
            if GOES_ON.fullmatch(roles + role[:1]):
                heapq.heappush(heap, (cost + c, audit + letter, j, roles + role[:1], kept + row))


def plain(rows):
    out = {}
    for conv, rs in damaged(rows).items():
        turns = [t for t, _, _ in rs if t is not None]
        bad, initials = faults(rs), [r[:1] for _, r, _ in rs]
        cost, audit, kept = cheapest(rs) if rs else (0, "", [])
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, bad.count("b"), bad.count("d"), bad.count("t"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def random_rows(rng, n):
    rows = []
    for conv in range(n):
        for turn in rng.sample(range(14), rng.randint(1, 10)):
            rows.append((conv if conv else None, turn if rng.random() > 0.05 else None, rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "", "Admin", None]),
                         rng.choice(["Hi.", "what?", "no end", " \t", "", None, "é!\n", "ok. "])))
    return rows + rows[5:25]


@pytest.mark.parametrize("bits", [C.SEGMENT_BITS, 1])
def test_repair_equals_a_search_over_all_edits(spark, monkeypatch, bits):
    monkeypatch.setattr(C, "SEGMENT_BITS", bits)  # segments of two rows: most conversations are folded from several
    rows = random_rows(random.Random(8), 120)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in C.repair_digest(frame(spark, rows)).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], (conv, damaged(rows)[conv])


def test_repaired_rows_are_what_the_digest_says(spark):
    rows = random_rows(random.Random(9), 30)
    fixed = C.Repair(C.damage(frame(spark, rows)))
    lines = defaultdict(list)
    for r in sorted(fixed.repaired().collect(), key=lambda r: (r["at"], r["k"])):
        lines[r["conv"]].append(f"{r['role']}:{r['text']}")
    digests = {r["conv"]: r["repaired_sha256"] for r in fixed.digests().collect()}
    for conv, d in digests.items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == d
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines[conv]))


def test_blocks_compose_like_single_symbols():
    t, rng = C.tables(), np.random.default_rng(4)
    assert len(t.vectors) < 200
    for n in (0, 1, 3, 4, 5, 41):
        s = rng.integers(0, C.SYMBOLS, n).astype(np.uint8)
        left, cost, leave = t.compose(s)
        for v, vector in enumerate(t.vectors):
            low, now = 0, vector
            for x in reversed(s.tolist()):
                now = C.before(x, now)
            low = min(now)
            assert t.vectors[left[v]] == tuple(c - low for c in now) and cost[v] == low
            for q in range(4):
                assert t.trace(s, v, q)[1] == leave[v][q]


def test_empty_table_and_all_dropped(spark):
    assert C.repair_digest(frame(spark, [])).count() == 0
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (r,) = C.repair_digest(frame(spark, [(conv, 0, "user", "x.")])).collect()
    assert tuple(r[c] for c in ["conv_id", *COLUMNS]) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
