"""Greedy pairing of deletions with additions by modification time, distributed.

Files of one size may pair when their mtimes differ by less than the
tolerance. Additions are served in their order; each takes the first
deletion, in the deletions' order, that is free and close enough. The answer
depends on those orders, yet most of it is decided locally:

* Time is cut into *slabs* as wide as the tolerance, so rows of one slab are all
  close to each other, and only neighbouring slabs matter to a row. Slabs with
  a gap of the tolerance between them start a new *island*; islands can't
  interact. Slabs, not rows, are numbered: 2 ** ``SPAN_BITS`` slabs make a span, windows
  run inside a span and over spans, so no window holds more than a span's slabs
  or the spans of the whole time range.
* An island with rows of one kind pairs nothing.
* In an island shorter than the tolerance every deletion suits every addition:
  the k-th addition gets the k-th deletion, numbered skew-safely. A burst of
  any size is therefore sorted, not collected.
* Longer islands are cut into *blocks* of neighbouring slabs, of about
  ``block_rows`` rows, which also see two slabs on either side. A block runs the
  greedy loop over what it sees and keeps only what holds whatever happens
  outside (``decide``). What is left goes on to the next round, and every round
  is written. The first addition of an island is always decided, so the rounds
  end; there is no limit to their number (where names follow times, a block may
  have to wait for the one before it). A task holds a block's rows and those of
  one size in the four slabs around it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.operators.ranking import group_row_number
from sylva.session import materialize

SPAN_BITS = 12  # a span has 2 ** SPAN_BITS slabs
BLOCK_ROWS = 100_000  # rows of a block, about; the densest slabs it sees come on top
FREE, TAKEN, OPEN = 0, 1, 2


class _Least:
    """Least value of a range of places, where places can be removed (a segment tree)."""

    def __init__(self, values: np.ndarray):
        self.n = 1 << max(0, int(len(values) - 1).bit_length())
        self.none = len(values)
        tree = np.full(2 * self.n, self.none, np.int64)
        tree[self.n : self.n + len(values)] = values
        for level in range(self.n.bit_length() - 2, -1, -1):
            lo = 1 << level
            tree[lo : 2 * lo] = np.minimum(tree[2 * lo : 4 * lo : 2], tree[2 * lo + 1 : 4 * lo : 2])
        self.tree = tree.tolist()

    def remove(self, i: int) -> None:
        i += self.n
        self.tree[i] = self.none
        while i > 1:
            i >>= 1
            low = min(self.tree[2 * i], self.tree[2 * i + 1])
            if self.tree[i] == low:
                break
            self.tree[i] = low

    def least(self, lo: int, hi: int) -> int:
        """Least value at places lo..hi-1 (``none`` where there is none)."""
        out, tree = self.none, self.tree
        lo += self.n
        hi += self.n
        while lo < hi:
            if lo & 1:
                out = min(out, tree[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                out = min(out, tree[hi])
            lo >>= 1
            hi >>= 1
        return out


def decide(add_t: np.ndarray, add_whole: np.ndarray, del_t: np.ndarray, del_whole: np.ndarray,
           tolerance: int) -> tuple[np.ndarray, np.ndarray]:
    """What the greedy loop does to additions whatever happens to rows not seen here.

    Additions and deletions come in their orders. ``del_whole``: all additions
    close to the deletion are here; ``add_whole``: all deletions close to the
    addition are here and whole. Gives each addition's state (FREE: nothing is
    left for it; TAKEN: paired; OPEN) and its deletion.

    A deletion is *loose* if it isn't whole, or once an addition that isn't
    decided may take it. An addition whose first free deletion isn't loose takes
    it. One whose first is loose, or that isn't whole, stays open: it takes
    something up to its first deletion that isn't loose, which becomes loose too.
    """
    n = len(del_t)
    state, partner = np.full(len(add_t), FREE, np.int8), np.full(len(add_t), n, np.int64)
    by_time = np.argsort(del_t, kind="stable")
    place = np.empty(n, np.int64)
    place[by_time] = np.arange(n)
    place = place.tolist()
    free, firm = _Least(by_time), _Least(np.where(del_whole[by_time], by_time, n))
    times = del_t[by_time]
    lo = np.searchsorted(times, add_t - tolerance, "right").tolist()
    hi = np.searchsorted(times, add_t + tolerance, "left").tolist()
    for i, whole in enumerate(add_whole.tolist()):
        d, f = free.least(lo[i], hi[i]), firm.least(lo[i], hi[i])
        if whole and d == n:
            continue
        if whole and d == f:
            state[i], partner[i] = TAKEN, d
            free.remove(place[d])
            firm.remove(place[d])
        else:
            state[i] = OPEN
            if f != n:
                firm.remove(place[f])
    return state, partner


DECIDED = pa.schema([("change", pa.string()), ("dest_path", pa.string()), ("pair", pa.string())])


def _decide_block(rows: pa.Table, tolerance: int) -> pa.Table:
    """``change, dest_path, pair`` of a block's decided rows; ``pair`` is the addition's path, null for an addition
    that nothing is left for."""

    def side(kind: str, margin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = rows.filter(pc.equal(rows["change"], kind)).sort_by([("key", "ascending"), ("dest_path", "ascending")])
        slab, lo, hi = (t[c].to_numpy() for c in ("slab", "lo", "hi"))
        return np.array(t["dest_path"].to_pylist(), object), t["t"].to_numpy(), (slab >= lo - margin) & (slab <= hi + margin)

    (new, add_t, own), (old, del_t, whole) = side("add", 0), side("delete", 1)
    state, partner = decide(add_t, own, del_t, whole, tolerance)
    paired, alone = new[state == TAKEN].tolist(), new[state == FREE].tolist()
    gone = old[partner[state == TAKEN]].tolist()
    return pa.Table.from_arrays([pa.array(["add"] * len(paired) + ["delete"] * len(gone) + ["add"] * len(alone), pa.string()),
                                 pa.array([*paired, *gone, *alone], pa.string()),
                                 pa.array([*paired, *paired, *[None] * len(alone)], pa.string())], schema=DECIDED)


def slabs(rows: DataFrame, tolerance_us: int, block_rows: int) -> DataFrame:
    """``size, slab`` with their island, how long it is and its kinds of rows, and the block (``block``, ``lo``, ``hi``: its
    first and last slab). Counts by slab are combined before they are shuffled; the windows
    hold at most a span's slabs of one size, or one row for each span of the time range."""
    one = rows.groupBy("size", "slab").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("n"),
                                           F.max(F.col("change") == "add").alias("adds"), F.max(F.col("change") == "delete").alias("dels"))
    w = Window.partitionBy("size", "span").orderBy("slab")
    one = one.withColumn("span", F.shiftright("slab", SPAN_BITS)).select(
        "*", F.coalesce((F.col("t0") - F.lag("t1").over(w) >= tolerance_us).cast("int"), F.lit(0)).alias("starts"),
        F.floor((F.sum("n").over(w) - F.col("n")) / block_rows).alias("part"))
    one = one.withColumn("inner", F.sum("starts").over(w))
    spans = one.groupBy("size", "span").agg(F.min("t0").alias("s0"), F.max("t1").alias("s1"), F.sum("starts").alias("k"))
    ws = Window.partitionBy("size").orderBy("span")
    first = F.coalesce((F.col("s0") - F.lag("s1").over(ws) >= tolerance_us).cast("int"), F.lit(1))
    spans = spans.withColumn("first", first).select("size", "span", (F.sum(F.col("first") + F.col("k")).over(ws) - F.col("k")).alias("base"))
    one = one.join(spans, ["size", "span"]).withColumn("island", F.col("base") + F.col("inner"))
    by_island = one.groupBy("size", "island").agg((F.max("t1") - F.min("t0")).alias("long"), F.max("adds").alias("adds"), F.max("dels").alias("dels"))
    by_block = one.groupBy("size", "span", "part").agg(F.min("slab").alias("lo"), F.max("slab").alias("hi"))
    return (one.select("size", "slab", "span", "part", "island").join(by_island, ["size", "island"])
               .join(by_block, ["size", "span", "part"]))


def pair_keys(rows: DataFrame, order_key: Column, tolerance_us: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` (file additions and deletions of known size and mtime) with ``_pair``, equal for the two rows of a
    pair and different for all others. ``order_key`` orders each side."""
    tol = int(tolerance_us)
    rows = rows.withColumn("t", F.unix_micros("mtime")).withColumn("slab", F.expr(f"(t - pmod(t, {tol}L)) div {tol}L"))
    table = slabs(rows, tol, block_rows)
    placed = rows.join(table, ["size", "slab"]).withColumn("_key", order_key)
    placed = materialize(placed.withColumn("way", F.when(~(F.col("adds") & F.col("dels")), F.lit("none")).when(F.col("long") < tol, F.lit("burst"))
                                                   .otherwise(F.lit("chain"))), "islands")
    cols = [c for c in rows.columns if c not in ("t", "slab")]
    own = F.struct(F.col("change").alias("a"), F.lit("").alias("b"), F.col("dest_path").alias("c"))
    none = placed.where("way = 'none'").select(*cols, own.alias("_pair"))
    burst = group_row_number(placed.where("way = 'burst'").select(*cols, "island", "_key"), ["size", "island", "change"], ["_key", "dest_path"], "rn")
    burst = burst.select(*cols, F.struct(F.col("size").cast("string").alias("a"), F.col("island").cast("string").alias("b"), F.col("rn").cast("string").alias("c")).alias("_pair"))
    chain = placed.where("way = 'chain'")
    decided = chain_pairs(chain, tol)
    marked = chain.select(*cols).join(decided, ["change", "dest_path"], "left").select(
        *cols, F.when(F.col("pair").isNotNull(), F.struct(F.lit("pair").alias("a"), F.lit("").alias("b"), F.col("pair").alias("c"))).otherwise(own).alias("_pair"))
    return none.unionByName(burst).unionByName(marked)


def chain_pairs(chain: DataFrame, tolerance: int) -> DataFrame:
    """``change, dest_path, pair`` of the paired rows of long islands. A row of slab s is sent to every block that
    has a slab in s-2..s+2."""
    block = F.struct("size", "span", "part", "lo", "hi")
    near = (chain.select("size", "slab", block.alias("b")).distinct()
                 .select("size", F.explode(F.sequence(F.col("slab") - 2, F.col("slab") + 2)).alias("slab"), "b")
                 .groupBy("size", "slab").agg(F.collect_set("b").alias("blocks")))
    left = materialize(chain.select("change", "dest_path", "size", "slab", "t", F.col("_key").alias("key")).join(near, ["size", "slab"]), "chain")
    empty = left.select("change", "dest_path", F.lit(None).cast("string").alias("pair")).limit(0)
    found, rounds = empty, 0
    while not left.where("change = 'add'").isEmpty():
        seen = left.select("change", "dest_path", "slab", "t", "key", F.explode("blocks").alias("b")).select(
            "change", "dest_path", "slab", "t", "key", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"),
            F.struct("b.size", "b.span", "b.part").alias("block"))
        # two blocks may both decide a row near their border, and then alike
        done = materialize(seen.groupBy("block").applyInArrow(lambda block: _decide_block(block, tolerance), "change string, dest_path string, pair string")
                               .groupBy("change", "dest_path").agg(F.max("pair").alias("pair")), "decided")
        rounds += 1
        found = found.unionByName(done.where("pair IS NOT NULL"))
        if rounds % 16 == 0:
            found = materialize(found, "decided")  # keeps the plan of many rounds small
        left = materialize(left.join(done.select("change", "dest_path"), ["change", "dest_path"], "left_anti"), "chain")
    return found
