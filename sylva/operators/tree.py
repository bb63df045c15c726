"""A tree as nested sets: each row's place in pre-order and the size of its subtree.

Rows are range-sorted into pre-order once. In that order the rows below a
directory follow it, up to the next row that isn't deeper, so counts below a
row, whether anything tracked lies below it or its parent, and whether it is a
last child are differences of running sums at two places. No row is joined
with another.

Two passes stream the sorted partitions. Forward (while sorting): each row's
place and the tracked rows before it in its partition. Backward: a stack of the
next rows that aren't deeper. What a partition must know of others (a few rows
for each partition, as many as the tree is deep) goes through the driver like
the bounds of a range partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions import paths as P
from sylva.session import materialize

ROW, ABOVE, NEXT, HEAD = range(4)  # kinds of rows; of a partition's the later ones are read first

_SORTED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("at", pa.int64()), ("depth", pa.int32()), ("before", pa.int64()), ("above", pa.int64()),
                     ("path", pa.string()), ("is_dir", pa.bool_()), ("tracked", pa.bool_()), ("write_path", pa.string())])
_DDL = ("part int, kind int, at long, depth int, before long, above long, path string, is_dir boolean, tracked boolean, write_path string")
_OUT = pa.schema([("path", pa.string()), ("is_dir", pa.bool_()), ("tracked", pa.bool_()), ("write_path", pa.string()), ("depth", pa.int64()), ("pre", pa.int64()),
                  ("n_below", pa.int64()), ("n_tracked_below", pa.int64()), ("is_last", pa.bool_()), ("parent_has", pa.bool_())])


def order_key(path: str, search_path: str):
    """A string that sorts as pre-order with siblings in folded order (raw names among equals). No name holds its
    separator, which sorts before every character."""
    rel = P.relative_to(path, F.lit(search_path))
    return F.array_join(F.transform(F.split(rel, "/"), lambda x: F.concat(P.fold(x), F.lit("\u0000"), x)), "\u0000")


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition's rows with their place, the tracked rows before them, and those up to their parent (if it is in
    the partition); then the partition's own facts."""
    n = tracked = 0
    above: dict[int, int] = {}  # depth -> tracked rows up to and with the last row of that depth
    lows: list[tuple[int, int, int]] = []  # rows less deep than all before: depth, place, tracked before
    part = None
    for b in batches:
        if not b.num_rows:
            continue
        part = b.column("part")[0].as_py()
        depth, marked = b.column("depth").to_pylist(), b.column("tracked").to_pylist()
        at, before, up = list(range(n, n + len(depth))), [], []
        for i, (d, t) in enumerate(zip(depth, marked)):
            before.append(tracked)
            up.append(above.get(d - 1))
            if not lows or d < lows[-1][0]:
                lows.append((d, n + i, tracked))
            tracked += t
            above[d] = tracked
        n += len(depth)
        yield pa.RecordBatch.from_arrays([b.column("part"), pa.array([ROW] * len(depth), pa.int32()), pa.array(at), b.column("depth"), pa.array(before),
                                          pa.array(up, pa.int64()), *(b.column(c) for c in ("path", "is_dir", "tracked", "write_path"))], schema=_SORTED)
    if part is None:
        return
    facts = [(part, HEAD, n, None, tracked, None)] + [(part, NEXT, i, d, t, None) for d, i, t in lows] + [(part, ABOVE, 0, d, t, None) for d, t in above.items()]
    cols = [*zip(*facts), *([None] * len(facts) for _ in range(4))]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SORTED)], schema=_SORTED)


def _carried(facts: list) -> list[tuple]:
    """For each partition what the backward pass must know first, from all partitions' facts."""
    by: dict[int, list] = {}
    for r in facts:
        by.setdefault(r["part"], []).append(r)
    out, start, marked = [], {}, {}
    n = tracked = 0
    above: dict[int, int] = {}
    for p in sorted(by):
        start[p], marked[p] = n, tracked
        out += [(p, ABOVE, 0, d, t, None) for d, t in above.items()]
        for r in by[p]:
            if r["kind"] == ABOVE:
                above[r["depth"]] = tracked + r["before"]
        for r in by[p]:
            if r["kind"] == HEAD:
                n, tracked = n + r["at"], tracked + r["before"]
    stack: list[tuple[int, int, int]] = [(0, n, tracked)]  # the end lies less deep than every row
    for p in sorted(by, reverse=True):
        out.append((p, HEAD, start[p], None, marked[p], None))
        out += [(p, NEXT, i, d, t, None) for d, i, t in stack]
        lows = sorted((r["depth"], start[p] + r["at"], marked[p] + r["before"]) for r in by[p] if r["kind"] == NEXT)
        stack = [s for s in stack if s[0] < lows[0][0]] + lows if lows else stack
    return out


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their intervals; each partition's rows come from its last to its first, after what is carried into it."""
    part, start, marked = None, 0, 0
    above: dict[int, int] = {}
    stack: list[tuple[int, int, int]] = []
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("part", "kind", "at", "depth", "before", "above", "tracked")]
        rows, keep = [], []
        for i, (p, kind, at, d, before, up, own) in enumerate(zip(*cols)):
            if p != part:
                part, above, stack = p, {}, []
            if kind == HEAD:
                start, marked = at, before
            elif kind == NEXT:
                stack.append((d, at, before))
                stack.sort()
            elif kind == ABOVE:
                above[d] = before
            else:
                while stack[-1][0] > d:
                    stack.pop()
                top = stack[-1]
                last = top[0] < d
                end = top if last else stack[-2]  # where the parent's subtree ends
                pre, mine = start + at, marked + before
                up = marked + up if up is not None else above.get(d - 1)
                rows.append((d, pre, top[1] - pre - 1, top[2] - mine - own, last, d == 1 or up is None or end[2] > up))
                keep.append(i)
                if not last:
                    stack.pop()
                stack.append((d, pre, mine))
        kept = b.take(pa.array(keep, pa.int64()))
        found = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("path", "is_dir", "tracked", "write_path")), *(pa.array(c, f.type) for c, f in zip(found, list(_OUT)[4:]))], schema=_OUT)


def nested_sets(rows: DataFrame, search_path: str) -> DataFrame:
    """``rows`` (``path, is_dir, tracked, write_path``; every directory listed) below ``search_path`` with ``depth`` (1: its
    children), ``pre`` (place in pre-order, from 0), ``n_below`` and ``n_tracked_below`` (rows below), ``is_last`` (of its siblings)
    and ``parent_has`` (something tracked lies below its parent, or that is the search path)."""
    spark = rows.sparkSession
    below = rows.where(P.is_below("path", search_path))
    base = F.size(P.parts(F.lit(search_path)))
    keyed = below.select("path", "is_dir", "tracked", "write_path", (F.size(P.parts("path")) - base).cast("int").alias("depth"), order_key("path", search_path).alias("_key"))
    placed = keyed.repartitionByRange("_key").sortWithinPartitions("_key").select(
        F.spark_partition_id().alias("part"), "depth", "path", "is_dir", "tracked", "write_path").mapInArrow(_forward, _DDL)
    table = materialize(placed, "tree")
    facts = table.where(F.col("kind") != ROW).select("part", "kind", "at", "depth", "before").collect()
    carried = spark.createDataFrame([(*r, None, None, None, None) for r in _carried(facts)], _DDL)
    both = table.where(F.col("kind") == ROW).unionByName(carried)
    return both.repartition("part").sortWithinPartitions("part", F.col("kind").desc(), F.col("at").desc()).mapInArrow(
        _backward, "path string, is_dir boolean, tracked boolean, write_path string, depth long, pre long, n_below long, n_tracked_below long, "
                   "is_last boolean, parent_has boolean")
