"""Operator 9: nearest neighbours over shifted Hilbert curves.

Several random projections of the unit vectors, each shifted, are ordered along a Hilbert
curve. Spark range-partitions each ordering; a row's rank along a curve gives its place.
Queries are dealt by chunks of ranks. A chunk's task holds its queries and streams the
rows from ``window`` ranks before it to ``window`` ranks after it past them, keeping each query's best
k (inner product of the original vectors, double precision, summed in one order, so that equal
vectors tie). The lists of the curves are merged: k rows for each query and curve.

The window is fitted, not fixed: a bounded sample of queries is answered exactly, and the
window is the rank distance within which the wanted share of their true neighbours lies
on some curve. On vectors without structure that is a large part of the table; recall stays.

Vectors that are null, zero or hold null or non-finite components, or whose length is
not the table's most common one, take no part; rows with a null id neither. Rows of equal
id are distinct candidates (a query never gets its own row), and distinct queries. Ties go to
the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sylva.session import materialize

CURVES = 4
DIMS, BITS = 8, 7  # of a curve's key: 56 bits
BLOCK = 1024  # rows scored at once
CHUNK = 40_960  # ranks whose queries share a task
SAMPLE = 256  # queries answered exactly to fit the window
TARGET = 0.95  # share of their neighbours that the window must hold


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of integer cells: undo the excess rotations from the
    highest bit down, take the Gray code, then interleave."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray, curves: int = CURVES) -> np.ndarray:
    """[curves, rows] keys; projections and shifts follow from the curve's number."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    width = unit.shape[1]
    out = []
    for c in range(curves):
        rng = np.random.default_rng(1000 + c)
        base = np.linalg.qr(rng.standard_normal((width, width)))[0][:, : min(DIMS, width)]
        shift = rng.uniform(-0.5, 0.5, base.shape[1])
        spread = (unit @ base) * np.sqrt(width) + shift  # a few units wide whatever the width
        cells = np.clip((spread + 4.5) / 9 * (1 << BITS), 0, (1 << BITS) - 1)
        out.append(hilbert_keys(cells, BITS))
    return np.array(out)


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def usable(rows: DataFrame) -> DataFrame:
    """``row, vec_id, v`` (array<double>) of the rows that take part; ``row`` tells rows of equal id apart."""
    v = F.col("embedding").cast("array<double>")
    part = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    part = part.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).filter(F.exists("v", lambda x: x != 0))
    width = part.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return part.filter(F.size("v") == (width["width"] if width else 0))


def _ranked(points: DataFrame, curves: int) -> DataFrame:
    """``curve, rank, row, vec_id, v``: each point's place along each curve, from a range partitioning and
    the partitions' row counts; written before ranks are read."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                for c, k in enumerate(curve_keys(_stack(b["v"]), curves)):
                    yield pd.DataFrame({"curve": c, "key": k, "row": b["row"], "vec_id": b["vec_id"], "v": b["v"]})

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, int] = {}
        for b in batches:
            at = b.groupby("curve").cumcount() + b["curve"].map(lambda c: seen.get(c, 0))
            for c, n in b["curve"].value_counts().items():
                seen[c] = seen.get(c, 0) + int(n)
            yield b.assign(at=at)[["curve", "part", "at", "row", "vec_id", "v"]]

    keyed = points.mapInPandas(keys, "curve int, key long, row long, vec_id long, v array<double>")
    order = ["curve", "key", "vec_id", "row"]
    spread = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    rows = materialize(spread.mapInPandas(number, "curve int, part int, at long, row long, vec_id long, v array<double>"), "hilbert")
    counts = rows.groupBy("curve", "part").count()  # a row for each partition and curve
    before = F.coalesce(F.sum("count").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(counts.select("curve", "part", before.alias("before")), ["curve", "part"]).select("curve", (F.col("before") + F.col("at")).alias("rank"), "row", "vec_id", "v")


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher score first, smaller id among equals."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= edge)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return q @ x.T


def fitted_window(ranked: DataFrame, queries: DataFrame, n: int, k: int, target: float, sample: int) -> int:
    """Rank distance that holds ``target`` of the true neighbours of a sample of queries."""
    picked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id").distinct()
    mine = ranked.join(F.broadcast(picked), "vec_id").select("curve", "rank", "vec_id", "v").orderBy("vec_id", "curve").toPandas()  # at most sample x curves rows
    if mine.empty or n < 2:
        return 1
    one = mine[mine["curve"] == 0].drop_duplicates("vec_id")
    ids, qs = one["vec_id"].to_numpy(), _stack(one["v"])
    places = mine.drop_duplicates(["vec_id", "curve"]).pivot(index="vec_id", columns="curve", values="rank").loc[ids].to_numpy()

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            s, cand = _dots(qs, _stack(b["v"])), b["vec_id"].to_numpy()
            rows = []
            for i in range(len(ids)):
                s[i, cand == ids[i]] = -np.inf
                at = _top(s[i], cand, k)
                rows.append(pd.DataFrame({"q": i, "vec_id": cand[at], "score": s[i][at]}))
            held = pd.concat([held, *rows] if held is not None else rows)
            held = held.sort_values(["q", "score", "vec_id"], ascending=[True, False, True]).groupby("q").head(k)
        if held is not None:
            yield held

    near = ranked.filter("curve = 0").select("vec_id", "v").mapInPandas(best, "q int, vec_id long, score double")
    near = near.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id")), asc=False), 1, k).alias("x")).select("q", F.explode("x.vec_id").alias("vec_id")).distinct()
    at = ranked.select("curve", "rank", "vec_id").join(F.broadcast(near), "vec_id").toPandas()  # at most sample x k x curves rows
    if at.empty:
        return 1
    at["far"] = np.abs(at["rank"].to_numpy() - places[at["q"].to_numpy(), at["curve"].to_numpy()])
    nearest = at.groupby(["q", "vec_id"])["far"].min()
    return int(np.ceil(np.quantile(nearest, target, method="higher"))) + 1


def deal(ranked: DataFrame, queries: DataFrame, window: int, n: int, chunk: int) -> DataFrame:
    """``curve, chunk, asks, rank, row, vec_id, v``: the queries of each chunk of ranks, and every row within ``window`` of the chunk."""
    rank = F.col("rank")
    first, last = F.floor(F.greatest(rank - window, F.lit(0)) / chunk), F.floor(F.least(rank + window, F.lit(max(n - 1, 0))) / chunk)
    cols = ["curve", "chunk", "asks", "rank", "row", "vec_id", "v"]
    asked = queries.withColumn("chunk", F.floor(rank / chunk).cast("long")).withColumn("asks", F.lit(True)).select(*cols)
    wanted = asked.select("curve", "chunk").distinct()
    held = ranked.withColumn("chunk", F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumn("asks", F.lit(False))
    return held.join(wanted, ["curve", "chunk"], "left_semi").select(*cols).unionAll(asked)


class Nearest:
    """The k best rows so far of each of a chunk's queries."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.rows, self.vectors, self.k = ids, rows, vectors, k
        n = len(ids)
        self.size = np.linalg.norm(vectors, axis=1)
        self.edge = np.full(n, -np.inf)  # a candidate below it is out
        self.best = [np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64)]  # query, score, id, row

    def meet(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        # of equal vectors only the k + 1 smallest ids can be among a query's k nearest
        _, same = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((rows, ids, same.ravel()))
        group = same.ravel()[order]
        place = np.arange(len(order)) - np.searchsorted(group, group)
        keep = order[place <= self.k]
        ids, rows, vectors = ids[keep], rows[keep], vectors[keep]
        for lo in range(0, len(ids), BLOCK):
            self._block(ids[lo : lo + BLOCK], rows[lo : lo + BLOCK], vectors[lo : lo + BLOCK])

    def _block(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray) -> None:
        for a in range(0, len(self.ids), 2048):
            b = min(a + 2048, len(self.ids))
            scores = _dots(self.vectors[a:b], x)
            slack = 1e-9 * self.size[a:b, None] * np.linalg.norm(x, axis=1).max()  # products may differ in their last bits
            scores[self.rows[a:b, None] == rows[None, :]] = -np.inf
            edge = self.edge[a:b]
            if len(ids) > self.k:
                edge = np.maximum(edge, np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
            q, c = np.nonzero((scores >= edge[:, None] - slack) & (scores > -np.inf))
            for i in range(0, len(q), 1 << 16):
                at, to = q[i : i + (1 << 16)] + a, c[i : i + (1 << 16)]
                exact = (self.vectors[at] * x[to]).sum(1)
                self._add(at, exact, ids[to], rows[to])

    def _add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        new = [np.concatenate(p) for p in zip(self.best, (q, score, ids, rows))]
        order = np.lexsort((new[3], new[2], -new[1], new[0]))
        place = np.arange(len(order)) - np.searchsorted(new[0][order], new[0][order])
        order = order[place < self.k]
        self.best = [p[order] for p in new]
        full = np.flatnonzero(np.bincount(self.best[0], minlength=len(self.ids)) == self.k)
        last = np.searchsorted(self.best[0], full, "right") - 1
        self.edge[full] = self.best[1][last]


def search(rows: DataFrame, k: int = 20, every: int = 20, curves: int = CURVES, target: float = TARGET, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id ``every`` divides, its k nearest found among all others."""
    points = usable(rows)
    ranked = materialize(_ranked(points, curves), "hilbert")
    n = ranked.filter("curve = 0").count()
    queries = ranked.filter(F.col("vec_id") % every == 0)
    window = fitted_window(ranked, queries.filter("curve = 0"), n, k, target, sample)
    dealt = deal(ranked, queries, window, n, chunk)
    kept = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def result(near: Nearest) -> pa.RecordBatch:
        q, score, ids, to = near.best
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (near.rows[q], near.ids[q], to, ids, score)], schema=kept)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by curve and chunk, a chunk's queries first."""
        now, near, asked = None, None, []
        for b in batches:
            if not b.num_rows:
                continue
            curve, chunk, asks, row, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("curve", "chunk", "asks", "row", "vec_id"))
            v = b.column("v").flatten().to_numpy().reshape(len(ids), -1)
            cuts = np.flatnonzero((np.diff(curve) != 0) | (np.diff(chunk) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(ids)]):
                if (curve[i], chunk[i]) != now:
                    if near:
                        yield result(near)
                    now, near, asked = (curve[i], chunk[i]), None, []
                if asks[i]:
                    asked.append((ids[i:j], row[i:j], v[i:j]))
                else:
                    near = near or Nearest(*map(np.concatenate, zip(*asked)), k)
                    near.meet(ids[i:j], row[i:j], v[i:j])
        if near:
            yield result(near)

    order = ["curve", "chunk", F.col("asks").desc(), "rank"]
    found = dealt.repartition("curve", "chunk").sortWithinPartitions(*order).select("curve", "chunk", "asks", "row", "vec_id", "v").mapInArrow(
        answer, "query long, query_id long, row long, vec_id long, score double")
    # a row found on several curves has one score: it counts once
    best = found.groupBy("query", "query_id").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id", "row"))), 1, k).alias("x"))
    return best.select("query_id", F.posexplode("x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.s")).alias("score"))
