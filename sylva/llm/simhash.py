"""Operator 4: SimHash near-duplicates found through vantage-point trees.

1. Fingerprints: every word shingle's XXH64 votes on 64 bits.
2. Equal fingerprints collapse to one node (the smallest id).
3. A vantage-point tree of as many levels as the number of nodes asks for deals
   nodes to shards: at each level the distance to the level's vantage point tells
   inside (<= radius) from outside. If two fingerprints within ``max_bits`` fall on
   different sides, the inner one lies in the outermost ``max_bits`` rings of the
   inside, by the triangle bound; such nodes go to both sides. Vantage points come
   from a hash of the tree path, so no tree is broadcast.
4. Each shard is searched by a local vantage-point tree and gives a spanning forest
   of its links. 5. Components by alternating stars, in written rounds.

Null text counts as empty: fingerprint zero, linked like any other. Rows with a null
doc_id take no part (they have no name to report). Repeated doc_ids are reported
once for each row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.session import materialize

SHARD_NODES = 2048  # aimed size of a shard; larger ones are only slower
LEAF = 1024
RADIUS = 31


def fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only; the six ASCII blanks
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, 42) for g in grams), dtype=np.uint64)
    bits = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 65536):  # bounded memory for very long texts
        bits += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, also: Sequence[str] = ()) -> DataFrame:
    """``doc_id, fp`` (fp: the 64 bits as a signed long), and further columns of type long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp.view(np.int64), **{c: b[c] for c in also}})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *also)
    return rows.filter("doc_id is not null").mapInPandas(run, ", ".join(["doc_id long, fp long", *(f"{c} long" for c in also)]))


def _vantage(path: np.ndarray) -> np.ndarray:
    """A pseudo-random vantage point for each tree path (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        z = path.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def route(fp: np.ndarray, levels: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row number, shard) pairs: a row's own shard and those whose border it overlaps."""
    row, path = np.arange(len(fp)), np.ones(len(fp), dtype=np.uint64)
    for _ in range(levels):
        d = np.bitwise_count(fp[row] ^ _vantage(path))
        inside, outside = d <= RADIUS, d > RADIUS - max_bits
        row = np.concatenate([row[inside], row[outside]])
        path = np.concatenate([path[inside] * np.uint64(2), path[outside] * np.uint64(2) + np.uint64(1)])
    return row, path.view(np.int64)


class _Forest:
    """Links of a shard, kept as a spanning forest."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.up[p] = q
                self.links.append((x, y))


def _search(fp: np.ndarray, at: np.ndarray, max_bits: int, forest: _Forest) -> None:
    """Links within ``at`` (positions in fp): a vantage-point tree over the shard's own points."""
    todo = [at]
    while todo:
        at = todo.pop()
        n, x = len(at), fp[at]
        cut = None
        if n > LEAF:
            far = np.bitwise_count(x ^ x[0])
            for v in (int(np.argmax(far)), 0, n // 2):
                d = np.bitwise_count(x ^ x[v])
                r = int(np.median(d))
                inside, outside = d <= r, d > r - max_bits
                if max(inside.sum(), outside.sum()) < 0.9 * n:
                    cut = (at[inside], at[outside])
                    break
        if cut:
            todo += cut
            continue
        # a leaf, or a ball too tight for the triangle bound: exact, block by block
        step = max(1, (1 << 20) // max(1, n))
        for k in range(0, n, step):
            d = np.bitwise_count(x[k : k + step, None] ^ x[None, k:])
            i, j = np.nonzero(d <= max_bits)
            later = j > i
            forest.add(at[k + i[later]], at[k + j[later]])


def links(nodes: DataFrame, max_bits: int = 2, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """``a, b``: links that connect all of ``nodes`` (node, fp; fp distinct) within max_bits."""
    n = nodes.count()
    shrink = 0.5 + 0.05 * max_bits  # share of a node's rows that either side gets
    levels = max(0, min(60, math.ceil(math.log(max(1, n) / shard_nodes) / -math.log(shrink)))) if n > shard_nodes else 0

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row, shard = route(b["fp"].to_numpy(np.int64).view(np.uint64), levels, max_bits)
            yield pd.DataFrame({"shard": shard, "node": b["node"].to_numpy(np.int64)[row], "fp": b["fp"].to_numpy(np.int64)[row]})

    def search(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("fp")
        fp, node = b["fp"].to_numpy(np.int64).view(np.uint64), b["node"].to_numpy(np.int64)
        forest = _Forest(len(fp))
        _search(fp, np.arange(len(fp)), max_bits, forest)
        e = np.array(forest.links, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": np.minimum(node[e[:, 0]], node[e[:, 1]]), "b": np.maximum(node[e[:, 0]], node[e[:, 1]])})

    dealt = nodes.select("node", "fp").mapInPandas(deal, "shard long, node long, fp long")
    return dealt.groupBy("shard").applyInPandas(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node in ``edges`` (a, b).

    Alternating large-star and small-star rounds; each round is written to the shared
    folder. The join that spreads the minima has both sides freshly shuffled, so a
    node with very many links is split by the adaptive skew join.
    """
    edges = materialize(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc")
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.filter("a <> b").distinct(), "cc")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "cc")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        edges = materialize(small.filter("a <> b").distinct(), "cc")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, also: Sequence[str] = ()) -> DataFrame:
    """``doc_id, fp, component_id`` for every row with an id, and further columns of type long."""
    fps = materialize(fingerprints(docs, shingle, also), "simhash")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash")
    comp = components(links(nodes, max_bits))
    named = nodes.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(materialize(named, "simhash"), "fp", "left").select("doc_id", "fp", "component_id", *also)


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` that head their group (smallest doc_id). Rows that share an id are
    judged by their text, each with its own group; equal rows of an id go or stay together. Rows without an
    id stay."""
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))  # tells the texts of one id apart
    found = near_duplicates(docs.select("doc_id", "text", mark.alias("mark")), shingle, max_bits, ["mark"])
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"), F.col("mark").alias("_mark")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["_gone"]) & (mark == gone["_mark"]), "left_anti")
