"""Operator 3: benchmark decontamination by the q-gram lemma.

Texts and benchmark items are normalised (lower case, ASCII punctuation to blanks, runs
of blanks to one) and compared as UTF-8 bytes. An item's pieces are its runs of PIECE bytes
from every byte on (a shorter item is one piece), so a quote of PIECE bytes or more is
found wherever it starts, with at most EDIT_SHARE edits in its best PIECE bytes. A
region of a text within k edits of a piece of length m shares at least m + 1 - q(k + 1) of
its q-grams, all on diagonals within k of the region's own. Shared q-grams are counted in
overlapping diagonal bands (of 2(2k + 1) diagonals, each second half shared), bands that
reach the bound are kept, and a banded alignment verifies them.

Null and empty texts match nothing; an item shorter than q bytes once normalised has no
q-gram and matches nothing; repeated rows are answered row by row. Benchmark items are a
stated query set: they go against all rows in blocks of at most ``block_bytes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import texts

Q = 12
PIECE = 96  # the least quote that is found, in bytes of normal text
EDIT_SHARE = 0.05
BLOCK_BYTES = 16 << 20
BITMAP_BITS = 22
_BLANK = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANK).split())


def grams(data: bytes) -> np.ndarray:
    """A 64-bit mix of each q-gram (two overlapping eight-byte words)."""
    n = len(data) - Q + 1
    if n < 1:
        return np.empty(0, np.uint64)
    word = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    with np.errstate(over="ignore"):
        h = (word[:n] * _M1) ^ (word[Q - 8 :][:n] * _M2)
        return h ^ (h >> np.uint64(29))


def within(pieces: np.ndarray, regions: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end in the region) of the best place of each line of ``pieces`` in its line of ``regions``,
    k + 1 for more than k edits: start and end in the region are free, cells off the band are skipped."""
    n, m = pieces.shape
    wide, big = regions.shape[1] - m + 1, k + 1
    alive, row = np.arange(n), np.zeros((wide, n), np.int16)
    edits, end = np.full(n, big), np.zeros(n, np.int64)
    for i in range(m):
        differs = regions[:, i : i + wide] != pieces[:, i : i + 1]
        new = row + differs.T
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        for d in range(1, wide):
            np.minimum(new[d], new[d - 1] + 1, out=new[d])
        row = new
        if i % 8 == 7:
            stay = row.min(0) < big
            if not stay.all():
                alive, row, pieces, regions = alive[stay], row[:, stay], pieces[stay], regions[stay]
                if not len(alive):
                    return edits, end
    best = row.argmin(0)
    edits[alive] = np.minimum(row[best, np.arange(len(alive))], big)
    end[alive] = best + m
    return edits, end


class Index:
    """q-grams of a block of benchmark items; each item's pieces start at every byte."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items: list[tuple[int, bytes, int, int, int]] = []  # item, bytes, piece length, k, bound
        keys, owner, offset = [], [], []
        for item, text in items:
            data = normal(text)
            m = min(len(data), PIECE)
            if m < Q:
                continue
            k = int(EDIT_SHARE * m)
            while m + 1 - Q * (k + 1) < 1:
                k -= 1
            g = grams(data)
            keys.append(g)
            owner.append(np.full(len(g), len(self.items)))
            offset.append(np.arange(len(g)))
            self.items.append((item, data, m, k, m + 1 - Q * (k + 1)))
        key = np.concatenate([*keys, np.empty(0, np.uint64)])
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.owner = np.concatenate([*owner, np.empty(0, int)]).astype(np.int64)[order]
        self.offset = np.concatenate([*offset, np.empty(0, int)]).astype(np.int64)[order]
        self.seen = np.zeros(1 << BITMAP_BITS, dtype=bool)
        self.seen[(self.key >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)] = True
        self.bounds = np.array([x[4] for x in self.items], np.int64)
        self.least = int(self.bounds.min(initial=1 << 30))

    @staticmethod
    def _exact(data: bytes, body: bytes, m: int, off: np.ndarray, pos: np.ndarray) -> tuple | None:
        """The first place of a whole piece without edits: a run of q-grams on one diagonal."""
        order = np.lexsort((off, pos - off))
        o, p = off[order], pos[order]
        edge = np.flatnonzero((np.diff(p - o) != 0) | (np.diff(o) != 1)) + 1
        first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(o)]])
        for i in sorted(first[last - first > m - Q], key=p.__getitem__):
            if data[p[i] : p[i] + m] == body[o[i] : o[i] + m]:
                return 0, int(p[i]), int(p[i]) + m
        return None

    @staticmethod
    def _edited(data: bytes, body: bytes, m: int, k: int, bound: int, off: np.ndarray, pos: np.ndarray) -> tuple | None:
        """The best region within k edits of a piece, over all bands and all starts of a piece that reach the bound."""
        half, best = 2 * k + 1, None
        band = (pos - off) // half
        both = np.unique(np.stack([np.concatenate([band, band - 1]), np.concatenate([off, off])]), axis=1)  # each band spans two halves, a q-gram counts once
        number, at, votes = np.unique(both[0], return_index=True, return_counts=True)
        width = 2 * half + 2 * k
        pad = np.full(m + width + k, 256, np.int16)  # no byte
        text = item = None
        for b, a, n in zip(number, at, votes):
            if n < bound:
                continue
            o = both[1, a : a + n]
            s = np.arange(max(0, o[0] - (m - Q)), min(len(body) - m, o[-1]) + 1)
            s = s[np.searchsorted(o, s + (m - Q), side="right") - np.searchsorted(o, s) >= bound]
            if text is None:
                text = np.concatenate([pad, np.frombuffer(data, np.uint8).astype(np.int16), pad])
                item = np.frombuffer(body, np.uint8).astype(np.int16)
            for c in range(0, len(s), 4096):
                start = s[c : c + 4096]
                low = start + int(b) * half - k  # the region's first byte
                regions = text[np.clip(low[:, None] + len(pad) + np.arange(m + width), 0, len(text) - 1)]
                edits, end = within(item[start[:, None] + np.arange(m)], regions, k)
                i = np.lexsort((low, edits))[0]
                hit = int(edits[i]), max(0, int(low[i])), min(len(data), int(low[i] + end[i]))
                if hit[0] <= k and (best is None or hit < best):
                    best = hit
        return best

    def find(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item, start, end, edits, piece bytes), the best region of each item; places in bytes of the normal text."""
        data = normal(text)
        g = grams(data)
        at = np.flatnonzero(self.seen[(g >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)])
        if len(at) < self.least:
            return []
        lo, hi = (np.searchsorted(self.key, g[at], side=s) for s in ("left", "right"))
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        if len(at) < self.least:
            return []
        post = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        owner, off, pos = self.owner[post], self.offset[post], np.repeat(at, n)
        many = np.bincount(owner, minlength=len(self.items))
        found = []
        for p in np.flatnonzero(many >= self.bounds):
            item, body, m, k, bound = self.items[p]
            mine = owner == p
            hit = self._exact(data, body, m, off[mine], pos[mine]) or self._edited(data, body, m, k, bound, off[mine], pos[mine])
            if hit:
                found.append((hit[0] / m, hit[1], item, hit[2], hit[0], m))
        best: dict[int, tuple] = {}
        for x in sorted(found):  # rows of one item id: the best of them
            best.setdefault(x[2], (x[2], x[1], x[3], x[4], x[5]))
        return [best[i] for i in sorted(best)]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark, block by block; a block's bytes are bounded on average by block_bytes."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + 2 * size // block_bytes
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r[0], r[1]) for r in part.orderBy("item_id", "text").toLocalIterator()]


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, start, end, edits, piece_bytes``: the best region of each item found in a row's text."""
    schema = "doc_id long, item_id long, start long, end long, edits long, piece_bytes long"
    rows, out = texts(docs), None
    for items in _blocks(benchmark, block_bytes):
        def scan(batches: Iterator[pd.DataFrame], items=items) -> Iterator[pd.DataFrame]:
            index = Index(items)
            for b in batches:
                hits = [(d, *h) for d, t in zip(b["doc_id"].tolist(), b["text"]) for h in index.find(t)]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id", "start", "end", "edits", "piece_bytes"])

        part = rows.filter("doc_id is not null and text is not null").mapInPandas(scan, schema)
        out = part if out is None else out.unionAll(part)
    return out


def _clean(items: list[tuple[int, str | None]]):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(items)
        for b in batches:
            yield pd.Series([not index.find(t) for t in b], dtype=bool)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows whose text holds no benchmark region (null texts stay); texts stay where they are, nothing is shuffled."""
    for items in _blocks(benchmark, block_bytes):
        docs = docs.filter(_clean(items)(F.col("text").cast("string")))
    return docs
