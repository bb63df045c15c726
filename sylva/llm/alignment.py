"""Operator 11: alignment of two tokenizers by token-byte incidence matrices.

A text (a blank put first) is encoded by a byte-level BPE (A) and by a SentencePiece model
(B). Each tokenizer's tokens are rows of an incidence matrix over the text's bytes, held as
compressed sparse rows (``Csr``). Gustavson row products give the links: A times B transposed
holds the bytes that two tokens share (overlap links), and the product of the two
token-group incidences, where groups end at the bytes at which an A and a B token both end,
holds the pairs in one group (shared-group links).

Texts are cut at single blanks between plain characters. Neither tokenizer has a token
across such a cut (A's words start there; B's pieces hold the marker only in front), so the
products are made once for each distinct part and remembered by worker (bounded by number and
bytes). A document's links are one more product: documents by parts, times parts by id pairs.

An id pair counts the documents that hold it linked. Documents are worked in blocks of about
``BLOCK_BYTES`` of text; a block emits each of its pairs once with its number of documents, so
what is shuffled grows with blocks times their distinct pairs. The counts come back to the
blocks by a join on the pair, and meet the block's documents in one group of that bounded size.

Null and empty texts, and texts that either tokenizer doesn't give back byte for byte, have
no tokens: zeros, and '' for the digest. Repeated rows are documents of their own; null ids stay
null; an empty table gives an empty result; further columns of any name are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from sylva.llm.common import texts
from sylva.llm.tokencount import _byte_symbols
from sylva.session import materialize

BLOCK_BYTES = 2 << 20  # text of a block, about
KNOWN_PARTS, KNOWN_BYTES = 200_000, 64 << 20  # parts remembered by a Python worker; only the memory's bound
PRODUCT = 1 << 20  # entries of a product expanded at once
LINE_PARTS = 64  # parts encoded by one call
MARK = "▁"
# a blank between plain characters: visible ASCII, or Latin letters beyond it
CUT = re.compile(" (?<=[!-~À-ÖØ-öø-ɏ] )(?=[!-~À-ÖØ-öø-ɏ])")


@dataclass
class Csr:
    """A sparse matrix: row i has ``data`` at the columns ``cols[at[i]:at[i + 1]]``."""

    at: np.ndarray
    cols: np.ndarray
    data: np.ndarray
    width: int

    @classmethod
    def of(cls, rows: np.ndarray, cols: np.ndarray, data: np.ndarray, height: int, width: int) -> Csr:
        """From entries in any order; equal places add up."""
        key = rows.astype(np.int64) * width + cols
        if len(key) > 1 and not (key[1:] >= key[:-1]).all():
            room = 62 - int(max(height, 1) * max(width, 1)).bit_length()
            if room > 0 and int(data.max()) >> room == 0:  # place and value in one number: a plain sort
                both = np.sort(key << room | data.astype(np.int64))
                key, data = both >> room, both & ((1 << room) - 1)
            else:
                order = np.argsort(key, kind="stable")
                key, data = key[order], data[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        data = np.add.reduceat(data.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        key = key[first]
        return cls(np.searchsorted(key, np.arange(height + 1, dtype=np.int64) * width), key % max(width, 1), data, width)

    @property
    def height(self) -> int:
        return len(self.at) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.height), np.diff(self.at))

    def transposed(self) -> Csr:
        return Csr.of(self.cols, self.rows(), self.data, self.width, self.height)

    def times(self, other: Csr) -> Csr:
        """Gustavson's product: each row is the sum of the other's rows that its columns name, some rows at once so
        that about ``PRODUCT`` entries are expanded at a time."""
        sizes = np.diff(other.at)[self.cols]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        row_ends = ends[self.at]
        out, lo = [], 0
        while lo < self.height:
            hi = max(lo + 1, int(np.searchsorted(row_ends, row_ends[lo] + PRODUCT, "right")) - 1)
            i, j = self.at[lo], self.at[hi]
            n = sizes[i:j]
            take = np.arange(ends[j] - ends[i]) - np.repeat(ends[i:j] - ends[i], n) + np.repeat(other.at[self.cols[i:j]], n)
            rows = np.repeat(np.repeat(np.arange(hi - lo), np.diff(self.at[lo : hi + 1])), n)
            out.append(Csr.of(rows, other.cols[take], other.data[take] * np.repeat(self.data[i:j], n), hi - lo, other.width))
            lo = hi
        if not out:
            return Csr(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), other.width)
        starts = np.cumsum([0, *(len(m.cols) for m in out)])
        at = np.concatenate([[0], *(m.at[1:] + s for m, s in zip(out, starts))])
        return Csr(at, np.concatenate([m.cols for m in out]), np.concatenate([m.data for m in out]), other.width)


def incidence(ends: np.ndarray, n_bytes: int) -> Csr:
    """Tokens by bytes, for tokens that follow each other and end at ``ends``."""
    return Csr(np.concatenate([[0], ends]), np.arange(n_bytes), np.ones(n_bytes, np.int64), n_bytes)


def group_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Groups end where a token of either tokenizer does."""
    return np.intersect1d(ends_a, ends_b, assume_unique=True)


def overlap_links(ends_a: np.ndarray, ends_b: np.ndarray) -> Csr:
    """A's tokens by B's tokens: the bytes that they share."""
    n = int(ends_a[-1]) if len(ends_a) else 0
    return incidence(ends_a, n).times(incidence(ends_b, n).transposed())


def group_links(group_a: np.ndarray, rows_a: np.ndarray, n_a: int, group_b: np.ndarray, rows_b: np.ndarray, n_b: int, n_groups: int) -> Csr:
    """Rows of A by rows of B: the pairs of occurrences in one group. Rows are tokens, or ids (which count their tokens)."""
    a = Csr.of(rows_a, group_a, np.ones(len(rows_a)), n_a, n_groups)
    b = Csr.of(rows_b, group_b, np.ones(len(rows_b)), n_b, n_groups)
    return a.times(b.transposed())


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids end to end, and the number of each one's list."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(sizes.sum())), np.repeat(np.arange(len(ids)), sizes)


class Pair:
    """The two tokenizers with their tokens' bytes."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte = {c: i for i, c in enumerate(_byte_symbols())}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in names]
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
        self.size_a, self.size_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.by_part = not any(MARK in self.b.id_to_piece(i).lstrip(MARK) for i in range(self.b.get_piece_size()) if not self.b.is_byte(i))
        self.written = [f"{i}{end}" for n, ends in ((len(self.size_a), ",|"), (len(self.size_b), ",;")) for end in ends for i in range(n)]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}  # part -> row of the tables below
        self.n = np.zeros((0, 4), np.int64)  # tokens of A and B, groups, overlap links
        self.said: list[str | None] = []  # groups as text; None where a tokenizer doesn't give the part back
        self.links = Csr(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 1)  # parts by id pairs
        self.held = 0
        self.hits = np.zeros(0, np.int64)  # texts' parts met, by part

    def forget_rare(self) -> None:
        """Keep the parts met more than once, if they leave room."""
        keep = np.flatnonzero(self.hits > 1)
        share = len(keep) / max(len(self.hits), 1)
        if share > 0.5:
            self.forget()
            return
        kept = set(keep.tolist())
        parts = [p for p, i in self.number.items() if i in kept]  # in order of number
        cols, data, ends = self._take(keep)
        self.number = dict(zip(parts, range(len(parts))))
        self.n, self.said = self.n[keep], [self.said[i] for i in keep.tolist()]
        self.links, self.held, self.hits = Csr(ends, cols, data, 1), int(self.held * share), np.zeros(len(keep), np.int64)

    def _take(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Some parts' rows of links: columns, values and where each row ends."""
        sizes = self.links.at[parts + 1] - self.links.at[parts]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        take = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes) + np.repeat(self.links.at[parts], sizes)
        return self.links.cols[take], self.links.data[take], ends

    def parts(self, text: str) -> list[str]:
        """The text with a blank first, cut where neither tokenizer has a token across."""
        if not self.by_part:
            return [" " + text]
        return [" " + x for x in CUT.split(text)]

    def learn(self, parts: list[str], per_line: int = LINE_PARTS) -> None:
        """Encode new parts and add their rows, one product for all of them."""
        plain = [p for p in parts if CUT.search("." + p[:2]) and CUT.search(p[-1] + " .")]
        lines = [plain[k : k + per_line] for k in range(0, len(plain), per_line)] + [[p] for p in sorted(set(parts).difference(plain))]
        lines, ids_a, ids_b = self._encode(lines)
        parts = [p for line in lines for p in line]
        flat_a, flat_b = (np.fromiter(itertools.chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])  # parts end to end
        held = np.repeat([len(x) > 0 for x in ids_a], [len(line) for line in lines]) if lines else np.zeros(0, bool)
        part_ends = np.cumsum(np.array([len(p.encode()) for p in parts]) * held)
        part_a, part_b = (np.searchsorted(part_ends, ends) for ends in (ends_a, ends_b))
        cuts = group_ends(ends_a, ends_b)
        if not np.isin(part_ends[held], cuts).all() and len(lines) < len(parts):
            self.learn(parts, 1)  # a token lies across two parts of a line
            return
        group_a, group_b = (np.searchsorted(cuts, ends) for ends in (ends_a, ends_b))
        part = np.zeros(len(cuts), np.int64)
        part[group_a] = part_a
        over = np.bincount(part_a, np.diff(overlap_links(ends_a, ends_b).at), len(parts)).astype(np.int64) if len(flat_a) else np.zeros(len(parts), np.int64)
        self.n = np.concatenate([self.n, np.stack([np.bincount(part_a, minlength=len(parts)), np.bincount(part_b, minlength=len(parts)), np.bincount(part, minlength=len(parts)), over], 1)])
        # ids within a part are the rows, so that a large group's pairs are as many as its distinct ids need
        (names_a, rows_a), (names_b, rows_b) = (np.unique(p << 32 | f, return_inverse=True) for p, f in ((part_a, flat_a), (part_b, flat_b)))
        found = group_links(group_a, rows_a, len(names_a), group_b, rows_b, len(names_b), len(cuts))
        a = names_a[found.rows()]
        keys = (a & 0xFFFFFFFF) << 32 | (names_b[found.cols] & 0xFFFFFFFF)
        sizes = np.bincount(a >> 32, minlength=len(parts))
        self.links = Csr(np.concatenate([self.links.at, self.links.at[-1] + np.cumsum(sizes)]), np.concatenate([self.links.cols, keys]), np.concatenate([self.links.data, found.data]), 1)
        # each token's id and what follows it: , in a group, | after a group's A tokens, ; after a group
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        n = len(self.size_a), len(self.size_b)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        names = np.concatenate([flat_a + n[0] * last_a, flat_b + n[1] * last_b + 2 * n[0]])[order]
        both = list(map(self.written.__getitem__, names.tolist()))
        bounds = np.concatenate([[0], np.cumsum(np.bincount(part_a, minlength=len(parts)) + np.bincount(part_b, minlength=len(parts)))]).tolist()
        first = len(self.said)
        self.said += ["".join(both[i:j])[:-1] if i < j else None for i, j in zip(bounds, bounds[1:])]
        self.number.update(zip(parts, range(first, first + len(parts))))
        self.held += 200 * len(parts) + 4 * sum(map(len, parts)) + 12 * len(both) + 24 * len(keys)

    def _encode(self, lines: list[list[str]]) -> tuple[list[list[str]], list[list[int]], list[list[int]]]:
        """Lines of parts with their ids, without any where a tokenizer doesn't give a line back. Parts of longer
        lines that aren't given back are encoded alone."""
        said = ["".join(line) for line in lines]
        ids_a = [e.ids for e in self.a.encode_batch_fast(said, add_special_tokens=False)]
        ids_b = self.b.encode([t[1:] for t in said], num_threads=1)
        again = []
        for k, (line, raw) in enumerate(zip(lines, map(str.encode, said))):
            given = all(b"".join(map(of.__getitem__, ids)) == raw for of, ids in ((self.bytes_a, ids_a[k]), (self.bytes_b, ids_b[k])))
            if not given:
                ids_a[k], ids_b[k] = [], []
                if len(line) > 1:
                    again += [[p] for p in line]
                    lines[k] = []
        if again:
            more = self._encode(again)
            return [*lines, *more[0]], [*ids_a, *more[1]], [*ids_b, *more[2]]
        return lines, ids_a, ids_b

    def align(self, batch: list[str]) -> list[tuple]:
        """(tokens of A, of B, groups, overlap links, digest, id pairs, their links) of each text."""
        if len(self.number) > KNOWN_PARTS or self.held > KNOWN_BYTES:
            self.forget_rare()
        cut = [self.parts(t) if t else [] for t in batch]
        fresh = sorted(set().union(*cut) - self.number.keys()) if cut else []
        lo = 0
        while lo < len(fresh):  # about a megabyte of new parts at a time
            hi, size = lo, 0
            while hi < len(fresh) and size < 1 << 20:
                size += len(fresh[hi])
                hi += 1
            self.learn(fresh[lo:hi])
            lo = hi
        get = self.number.__getitem__
        at = [list(map(get, x)) for x in cut]
        lossy = {i for i, x in enumerate(self.said) if x is None}
        lost = {k: " " + batch[k] for k, x in enumerate(at) if not lossy.isdisjoint(x)} if lossy else {}
        if lost:  # a part isn't given back: the whole text's bytes decide
            self.learn(sorted(set(lost.values()) - self.number.keys()))
            for k, whole in lost.items():
                i = get(whole)
                at[k] = [] if self.said[i] is None else [i]
        flat, rows = _flat(at)
        self.hits = np.bincount(flat, minlength=len(self.said)) + np.pad(self.hits, (0, len(self.said) - len(self.hits)))
        totals = np.stack([np.bincount(rows, self.n[flat, c], len(at)) for c in range(4)], 1).astype(np.int64).tolist() if len(flat) else [[0] * 4] * len(at)
        links = self._links(rows, flat, len(at))
        out, said = [], self.said.__getitem__
        for k, x in enumerate(at):
            digest = hashlib.sha256(";".join(map(said, x)).encode()).hexdigest() if x else ""
            i, j = links.at[k], links.at[k + 1]
            out.append((*totals[k], digest, links.cols[i:j], links.data[i:j]))
        return out

    def _links(self, rows: np.ndarray, parts: np.ndarray, n: int) -> Csr:
        """Documents by id pairs: documents by parts, times parts by pairs (renumbered, so that places fit a long)."""
        if not len(parts):
            return Csr(np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 1)
        used, where = np.unique(parts, return_inverse=True)
        cols, data, ends = self._take(used)
        keys, cols = np.unique(cols, return_inverse=True)
        by_part = Csr(ends, cols, data, len(keys))
        out = Csr.of(rows, where, np.ones(len(rows)), n, len(used)).times(by_part)
        return Csr(out.at, keys[out.cols], out.data, 1)


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(path_a: str, path_b: str) -> Pair:
    """The two tokenizers, once for each Python worker."""
    if (path_a, path_b) not in _PAIRS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks have the cores
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def _groups(batch: list[str | None]) -> Iterator[list[int]]:
    group, size = [], 0
    for i, t in enumerate(batch):
        group.append(i)
        size += len(t or "")
        if size >= BLOCK_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


COUNTS = ["n_a", "n_b", "n_groups", "n_overlaps"]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document: its block, counts and digest, and its links as numbers of the block's pairs
    (``pair``) with their occurrences (``links``). One more row for each block (``doc`` null) has
    the pairs (``key``: the two ids) and the block's documents that hold each (``links``)."""
    kept = pa.schema([("block", pa.int64()), ("doc", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("groups_sha256", pa.string()),
                      ("pair", pa.list_(pa.int32())), ("links", pa.list_(pa.int64())), ("key", pa.list_(pa.int64()))])

    def lists(parts: list[np.ndarray], kind: str) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, parts)]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, block = pair(path_a, path_b), TaskContext.get().partitionId() << 32
        for b in batches:
            doc_id, text = b.column("doc_id").to_pylist(), b.column("text")
            for g in _groups(text.to_pylist()):
                rows = p.align([text[i].as_py() or "" for i in g])
                keys, where, n_docs = np.unique(np.concatenate([r[5] for r in rows]), return_inverse=True, return_counts=True)
                cuts = np.cumsum([0, *(len(r[5]) for r in rows)])
                no = np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * (len(g) + 1)), pa.array([*range(len(g)), None], pa.int64()), pa.array([*(doc_id[i] for i in g), None], pa.int64()),
                    *(pa.array([*(r[c] for r in rows), None], pa.int64()) for c in range(4)), pa.array([*(r[4] for r in rows), None], pa.string()),
                    lists([*(where[i:j] for i, j in zip(cuts, cuts[1:])), no], "int32"), lists([*(r[6] for r in rows), n_docs], "int64"),
                    lists([*[no] * len(g), keys], "int64")], schema=kept)
                block += 1

    return texts(docs).mapInArrow(run, f"block long, doc long, doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, "
                                       "pair array<int>, links array<long>, key array<long>")


def id_pairs(rows: DataFrame) -> DataFrame:
    """``key, n_docs, is_best``: the documents that hold each id pair linked, and whether no pair of the same
    A id has more. The window's groups are bounded by B's vocabulary."""
    counted = (rows.where("doc IS NULL").select(F.inline(F.arrays_zip(F.col("key"), F.col("links").alias("n"))))
               .groupBy("key").agg(F.sum("n").alias("n_docs")))
    best = F.max("n_docs").over(Window.partitionBy(F.shiftright("key", 32)))
    return counted.select("key", "n_docs", (F.col("n_docs") == best).alias("is_best"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps`` of every row."""
    rows = materialize(aligned(docs, path_a, path_b), "aligned")
    wanted = rows.where("doc IS NULL").select(F.col("block").alias("in_block"), F.posexplode("key").alias("pair", "key"))
    counts = wanted.join(id_pairs(rows), "key").select("in_block", "pair", "n_docs", "is_best")
    kept = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string()), ("n_overlaps", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = np.zeros(right.num_rows, np.int64)
        best = np.zeros(right.num_rows, bool)
        at = right["pair"].to_numpy()
        n[at], best[at] = right["n_docs"].to_numpy(), right["is_best"].to_numpy(zero_copy_only=False)
        left = left.combine_chunks()
        pairs, links = (left[c].combine_chunks() for c in ("pair", "links"))
        sizes = pairs.value_lengths().to_numpy(zero_copy_only=False)
        ends, p, k = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), pairs.flatten().to_numpy(), links.flatten().to_numpy()

        def total(x: np.ndarray) -> pa.Array:
            return pa.array(np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[ends]))

        return pa.Table.from_arrays([left["doc_id"], left["n_a"], left["n_b"], left["n_groups"], total(k), total(k * best[p]), total(k * n[p]),
                                     left["groups_sha256"], left["n_overlaps"]], schema=kept)

    each = rows.where("doc IS NOT NULL").select("block", "doc_id", *COUNTS, "groups_sha256", "pair", "links")
    return each.groupBy("block").cogroup(counts.groupBy("in_block")).applyInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_overlaps long")
