"""Operator 7: likelihood of texts over all segmentations into subwords.

A public vocabulary's pieces and scores are taken as they are: scores of a unigram model
are its log-probabilities; those of a rank-ordered vocabulary (no probabilities) become
Zipf weights by rank. These weights are the prior of re-estimations on the distinct
training tokens, by expected piece counts (forward-backward over each one's lattice). A token's probability is
the marginal over all its segmentations, by a forward recursion; tokens of the training
documents are pieces too, whole, with all the mass but what Good-Turing leaves to
unseen tokens. One more arc, with a fixed share of the mass, leads through the text's own
earlier tokens (their frequency so far). A text's probability is the product over its
tokens and the end. A base model (smoothed token counts) comes along.

How it runs: blocks of input are tokenised once, into numbers and each block's distinct
tokens with their counts; the counts are summed over the corpus in a shuffle by token,
every distinct token's lattice is scored once, and each block gets its own tokens back.
No token's row list is ever gathered: a token has one row for each block.

Null texts are empty (one token, the end). Repeated rows and ids are scored row by row.
Empty training data leaves the prior weights, N = 0 and V = 0.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import fold, texts
from sylva.llm.sentencepiece_codec import BYTE, MARK, NORMAL, UNIGRAM, USER, parse
from sylva.session import materialize

ALPHA = 0.1
BLOCK_TEXT = 16 << 20  # characters of a block of documents, about
OWN = 0.15  # share of a document's own earlier tokens
PRIOR_WEIGHT = 1000.0  # pieces' worth of the vocabulary's own weights
ROUNDS = 1
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_CODED = ["block", "doc_id", "held_out", "ids", "token", "id", "c"]
_UPPER = {i: i + 32 for i in range(65, 91)}
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def tokens(text: str | None) -> list[str]:
    return _WORDS((text or "").translate(_UPPER))


class Vocabulary:
    """Pieces with a weight; the blank marker stands for the start of a token."""

    def __init__(self, path: str):
        m = parse(path)
        real = [(p.piece, p.score) for p in m.pieces if p.type in (NORMAL, USER) and MARK not in p.piece[1:]]
        if m.trainer_spec.model_type != UNIGRAM:
            order = sorted(range(len(real)), key=lambda i: (-real[i][1], i))
            rank = np.empty(len(real))
            rank[order] = np.arange(len(real))
            score = -np.log(rank + 10.0)
        else:
            score = np.array([s for _, s in real])
        keep = [i for i, (p, _) in enumerate(real) if p]
        self.pieces = [real[i][0] for i in keep]
        self.longest = max(map(len, self.pieces), default=0)
        weight = np.exp(score[keep])
        self.n_bytes = sum(p.type == BYTE for p in m.pieces) or 256
        # the end and each byte of a character without a piece have a small weight of their own
        weight = np.concatenate([weight, [weight.mean()], np.full(1, weight.min())])
        total = weight[:-1].sum() + self.n_bytes * weight[-1]
        self.prior = weight / total  # pieces, the end, one byte
        codes = [np.frombuffer(p.encode("utf-32-le"), "<u4") for p in self.pieces]
        keys = np.array([_hash_one(c) for c in codes], dtype=np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.single = np.array(sorted(int(c[0]) for c in codes if len(c) == 1), dtype=np.uint32)
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Piece number of each substring key, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        at = np.flatnonzero(self.filter[(keys >> np.uint64(44)).astype(np.int64)])
        spot = np.searchsorted(self.keys, keys[at])
        spot[spot == len(self.keys)] = 0
        hit = self.keys[spot] == keys[at]
        out[at[hit]] = self.order[spot[hit]]
        return out


def _hash_one(codes: np.ndarray) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in codes:
        h = _step(h, np.array([c], dtype=np.uint64))
    return _mix(h)[0]


def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h ^ (c + np.uint64(1))) * _P1


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _P2
    return h ^ (h >> np.uint64(29))


class Lattice:
    """Segmentations of many words of one length at a time."""

    def __init__(self, vocabulary: Vocabulary, logp: np.ndarray):
        self.v, self.logp = vocabulary, logp

    def run(self, words: list[str], weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """log-probability of each word, and with ``weight`` the expected counts (pieces, end, byte)."""
        out = np.zeros(len(words))
        expected = np.zeros(len(self.logp)) if weight is not None else None
        lengths = np.array([len(w) + 1 for w in words])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            for s in range(0, len(at), max(1, 400_000 // int(n))):
                part = at[s : s + max(1, 400_000 // int(n))]
                codes = np.frombuffer("".join(MARK + words[i] for i in part).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n).astype(np.uint64)
                out[part] = self._same_length(codes, None if weight is None else weight[part], expected)
        return out, expected

    def _same_length(self, codes: np.ndarray, weight: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
        rows, n = codes.shape
        arcs = []  # (start, end, rows, pieces, log-probability)
        byte = len(self.logp) - 1
        width = 1 + (codes > 0x7F) + (codes > 0x7FF).astype(int) + (codes > 0xFFFF).astype(int)
        alone = ~np.isin(codes.astype(np.uint32), self.v.single)
        for i in range(n):
            h = np.zeros(rows, np.uint64)
            for j in range(i, min(n, i + self.v.longest)):
                h = _step(h, codes[:, j])
                piece = self.v.lookup(_mix(h))
                at = np.flatnonzero(piece >= 0)
                if len(at):
                    arcs.append((i, j + 1, at, piece[at], self.logp[piece[at]]))
            at = np.flatnonzero(alone[:, i])
            if len(at):
                arcs.append((i, i + 1, at, None, width[at, i] * self.logp[byte]))
        f = np.full((n + 1, rows), -np.inf)
        f[0] = 0
        for i, j, at, _, lp in arcs:  # by start: all arcs into a place come before those out of it
            f[j, at] = np.logaddexp(f[j, at], f[i, at] + lp)
        if expected is not None:
            b = np.full((n + 1, rows), -np.inf)
            b[n] = 0
            for i, j, at, _, lp in reversed(arcs):
                b[i, at] = np.logaddexp(b[i, at], b[j, at] + lp)
            for i, j, at, piece, lp in arcs:
                share = np.exp(f[i, at] + lp + b[j, at] - f[n, at]) * weight[at]
                if piece is None:
                    expected[byte] += (share * width[at, i]).sum()
                else:
                    expected += np.bincount(piece, weights=share, minlength=len(expected))
        return f[n]


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _blocks(texts: list[str | None]) -> Iterator[list[int]]:
    group, size = [], 0
    for i, t in enumerate(texts):
        group.append(i)
        size += len(t or "")
        if size >= BLOCK_TEXT:
            yield group
            group, size = [], 0
    if group:
        yield group


def coded(rows: DataFrame) -> DataFrame:
    """Blocks of documents as numbers, tokenised once. A row for each document (``block, doc_id, held_out, ids``:
    its tokens' numbers in the block, 32 bits each) and one for each distinct token of a block (``block, token, id,
    c``: how often training documents hold it)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = 0
        for b in batches:
            texts, held = b["text"].tolist(), b["held_out"].to_numpy(bool)
            for g in _blocks(texts):
                ids: defaultdict = defaultdict(count().__next__)
                codes = [np.fromiter(map(ids.__getitem__, tokens(texts[i])), np.int32) for i in g]
                trained = [x for i, x in zip(g, codes) if not held[i]]
                c = np.bincount(np.concatenate(trained), minlength=len(ids)) if trained else np.zeros(len(ids), dtype=np.int64)
                x = b.iloc[g]
                block = x["part"].to_numpy() * (1 << 24) + number
                yield pd.DataFrame({"block": block, "doc_id": x["doc_id"].to_numpy(), "held_out": held[g], "ids": [x.tobytes() for x in codes], "token": None, "id": None, "c": None}, columns=_CODED)
                if ids:
                    yield pd.DataFrame({"block": block[0], "doc_id": None, "held_out": None, "ids": None, "token": list(ids), "id": np.arange(len(ids), dtype=np.int32), "c": c}, columns=_CODED)
                number += 1

    # a document's block is its input partition and a running number in it
    parts = rows.withColumn("part", F.spark_partition_id().cast("long"))
    return parts.mapInPandas(run, "block long, doc_id long, held_out boolean, ids binary, token string, id int, c long")


def reestimated(counts: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities (pieces, end, a byte) after some re-estimations on the distinct training tokens (the subword
    arcs are for unseen tokens, which resemble distinct ones); each task sends a vector of the vocabulary's size."""
    v = vocabulary(path)
    size, p = len(v.prior), v.prior
    for _ in range(rounds):
        logp = np.log(p)

        def expect(batches: Iterator[pd.DataFrame], logp=logp) -> Iterator[pd.DataFrame]:
            lattice, total = Lattice(vocabulary(path), logp), np.zeros(size)
            for b in batches:
                total += lattice.run(b["token"].tolist(), np.ones(len(b)))[1]
            at = np.flatnonzero(total)
            yield pd.DataFrame({"piece": at, "n": total[at]})

        sums = counts.filter("c > 0").mapInPandas(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # at most a row for each piece
        total = PRIOR_WEIGHT * v.prior
        total[sums["piece"].to_numpy(dtype=np.int64)] += sums["n"].to_numpy()
        p = total / (total[:-1].sum() + v.n_bytes * total[-1])
    return p


def _earlier(doc: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token: how many of its document come before it, and how many of these are the same token."""
    n = np.arange(len(ids))
    order = np.argsort((doc.astype(np.int64) << 32) | ids, kind="stable")
    d, t = doc[order], ids[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
    same = np.empty(len(ids), dtype=np.int64)
    same[order] = n - np.maximum.accumulate(np.where(new, n, 0))
    first = np.ones(len(ids), dtype=bool)
    first[1:] = doc[1:] != doc[:-1]
    return n - np.maximum.accumulate(np.where(first, n, 0)), same


def likelihoods(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    rows = texts(docs).withColumn("held_out", fold("doc_id", 10) == 0)
    blocks = materialize(coded(rows), "lattice")
    in_block = blocks.filter("token is not null")
    counts = materialize(in_block.groupBy("token").agg(F.sum("c").alias("c")), "lattice")
    n, v, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.count(F.when(F.col("c") == 1, 1))).first()
    ends = blocks.filter("token is null and not held_out").count()
    n, v = n + ends, v + (ends > 0)
    logp = np.log(reestimated(counts, path))
    unseen = (once + 1) / (n + 2)  # mass of the subword arcs

    def marginal(c, lp):
        """log of whole-token arc plus subword segmentations."""
        return np.logaddexp(np.log(unseen) + lp, np.log(np.maximum((1 - unseen) * c / max(1, n), 1e-300)))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(vocabulary(path), logp)
        for b in batches:
            yield b.assign(lp=marginal(b["c"].to_numpy(float), lattice.run(b["token"].tolist())[0]))

    priced = counts.mapInPandas(scored, "token string, c long, lp double")
    used = in_block.select("block", "id", "token").join(priced, "token").select("block", "id", "c", "lp")
    per = n + ALPHA * (v + 1)

    def base(c):
        return np.log10((c + ALPHA) / per)

    end_base, end_p, end_known = float(base(ends)), math.exp(marginal(float(ends), logp[-2])), int(ends > 0)

    def score(d: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        codes = [np.frombuffer(x, np.int32) for x in d["ids"]]
        size = np.array([len(x) for x in codes], dtype=np.int64)
        ids, doc = np.concatenate(codes), np.repeat(np.arange(len(codes)), size)
        c, p = np.zeros(len(w), dtype=np.int64), np.zeros(len(w))
        at = w["id"].to_numpy(np.int64)
        c[at], p[at] = w["c"].to_numpy(), np.exp(w["lp"].to_numpy())
        place, same = _earlier(doc, ids)
        own = np.where(place > 0, OWN, 0.0)
        lp = np.log10((1 - own) * p[ids] + own * same / np.maximum(1, place))

        def total(x: np.ndarray) -> np.ndarray:
            return np.bincount(doc, weights=x, minlength=len(codes))

        return pd.DataFrame({
            "doc_id": d["doc_id"].astype("Int64"), "held_out": d["held_out"].astype(bool), "n_tokens": size + 1,
            "n_known": total(c[ids] > 0).astype(np.int64) + end_known, "base_score": total(base(c)[ids]) + end_base,
            "score": total(lp) + np.log10(end_p * np.where(size > 0, 1 - OWN, 1.0))})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    in_docs = blocks.filter("token is null").select(F.col("block").alias("of"), "doc_id", "held_out", "ids")
    joined = in_docs.groupBy("of").cogroup(used.groupBy("block")).applyInPandas(score, schema)
    return joined.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
