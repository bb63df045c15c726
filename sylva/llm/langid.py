"""Operator 5: language of mixed-language texts.

Each word's script ranges narrow the languages it may be in; a word then scores by the
relative frequency of its n-grams (whole short words and character 1- to 4-grams with
word borders) in each language's training texts; Viterbi over the words, with a penalty
for switching, labels spans; the language with most letters wins, and its share of the
text's posterior is the score.

Null texts and texts without a letter are ``und`` with score 0. With no training row
everything is ``und``. The classifier is fitted on a bounded sample (``sample_rows`` of each
language, about, drawn by a hash of the id); n-grams go by a 64-bit hash, and the model
keeps those seen at least ``least`` times, at most ``most`` of them, so what is sent to
the executors is bounded. Ties go to the language that sorts first.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import fold
from sylva.session import materialize

SWITCH = 6.0  # log-odds that a change of language must win
SMOOTH = 0.5
LEAST, MOST = 3, 120_000
SAMPLE_ROWS = 5_000  # training rows of each language, about
SHARES = 1 << 40  # steps of a hash
KNOWN_WORDS, KNOWN_CHARS = 200_000, 8 << 20  # words remembered by a Python worker; only the memory's bound
GROUP = 1 << 20  # characters of texts worked at once, about
ASCII_WORDS = re.compile("[a-z]+").findall
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall  # a letter, with the marks and letters after it


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return ASCII_WORDS(text) if text.isascii() else WORDS(text)


# fixed values: first and last code point of scripts
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "indic": ((0x900, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "han": ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
_RANGES = sorted((a, b, s) for s, spans in SCRIPTS.items() for a, b in spans)


def script(word: str) -> str:
    """The script of a word's first character that has one."""
    for c in map(ord, word):
        for a, b, s in _RANGES:
            if a <= c <= b:
                return s
    return "other"


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words' n-grams with their borders (and of whole words of 3 to 12 letters), and
    the number of the word that each comes from."""
    text = " " + "  ".join(words) + " "
    code = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    size = np.array(list(map(len, words)), dtype=np.int64) + 2
    owner = np.repeat(np.arange(len(words)), size)
    first = np.cumsum(size) - size
    left = np.repeat(first + size, size) - np.arange(len(code))  # characters up to the word's last border
    mixed = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    keys, owners, rolling = [], [], np.zeros(len(code), dtype=np.uint64)
    for n in range(4):
        rolling = rolling[: len(code) - n] * np.uint64(0xBF58476D1CE4E5B9) + mixed[n:]
        ok = left[: len(rolling)] > n
        keys.append(rolling[ok])
        owners.append(owner[: len(rolling)][ok])
    short = np.flatnonzero((size > 4) & (size <= 14))
    if len(short):
        place = np.arange(len(code)) - np.repeat(first, size)
        power = np.cumprod(np.full(int(size.max()), 0x94D049BB133111EB, dtype=np.uint64))
        keys.append((np.add.reduceat(mixed * power[place], first))[short] ^ np.uint64(0x5555))
        owners.append(short)
    key = np.concatenate(keys)
    return (key ^ (key >> np.uint64(31))).view(np.int64), np.concatenate(owners)


class Model:
    """log-probabilities of n-grams by language, and the languages of each script. ``keys``: the n-grams' hashes, ascending."""

    def __init__(self, langs: list[str], keys: np.ndarray, logs: np.ndarray, scripts: dict[str, np.ndarray]):
        self.langs, self.keys, self.logs, self.scripts = langs, keys, logs, scripts
        self.known: dict[str, int] = {}
        self.held = 0  # their characters
        self.rows = np.zeros((0, len(langs)))

    def learn_words(self, words: list[str]) -> None:
        """Scores of words not seen before, in parts of bounded size."""
        part, size = [], 0
        for w in words:
            part.append(w)
            size += len(w)
            if size > 250_000:
                self._score(part)
                part, size = [], 0
        if part:
            self._score(part)

    def _score(self, words: list[str]) -> None:
        k = len(self.langs)
        score, hits = np.zeros((len(words), k)), np.zeros(len(words))
        if len(self.keys):
            key, owner = grams(words)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            at, owner = at[hit], owner[hit]
            hits = np.bincount(owner, minlength=len(words)).astype(float)
            for j in range(k):
                score[:, j] = np.bincount(owner, weights=self.logs[at, j], minlength=len(words))
        score /= np.sqrt(np.maximum(1.0, hits))[:, None]
        kinds = list(map(script, words))
        for kind, allowed in self.scripts.items():
            if not allowed.all() and (rows := [i for i, x in enumerate(kinds) if x == kind]):
                score[rows] = np.where(allowed, score[rows], score[rows].min(1, keepdims=True) - 50.0)
        self.held += sum(map(len, words))
        self.known.update(zip(words, range(len(self.rows), len(self.rows) + len(words))))
        self.rows = np.concatenate([self.rows, score - score.max(1, keepdims=True)])

    def spans(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For each text the language and letters of each word, and the sum of word scores by language."""
        if len(self.known) > KNOWN_WORDS or self.held > KNOWN_CHARS:
            self.known.clear()
            self.held = 0
            self.rows = self.rows[:0]
        words = [words_of(t) if self.langs else [] for t in texts]
        self.learn_words(sorted(set().union(*words) - self.known.keys()))
        find = self.known.__getitem__
        ids = [np.fromiter(map(find, ws), np.int64, len(ws)) for ws in words]
        sizes = [np.fromiter(map(len, ws), np.int64, len(ws)) for ws in words]
        k = len(self.langs)
        total = np.array([self.rows[i].sum(0) if len(i) else np.zeros(k) for i in ids]).reshape(len(texts), k)
        order = sorted(range(len(texts)), key=lambda i: -len(ids[i]))
        paths: list[np.ndarray] = [np.empty(0, np.int16)] * len(texts)
        at = 0
        while at < len(order) and len(ids[order[at]]):  # texts of like length go through together, in bounded memory
            longest = len(ids[order[at]])
            group = order[at : at + max(1, 1_000_000 // longest)]
            at += len(group)
            for i, p in zip(group, self._viterbi([ids[i] for i in group])):
                paths[i] = p
        return paths, sizes, total

    def _viterbi(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """ids: longest first."""
        n, longest, k = len(ids), len(ids[0]), len(self.langs)
        length = np.array(list(map(len, ids)))
        grid = np.zeros((longest, n), dtype=np.int64)
        for j, x in enumerate(ids):
            grid[: len(x), j] = x
        live = n - np.searchsorted(length[::-1], np.arange(longest), side="right")  # texts that still have a word there
        back = np.empty((longest, n, k), dtype=np.int16)
        best = self.rows[grid[0]].copy()
        own = np.arange(k, dtype=np.int16)
        for t in range(1, longest):
            m = live[t]
            v = best[:m]
            top = v.argmax(1)
            switch = v[np.arange(m), top][:, None] - SWITCH
            stay = v >= switch
            back[t, :m] = np.where(stay, own, top[:, None])
            best[:m] = np.where(stay, v, switch) + self.rows[grid[t, :m]]
        out = []
        last = best.argmax(1)
        state = last.copy()
        paths = np.empty((longest, n), dtype=np.int16)
        for t in range(longest - 1, -1, -1):
            m = live[t]
            paths[t, :m] = state[:m]
            if t:
                state[:m] = back[t, np.arange(m), state[:m]]
        for j in range(n):
            out.append(paths[: length[j], j])
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """(language, score, number of spans) of each text."""
        paths, sizes, total = self.spans(texts)
        out = []
        for p, s, sums in zip(paths, sizes, total):
            if not len(p) or not len(self.langs):
                out.append(("und", 0.0, 0))
                continue
            letters = np.bincount(p, weights=s, minlength=len(self.langs))
            best = int(letters.argmax())
            share = letters[best] / letters.sum()
            per = np.exp(np.clip((sums - sums.max()) / np.sqrt(len(p)), -50, 0))
            out.append((self.langs[best], float(min(1.0, 0.5 * share + 0.5 * per[best] / per.sum())), 1 + int((np.diff(p) != 0).sum())))
        return out


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def train(docs: DataFrame, least: int = LEAST, most: int = MOST, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from training rows (crc32 of the id modulo 3 is not 1; lang and text not null): about ``sample_rows``
    of each language, by a hash of the id, or all where there are fewer. Counts are summed in each task first."""
    rows = _rows(docs).filter(fold("doc_id", 3) != 1).filter("lang is not null")
    have = {r["lang"]: r["n"] for r in rows.filter("text is not null").groupBy("lang").count().withColumnRenamed("count", "n").collect()}
    share = F.lit(0)
    for lang, n in sorted(have.items()):
        share = F.when(F.col("lang") == lang, math.ceil(SHARES * min(1.0, sample_rows / n))).otherwise(share)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)) < share).filter("text is not null").select("lang", "text")

    def sums(words: dict[str, Counter]) -> Iterator[pd.DataFrame]:
        for lang, seen in words.items():
            names, n = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
            kinds = pd.Series(n).groupby(pd.Series(list(map(script, names)))).sum()
            yield pd.DataFrame({"lang": lang, "script": kinds.index, "gram": 0, "n": kinds.to_numpy()})
            for at in range(0, len(names), 100_000):
                key, owner = grams(names[at : at + 100_000])
                own, place = np.unique(key, return_inverse=True)
                total = np.bincount(place, weights=n[at + owner]).astype(np.int64)
                yield pd.DataFrame({"lang": lang, "script": None, "gram": own, "n": total})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                words.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, words.values())) > KNOWN_WORDS:
                yield from sums({x: c for x, c in words.items() if c})
                words = {}
        yield from sums({x: c for x, c in words.items() if c})

    by = sample.mapInPandas(count, "lang string, script string, gram long, n long").groupBy("lang", "script", "gram").agg(F.sum("n").alias("n"))
    by = materialize(by, "language_grams")
    seen = by.filter("script is null").groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("n"))
    kept = sorted(seen.filter(F.col("n") >= least).orderBy(F.desc("n"), "gram").limit(most).collect(), key=lambda r: r["gram"])
    langs = sorted(have)
    at = {x: i for i, x in enumerate(langs)}
    table = np.zeros((len(kept), len(langs)))
    for i, r in enumerate(kept):
        for x, n in r["by"].items():
            table[i, at[x]] = n
    logs = np.log((table + SMOOTH) / (table.sum(0) + SMOOTH * max(1, len(kept))))
    used: dict[str, np.ndarray] = {}
    for r in by.filter("script is not null").collect():
        used.setdefault(r["script"], np.zeros(len(langs)))[at[r["lang"]]] = r["n"]
    letters = np.maximum(1, sum(used.values(), np.zeros(len(langs))))
    scripts = {s: n / letters >= 1e-3 if (n / letters >= 1e-3).any() else n >= 0 for s, n in used.items()}
    keys = np.array([r["gram"] for r in kept], dtype=np.int64)
    return Model(langs, keys, logs - logs.mean(1, keepdims=True) if langs else logs, scripts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, n_spans`` of every row, from its text alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, group, size = [], [], 0
            for t in b["text"]:
                group.append(t)
                size += len(t or "")
                if size >= GROUP:
                    found += model.predict(group)
                    group, size = [], 0
            found += model.predict(group)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "n_spans": [x[2] for x in found]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", fold("doc_id", 3) == 1)
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double, n_spans long")
