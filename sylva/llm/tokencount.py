"""Operator 1: token counts by heap-and-linked-list byte-pair merging.

The vocabulary file (tokenizers JSON, BPE with a word-end suffix) gives merges,
added tokens and pre-tokenizer pattern. A text's count is the sum over its words
of initial symbols minus merges; identifiers are never produced.

Null and empty texts count 0 tokens; repeated rows are counted row by row; the
whole text is always read.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import texts

CACHE_WORDS = 400_000  # words remembered by a Python worker; the memory's bound, never a limit of the counts


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + spare)
            spare += 1
    return out


class MergeCounter(dict):
    """word -> number of tokens; computed on first use."""

    def __init__(self, spec: dict):
        super().__init__()
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): r for r, (a, b) in enumerate(pairs)}
        self.symbols = _byte_symbols()
        # oniguruma's \s under Unicode is White_Space
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}")).findall
        added = [a["content"] for a in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = self[word] = self._tokens(word)
        return n

    def _tokens(self, word: str) -> int:
        sym = [self.symbols[b] for b in word.encode()]
        sym[-1] += self.suffix
        n = len(sym)
        ranks = self.ranks
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            r, i = heapq.heappop(heap)
            left, j = sym[i], after[i]
            if left is None or j >= n or ranks.get((left, sym[j])) != r:
                continue  # one of the pair has been merged since
            sym[i] = new = left + sym[j]
            sym[j] = None
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (r := ranks.get((new, sym[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((sym[h], new))) is not None:
                heapq.heappush(heap, (r, h))
        return n - merges

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower-casing goes character by character: no final sigma
                text = text.replace("Σ", "σ")
        return text.lower()

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or "<" not in text:
            return sum(map(self.__getitem__, self.words(self.normal(text))))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.words(self.normal(p)))) for p in parts)


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One counter for each vocabulary and Python worker."""
    if path not in _COUNTERS:
        with open(path, encoding="utf-8") as f:
            _COUNTERS[path] = MergeCounter(json.load(f))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row. ``vocabulary`` is a
    path that every executor has (it comes with a Python package)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(vocabulary)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": [c.count(t) for t in b["text"]]})

    rows = texts(docs).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    out = rows.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
