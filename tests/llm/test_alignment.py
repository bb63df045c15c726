"""Cross-tokenizer alignment against a plain version that encodes whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sylva.llm import alignment
from sylva.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, block long, pair string, key string, n_docs string"
A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
EDGE = [None, "", " ", "  ", "a", "a a a", " a  b ", "é 日本語 👍🏽 ﬀ", "▁ x", "a ▁b c", "a\x00b", "x" * 3000, "word " * 3000, "a<|endoftext|>b <|endoftext|>", "<s> </s> <unk>", "<0x41> b",
        "foo\n bar \n\n  baz\t\tq  ", "a\x85 b\x1c c　d", "don't 12's I'll", "ÿ Ā ɏ ɐ x", "µ ª º × ÷ x"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)


def byte_table():
    from sylva.llm.tokencount import _byte_symbols

    return {c: i for i, c in enumerate(_byte_symbols())}


def plain(texts):
    a, b, table = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_table()
    a.encode_special_tokens = True
    docs = []
    for t in texts:
        ids_a = ids_b = []
        if t:
            ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            said_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
            said_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(said_a) != (" " + t).encode() or b"".join(said_b) != (" " + t).encode():
                ids_a = ids_b = []
        groups = []
        if ids_a:
            ends_a, ends_b = np.cumsum([len(x) for x in said_a]).tolist(), np.cumsum([len(x) for x in said_b]).tolist()
            lo = 0
            for hi in sorted(set(ends_a) & set(ends_b)):
                groups.append(([i for i, e in zip(ids_a, ends_a) if lo < e <= hi] if len(t) < 500 else None, [i for i, e in zip(ids_b, ends_b) if lo < e <= hi] if len(t) < 500 else None, lo, hi))
                lo = hi
            if len(t) >= 500:  # the same in one pass
                groups, k, m = [], 0, 0
                for hi in sorted(set(ends_a) & set(ends_b)):
                    i, j = k, m
                    while k < len(ends_a) and ends_a[k] <= hi:
                        k += 1
                    while m < len(ends_b) and ends_b[m] <= hi:
                        m += 1
                    groups.append((ids_a[i:k], ids_b[j:m], 0, 0))
        docs.append((len(ids_a), len(ids_b), [(x, y) for x, y, *_ in groups]))
    count, best = Counter(), Counter()
    for *_, groups in docs:
        count.update({(x, y) for xs, ys in groups for x in xs for y in ys})
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for n_a, n_b, groups in docs:
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        said = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if n_a else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("block", [alignment.BLOCK_BYTES, 300])
def test_alignment_equals_whole_texts(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    rng = random.Random(11)
    texts = EDGE + EDGE[4:9] + ["".join(rng.choices(["the", "ing", "Zx", " ", " ", "é", "ß", "日", "1", ".", "\n", "▁", "'s"], k=rng.randint(1, 60))) for _ in range(250)]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(frame(spark, texts), A, B).collect()}
    for i, want in enumerate(plain(texts)):
        assert got[i] == want, (texts[i] or "")[:80]


def test_products_equal_dense_ones(monkeypatch):
    rng = np.random.default_rng(3)
    for most in (1, 1 << 22):
        monkeypatch.setattr(alignment, "PRODUCT", most)
        for n, m, k in ((4, 5, 6), (1, 9, 2), (0, 3, 3), (7, 1, 1)):
            x, y = rng.integers(0, 3, (n, m)), rng.integers(0, 3, (m, k))
            sparse = [alignment.Csr.of(*np.nonzero(d), d[np.nonzero(d)], *d.shape) for d in (x, y)]
            got = sparse[0].times(sparse[1])
            dense = np.zeros((n, k), int)
            dense[got.rows(), got.cols] = got.data
            assert (dense == x @ y).all() and got.width == k


def test_overlap_links_share_bytes():
    a, b = np.array([3, 5, 9]), np.array([1, 4, 9])
    got = alignment.overlap_links(a, b)
    assert list(zip(got.rows().tolist(), got.cols.tolist(), got.data.tolist())) == [(0, 0, 1), (0, 1, 2), (1, 1, 1), (1, 2, 1), (2, 2, 4)]


def test_empty_table_and_null_ids(spark):
    assert alignment.align(frame(spark, []), A, B).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_a"], r["count_sum"]) for r in alignment.align(rows, A, B).collect()) == [(0, 2, 4), (0, 2, 4), (2, 0, 0)]
