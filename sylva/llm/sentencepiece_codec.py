"""Operator 2: SentencePiece models run by the tokenizers library.

The model's protobuf is parsed and its normaliser, blank marker, pieces (unigram scores,
or the merges that the scores imply) and byte fallback are rebuilt as a tokenizer, which
encodes batches on several threads. Where no piece holds a blank marker after another
character, texts are cut before each marker first; merges can't cross such a cut, so
the identifiers are the same and words can be remembered. Every batch is verified: what the
tokenizer encodes (each word once where texts are cut at words, else each text) is encoded
by the sentencepiece library too and decoded again.

Null texts give null identifiers and counts; empty texts none. Repeated rows are encoded
row by row.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

MARK = "▁"
WORDS = re.compile(" +[^ ]+| +$").findall
KNOWN_WORDS, KNOWN_CHARS = 200_000, 4 << 20  # words remembered by a Python worker; only the memory's bound
LINE_WORDS = 32  # words encoded by one call
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, _, BYTE = range(1, 7)


def parse(path: str) -> proto.ModelProto:
    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


def _merges(pieces: list[tuple[str, float]], usable: set[str]) -> list[tuple[str, str]]:
    """A BPE model's merges: by descending score of the merged piece, then by the parts' scores."""
    number = {p: i for i, (p, _) in enumerate(pieces)}
    out = []
    for p, score in pieces:
        if p in usable and len(p) > 1:
            halves = [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
            out += [(-score, number[a], number[b], a, b) for a, b in halves]
    return [(a, b) for *_, a, b in sorted(out)]


def rebuild(path: str) -> Tokenizer:
    """The tokenizer for a model file."""
    m = parse(path)
    spec, norm = m.trainer_spec, m.normalizer_spec
    pieces = [(p.piece, p.score) for p in m.pieces]
    normal = [p.piece for p in m.pieces if p.type in (NORMAL, USER)]
    if spec.model_type == UNIGRAM:
        t = Tokenizer(models.Unigram(pieces, unk_id=spec.unk_id, byte_fallback=spec.byte_fallback))
    elif spec.model_type == BPE:
        t = Tokenizer(models.BPE({p: i for i, (p, _) in enumerate(pieces)}, _merges(pieces, set(normal)), unk_token=spec.unk_piece or "<unk>", fuse_unk=True, byte_fallback=spec.byte_fallback))
    else:
        raise ValueError(f"model type {spec.model_type} is neither unigram nor BPE")
    steps = [normalizers.Precompiled(norm.precompiled_charsmap)] if norm.precompiled_charsmap else []
    if norm.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if norm.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if norm.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p in normal):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]*"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if norm.add_dummy_prefix else []
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    user = [AddedToken(p.piece, normalized=True) for p in m.pieces if p.type == USER]
    if user:
        t.add_tokens(user)
    return t


class Codec:
    """Encoder, decoder and parity check of one model. Encoded texts are little-endian
    32-bit identifiers."""

    def __init__(self, path: str):
        self.fast, self.slow = rebuild(path), sentencepiece.SentencePieceProcessor(model_file=path)
        self.by_word = self.fast.pre_tokenizer is not None
        self.starts = np.array([self.fast.id_to_token(i).startswith(MARK) for i in range(self.fast.get_vocab_size())])
        self.forget()
        # a last lone blank: the normaliser puts no marker before an empty text, so it can't come from whole()
        mark = self.fast.model.tokenize(MARK)
        self.blank = (np.array([t.id for t in mark], "<i4").tobytes(), True, True)

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.differ, self.lossy = set(), set()  # known words without parity, or not given back by decoding
        self.held = 0  # characters of known words

    def whole(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """(identifiers, agrees with the library, decodes to the text) of each text."""
        ids = [e.ids for e in self.fast.encode_batch_fast(texts, add_special_tokens=False)]
        slow, back = self.slow.encode(texts, num_threads=1), self.decode(ids)
        return [(np.array(x, "<i4").tobytes(), x == y, z == t) for x, y, z, t in zip(ids, slow, back, texts)]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        if not self.by_word:
            return self.whole(texts)
        if len(self.known) > KNOWN_WORDS or self.held > KNOWN_CHARS:
            self.forget()
        cut = [WORDS(" " + t) if t else [] for t in texts]  # the marker put first, as by the normaliser
        self._learn(sorted(set().union(*cut) - self.known.keys()))
        get = self.known.__getitem__
        return [(b"".join(map(get, words)), self.differ.isdisjoint(words), self.lossy.isdisjoint(words)) for words in cut]

    def _learn(self, words: list[str]) -> None:
        """Many words as one line, cut where a piece starts with the marker; the words of a line with another number
        of cuts, without parity or not given back by decoding are encoded one by one."""
        self.held += sum(map(len, words))
        alone = [w for w in words if w.startswith("  ") or w == " "]
        plain = [w for w in words if not (w.startswith("  ") or w == " ")]
        lines = [plain[k : k + LINE_WORDS] for k in range(0, len(plain), LINE_WORDS)]
        said = ["".join(line)[1:] for line in lines]
        ids = [e.ids for e in self.fast.encode_batch_fast(said, add_special_tokens=False)]
        for line, text, x, y, back in zip(lines, said, ids, self.slow.encode(said, num_threads=1), self.decode(ids)):
            codes = np.array(x, "<i4")
            cuts = np.flatnonzero(self.starts[codes])
            if x == y and back == text and len(cuts) == len(line):
                data, at = codes.tobytes(), [*(4 * cuts).tolist(), 4 * len(codes)]
                self.known.update((w, data[i:j]) for w, i, j in zip(line, at, at[1:]))
            else:
                alone += line
        for w, (x, same, back) in zip(alone, self.whole([w[1:] for w in alone])):
            if w == " ":
                x, same, back = self.blank
            self.known[w] = x
            if not same:
                self.differ.add(w)
            if not back:
                self.lossy.add(w)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.fast.decode_batch(ids, skip_special_tokens=False)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each model and Python worker."""
    if path not in _CODECS:
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _groups(texts: list[str | None], most: int = 2 << 20) -> Iterator[list[int]]:
    """Row numbers in groups of bounded text."""
    group, size = [], 0
    for i, t in enumerate(texts):
        group.append(i)
        size += len(t or "")
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, parity, round_trip`` of every row: the identifiers, their
    digest (as little-endian 32-bit numbers), whether the sentencepiece library agrees,
    and whether decoding gives the text back. ``with_ids=False`` leaves the identifiers out."""
    kept = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())),
                      ("ids_sha256", pa.string()), ("parity", pa.bool_()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            doc_id, text = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for g in _groups(text):
                rows = c.encode([text[i] or "" for i in g])
                null = np.array([text[i] is None for i in g])
                sizes = np.array([0 if with_ids is False or no else len(r[0]) // 4 for r, no in zip(rows, null)])
                data = b"".join([r[0] for r, no in zip(rows, null) if not no]) if with_ids else b""
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("int32"), mask=np.append(null, False))
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc_id[i] for i in g], pa.int64()),
                    pa.array([len(r[0]) // 4 for r in rows], pa.int64(), mask=null),
                    pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(data, "<i4"))),
                    pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string(), mask=null),
                    pa.array([r[1] for r in rows], pa.bool_(), mask=null),
                    pa.array([r[2] for r in rows], pa.bool_(), mask=null)], schema=kept)
        c.forget()  # the worker goes on to other stages

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, parity boolean, round_trip boolean")
    return out if with_ids else out.drop("ids")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` of rows with ``ids``; null ids give null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        for b in batches:
            text = c.decode([[] if x is None else [int(i) for i in x] for x in b["ids"]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [None if x is None else t for x, t in zip(b["ids"], text)]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")
