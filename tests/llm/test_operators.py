"""Text operators against brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from sylva.llm import decontaminate, hilbert_ann, langid, lattice, licenses, pii, sentencepiece_codec, simhash, tokencount, toxicity
from sylva.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, held_out string, token string, fp string"
EDGE = [None, "", " ", "a", "a a a", "é 日本語 👍🏽 ﬀ", "x" * 5000, "word " * 20_000, "<|endoftext|> b", "12.5.6.7 +1 (017) 555-7713 a@b.c"]


def docs(spark, texts, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], "s", None, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = EDGE + ["ΑΣ ΟΔΟΣ Σ", "İstanbul don't 12's", "a<|startoftext|><|endoftext|>", "b᠎ \x1c\x85c"]
    got = by_id(tokencount.token_counts(docs(spark, texts), path))
    for i, x in enumerate(texts):
        want = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (want, len((x or "").encode()), want > 2048)


def test_sentencepiece_parity_and_round_trip(spark):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    slow = sentencepiece.SentencePieceProcessor(model_file=path)
    coded = sentencepiece_codec.encode(docs(spark, EDGE), path)
    got, back = by_id(coded), by_id(sentencepiece_codec.decode(coded, path))
    assert got[0]["ids"] is None and got[0]["n_tokens"] is None and back[0]["text"] is None
    for i, x in enumerate(EDGE):
        if x is not None:
            assert got[i]["ids"] == slow.encode(x) and got[i]["parity"] and got[i]["round_trip"]
            assert back[i]["text"] == x
            assert got[i]["ids_sha256"] == hashlib.sha256(np.array(got[i]["ids"], "<i4").tobytes()).hexdigest()


def test_decontamination_finds_edited_passages_and_leaves_others(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    items = [" ".join(rng.choices(words, k=40)) for _ in range(5)]
    edited = list(items[1])
    for at in (10, 60, 110):
        edited[at] = "z"
    texts = [None, "", f"Intro. {items[0].upper()}! end", "x " * 300 + "".join(edited) + " tail", " ".join(rng.choices(words, k=300)), items[2][:130]]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, ""), (92, "short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == {(2, 0), (3, 1), (5, 2)}
    assert got == {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, texts), bench, block_bytes=200).collect()}
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs(spark, texts), bench).collect()) == [0, 1, 4]


def test_decontamination_finds_quotes_at_every_offset():
    rng = random.Random(12)
    item = " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(60))
    index = decontaminate.Index([(7, item)])
    n = decontaminate.PIECE
    for at in range(len(item) - n + 1):
        if " " in (item[at], item[at + n - 1]):
            continue  # a blank at an end goes in normalising
        quote = item[at : at + n]
        (got,) = index.find(f"0123 {quote} 4567")
        assert got[0] == 7 and got[1] in (4, 5) and got[2] == got[1] + n and got[3:] == (0, n), at  # 4: with the blank before
        assert not index.find(f"0123 {quote[:60]} 4567")
        if at % 10 == 0:
            edited = quote[:20] + "9" + quote[21:47] + quote[48:70] + "99" + quote[70:]  # one changed, one lost, two new
            hit = index.find(f"0123 {edited} 4567")
            assert len(hit) == 1 and 0 < hit[0][3] <= 4, at
    assert not index.find(" ".join(w[::-1] for w in item.split()))


def brute_fingerprint(text, k=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_equal_all_pairs(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(120)] for _ in range(12)]
    texts = EDGE[:6] + [" ".join(b) for b in base]
    for b in base[:8]:
        for _ in range(8):
            c = list(b)
            c[rng.randrange(len(c))] = "q"
            texts.append(" ".join(c))
    texts += texts[7:10]
    got = by_id(simhash.near_duplicates(docs(spark, texts)))
    fp = [brute_fingerprint(t) for t in texts]
    up = list(range(len(texts)))
    for _ in up:
        for i in range(len(texts)):
            for j in range(i):
                if bin(fp[i] ^ fp[j]).count("1") <= 2:
                    up[i] = up[j] = min(up[i], up[j])
    assert [got[i]["fp"] % 2**64 for i in range(len(texts))] == fp
    assert [got[i]["component_id"] for i in range(len(texts))] == up
    assert len(simhash.keep_one(docs(spark, texts)).collect()) == len(set(up))


def test_a_row_that_shares_an_id_is_judged_by_its_own_text(spark):
    a, b = "one two three four five six seven eight", "alpha beta gamma delta epsilon zeta eta theta"
    rows = spark.createDataFrame([(5, a), (5, b), (1, a), (None, a), (9, None), (8, "")], "doc_id long, text string")
    kept = {(r["doc_id"], r["text"]) for r in simhash.keep_one(rows).collect()}
    assert kept == {(1, a), (5, b), (None, a), (8, "")}


def test_vantage_shards_lose_no_link():
    rng = np.random.default_rng(2)
    fp = np.unique(rng.integers(0, 2**63, 6000, dtype=np.uint64))
    near = fp[:1500] ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64))
    fp = np.unique(np.concatenate([fp, near]))
    row, shard = simhash.route(fp, 6, 2)
    homes = [set() for _ in fp]
    for r, s in zip(row.tolist(), shard.tolist()):
        homes[r].add(s)
    for a in range(0, len(fp), 500):
        i, j = np.nonzero(np.bitwise_count(fp[a : a + 500, None] ^ fp[None, :]) <= 2)
        assert all(homes[a + x] & homes[y] for x, y in zip(i, j))


def test_language_of_held_out_and_mixed_texts(spark):
    rng = random.Random(1)
    stock = {"en": "the and of with this that from house water".split(), "de": "der und die mit nicht haus wasser über".split(), "ru": "это дом вода который очень".split()}
    langs = [rng.choice(list(stock)) for _ in range(120)]
    texts = [" ".join(rng.choices(stock[x], k=30)) for x in langs]
    table = docs(spark, texts + [None, "123 !", "this house " * 5 + "nicht über die " * 40], langs + ["en"] * 3)
    got = by_id(langid.identify(table, langid.train(table)))
    assert all(got[i]["lang_pred"] == x and 0 <= got[i]["score"] <= 1 for i, x in enumerate(langs))
    assert got[120]["lang_pred"] == got[121]["lang_pred"] == "und" and got[120]["score"] == 0
    assert got[122]["lang_pred"] == "de" and got[122]["n_spans"] == 2
    empty = table.limit(0)
    assert {r["lang_pred"] for r in langid.identify(table, langid.train(empty)).collect()} == {"und"}
    assert langid.identify(empty, langid.train(table)).count() == 0


def test_gram_hashes_equal_plain_grams():
    words = ["a", "ab", "haus", "über", "дом", "x" * 12, "y" * 13, "haus" * 10]

    def plain(w):
        p = f" {w} "
        return [p[i : i + n] for n in (1, 2, 3, 4) for i in range(len(p) - n + 1)] + [("whole", w)] * (2 < len(w) <= 12)

    key, owner = langid.grams(words)
    for i, w in enumerate(words):
        mine = key[owner == i].tolist()
        assert len(mine) == len(plain(w)) and len(set(mine)) == len(set(plain(w)))
    assert len(set(key.tolist())) == len({g for w in words for g in plain(w)})


def test_viterbi_equals_all_paths():
    import itertools

    m = langid.Model(["a", "b", "c"], np.zeros(0, np.int64), np.zeros((0, 3)), {})
    m.rows = np.random.default_rng(0).normal(0, 5, (20, 3))
    ids = [np.array(x) for x in ([3, 1, 4, 1, 5, 9], [2, 7, 1, 8], [6])]
    for path, x in zip(m._viterbi(ids), ids):
        value = lambda p: sum(m.rows[w][s] for w, s in zip(x, p)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:]))
        assert value(path) == pytest.approx(max(map(value, itertools.product(range(3), repeat=len(x)))))


def test_toxicity_grammar_and_scores(spark):
    g = toxicity.Grammar(toxicity.seed_lexicon())
    arcs = lambda t: dict(zip(toxicity.ARCS, g.arcs(t)))
    assert arcs("You are an idiot.")["targeted insult"] == 1
    assert arcs("You are not an idiot.")["negated insult"] == 1
    assert arcs("He said: you idiot!")["reported insult"] == 1
    assert arcs("I will kill you!")["targeted threat"] == 1
    assert not any(g.arcs(None)) and not any(g.arcs("a fine day"))
    rng = random.Random(2)
    y = [int(rng.random() < 0.4) for _ in range(200)]
    texts = [" ".join(rng.choices("one two three four five".split(), k=20)) + (" you are an idiot" if t else "") for t in y] + [None, ""]
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(y)] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    got = by_id(toxicity.toxicity(docs(spark, texts), labels))
    assert [got[i]["predicted"] for i in range(200)] == y and got[200]["predicted"] == got[201]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    bare = by_id(toxicity.toxicity(docs(spark, texts), labels.limit(0)))
    assert [bare[i]["predicted"] for i in range(200)] == y


def test_training_sample_has_a_row_for_each_id(spark):
    table = spark.createDataFrame([(1, "b"), (1, "c"), (1, None)] * 50 + [(2, "a"), (4, None), (5, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (4, 1)], "doc_id long, toxic int")
    got = {tuple(r) for r in toxicity.training_sample(table, labels, 100).collect()}
    fold = {r[0] for r in labels.filter(toxicity.fold("doc_id", 3) != 1).collect()}
    want = {x for x in [(1, "c", 1), (2, "a", 0), (4, None, 1)] if x[0] in fold}
    assert 1 in fold and got == want and toxicity.training_sample(table, labels, 100).count() == len(want)


def test_learned_insults_need_independent_evidence(spark):
    rng = random.Random(3)
    fill = [f"{a}{b}ord" for a in "bdfgklmn" for b in "aeiou"]
    rows = [(" ".join(rng.choices(fill, k=15) + rng.sample(["zork", "blarg", "quix"], 2) * (i % 4 == 0)), int(i % 4 == 0)) for i in range(400)]
    rows += [("copied nastyword here", 1)] * 40 + [("lone " + "repeatword " * 40, 1), (None, 1), ("", 0)]
    sample = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, toxic int")
    assert sorted(toxicity.learned_insults(sample, 100)) == ["blarg", "quix", "zork"]
    assert toxicity.learned_insults(sample.filter("toxic = 1"), 100) == [] == toxicity.learned_insults(sample.limit(0), 100)


def test_codec_lines_equal_single_words():
    """Words that change in normalising, or start with a mark that it splits off, among many plain ones."""
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    c, slow = sentencepiece_codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["ﬀ", "¨x", "é", "́a", "①", "\u2581b", "a\u2581b", "日本語", "👍🏽", "x\ty", "\u3000z", "half\u00a0space", ""]
    texts = [" ".join(["plain"] * k + [w, f"word{k}", w + "tail"]) + " " * (k % 3) for k, w in enumerate(odd * 3)]
    for text, (ids, parity, back) in zip(texts, c.encode(texts)):
        whole = c.whole([text])[0]
        assert (ids, back) == (whole[0], whole[2])
        assert parity == (np.frombuffer(ids, "<i4").tolist() == slow.encode(text))


def test_lattice_equals_the_sum_over_segmentations():
    v = lattice.vocabulary(vocabulary("piece_bpe_32k.model"))
    logp = np.log(v.prior)
    number = {p: i for i, p in enumerate(v.pieces)}

    def brute(s):
        if not s:
            return 1.0
        total = sum(np.exp(logp[number[s[:k]]]) * brute(s[k:]) for k in range(1, min(len(s), v.longest) + 1) if s[:k] in number)
        return total + (np.exp(logp[-1] * len(s[0].encode())) * brute(s[1:]) if s[0] not in number else 0)

    words = ["the", "thering", "a", "überall", "日͸x", "tionea"]
    got, expected = lattice.Lattice(v, logp).run(words, np.ones(len(words)))
    assert np.exp(got) == pytest.approx([brute("▁" + w) for w in words], rel=1e-9)
    assert expected.sum() > len(words)


def test_lattice_base_and_counts_equal_brute_force(spark):
    import math
    import zlib
    from collections import Counter

    texts = ["The cat the CAT", "the dog", None, "", "É É x", "the cat"] * 6
    got = by_id(lattice.likelihoods(docs(spark, texts), vocabulary("piece_bpe_32k.model")))
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    c = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10 for w in tok(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tok(t)), sum(c[w] > 0 for w in tok(t)), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok(t)))
        assert r["score"] <= 0 and r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)


def test_lattice_score_equals_the_sum_over_arcs(spark):
    import math
    import zlib
    from collections import Counter

    texts = ["a b a b a c", "B", None, "the cat. the cat", "a a zzq"] * 8
    path = vocabulary("piece_bpe_32k.model")
    got = by_id(lattice.likelihoods(docs(spark, texts), path))
    words = [lattice.tokens(t) for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    c = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    ends = held.count(False)
    n, once = sum(c.values()) + ends, sum(x == 1 for x in c.values())
    table = spark.createDataFrame(list(c.items()), "token string, c long")
    logp = np.log(lattice.reestimated(table, path))
    of = dict(zip(c | Counter(sum(words, [])), lattice.Lattice(lattice.vocabulary(path), logp).run(list(c | Counter(sum(words, []))))[0]))
    u = (once + 1) / (n + 2)
    for i, ws in enumerate(words):
        want, seen = 0.0, Counter()
        for k, w in enumerate(ws):
            p = u * math.exp(of[w]) + (1 - u) * c[w] / n
            want += math.log10((1 - lattice.OWN) * p + lattice.OWN * seen[w] / k if k else p)
            seen[w] += 1
        want += math.log10((u * math.exp(logp[-2]) + (1 - u) * ends / n) * (1 - lattice.OWN if ws else 1))
        assert got[i]["score"] == pytest.approx(want, rel=1e-9)


def test_licences_found_in_long_and_short_texts(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    texts = [None, "", notice, "x y z w " * 300 + notice + " q r s" * 200, "apache license version two", "RELEASED under the MIT license"]
    for pad in range(12, 24):
        texts.append("a b c d e f g h i j k l m n o p q r s t u v w x y z"[: 2 * pad] + " " + notice)
    got = {(r["doc_id"], r["licence"]) for r in licenses.licences(docs(spark, texts)).collect()}
    assert got == {(2, "Apache-2.0"), (3, "Apache-2.0"), (5, "MIT"), *((i, "Apache-2.0") for i in range(6, len(texts)))}


def brute_licences(text, templates, least=0.8):
    """Whole texts only: distinct shingles of the template anywhere in the text (no notice among the templates)."""
    def of(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    have = of(text)
    share = {name: len(of(t) & have) / len(of(t)) for name, t in templates}
    return {name: x for name, x in share.items() if x >= least}


def test_licence_templates_of_any_length(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(3000)]
    templates = [(f"L{n}", " ".join(rng.choices(words, k=n))) for n in (22, 40, 150, 2000)]
    texts = []
    for _, t in templates:
        for pad in (0, 3, 17, 200):
            w = t.split()
            for at in rng.sample(range(len(w)), len(w) // 60):
                w[at] = "changed"
            texts.append(" ".join(rng.choices(words, k=pad) + w + rng.choices(words, k=50)))
        texts.append(" ".join(t.split()[: len(t.split()) // 2]))
    want = {(i, name): x for i, t in enumerate(texts) for name, x in brute_licences(t, templates).items()}
    assert len(want) == 16
    for given in (templates, spark.createDataFrame(templates, "licence string, text string")):
        got = {(r["doc_id"], r["licence"]): r["containment"] for r in licenses.licences(docs(spark, texts), given).collect()}
        assert got == pytest.approx(want)
    hidden = [" ".join(rng.choices(words, k=9)) + " do as you like " + " ".join(rng.choices(words, k=9)), "do as you", None]
    short = licenses.licences(docs(spark, hidden), [("WTF", "Do as you like"), ("X", ""), ("Y", None)])
    assert [(r["doc_id"], r["licence"]) for r in short.collect()] == [(0, "WTF")]


def test_further_licences_bodies_and_versions(spark):
    bodies = dict(licenses.whole_texts())
    cases = [
        ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"GPL-3.0"}),
        ("it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;", {"LGPL"}),
        ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation", {"AGPL"}),
        ("Text licensed under CC BY-SA 4.0. See", {"CC-BY-SA-4.0"}),
        ("a Creative Commons Attribution 4.0 International License", {"CC-BY-4.0"}),
        ("// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note OR BSD-3-Clause) */\nint x;", {"GPL-2.0-only", "BSD-3-Clause"}),
        ("# spdx-license-identifier: MIT\nOR so", {"MIT"}),
        ("a " * 40 + bodies["Apache-2.0"].split("TERMS AND CONDITIONS", 1)[1].replace("\n", "\n# "), {"Apache-2.0"}),
        ("b " * 7 + bodies["ISC"].split("hereby granted", 1)[1], {"ISC"}),
        (bodies["GPL-3.0"][3000:12000], set()),
    ]
    got = {(r["doc_id"], r["licence"]) for r in licenses.licences(docs(spark, [t for t, _ in cases])).collect()}
    for i, (_, want) in enumerate(cases):
        assert {x for d, x in got if d == i} == want, i


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0]), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hilbert_ann.search(table, k=5, sample=64, chunk=700).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 6)) and np.all(np.diff(g["score"]) <= 0)
        assert g["score"].to_numpy() == pytest.approx(s[g["vec_id"]])
        hits += len(set(np.argsort(-s)[:5]) & set(g["vec_id"]))
    assert got["query_id"].nunique() == 150 and hits / (150 * 5) >= 0.9
    assert hilbert_ann.search(table.limit(0)).count() == 0
    few = hilbert_ann.search(table.filter("vec_id < 3"), k=5).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in few) == [(0, 1), (0, 2)]


def test_every_chunk_sees_its_window(spark):
    from pyspark.sql import functions as F

    n, chunk = 1000, 50
    ranked = spark.range(n).select(F.lit(0).alias("curve"), F.col("id").alias("rank"), F.col("id").alias("row"), F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("v"))
    for window in (1, 70, n):
        rows = hilbert_ann.deal(ranked, ranked.filter("vec_id % 300 = 0"), window, n, chunk).toPandas()
        for _, g in rows.groupby(["curve", "chunk"]):
            held, asks = set(g[~g["asks"]]["rank"]), g[g["asks"]]["rank"].tolist()
            assert len(asks) <= chunk and len(held) == (~g["asks"]).sum()
            assert all(set(range(max(0, q - window), min(n - 1, q + window) + 1)) <= held for q in asks)
        assert sorted(rows[rows["asks"]]["rank"]) == [0, 300, 600, 900]


def test_neighbours_of_repeated_ids_and_equal_vectors(spark):
    rng = np.random.default_rng(7)
    one, other = rng.standard_normal(8).tolist(), rng.standard_normal(8).tolist()
    rows = [(20, one), (1, one), (1, one), (2, one), (3, other), (40, one), (40, other), *[(100 + 2 * i + 1, one) for i in range(60)]]
    got = hilbert_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    of = lambda q: sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
    assert of(20) == [(1, 1), (2, 1), (3, 2)]  # rows of one id are candidates of their own
    dot = float(np.dot(one, other))
    assert of(40) == sorted([(1, 1), (2, 1), (3, 2), (1, 3), *([(2, 1), (3, 1)] if dot > 0 else [(2, 1), (3, 1)])])
    assert len({r["score"] for r in got if r["query_id"] == 20}) == 1


def test_hilbert_curve_visits_neighbouring_cells():
    cells = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    keys = hilbert_ann.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    assert np.all(np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1)


def brute_spans(t):
    out, luhn = [], lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    for no, (kind, p) in enumerate(pii.SPEC.items()):
        for m in re.finditer(p, t or "", re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def test_personal_data_equals_plain_expressions(spark):
    rng = random.Random(9)
    texts = EDGE + ["4149601755386017", "1.2.3.4.5.6.7.8 001.2.3.255 256.1.1.1", "a@b.c%x@d.e a@b@c.d .@-.-", "4 1 4 9-6017 5538-6017x12--34", "1" * 30_000, "a" * 30_000 + "@b.co", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +49 (30) 1234567. é +1 (017) 555-7713)"]
    texts += ["".join(rng.choices("a@.1234+-( )é", k=60)) for _ in range(400)]
    got = by_id(pii.pii_digest(docs(spark, texts)))
    for i, t in enumerate(texts):
        want = brute_spans(t)
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t[:80]
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(s[3] == k for s in want) for k in pii.BASE]


def test_added_kinds_context_and_redaction(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 ok", "DE88 3704 0044 0532 0130 00", "ssn 123-45-6789", "part 123-45-6789", "é mail a@b.co now", None]
    got = by_id(pii.pii_digest(docs(spark, texts)))
    assert [got[i]["n_iban"] for i in (0, 1)] == [1, 0] and [got[i]["n_ssn"] for i in (2, 3)] == [1, 0]
    clean = by_id(pii.redact(docs(spark, texts)))
    assert clean[4]["text"] == "é mail [EMAIL] now" and clean[4]["n_chars"] == 18 and clean[5]["text"] is None


def test_an_iban_ends_where_its_country_says(spark):
    spaced = "ES91 2100 0418 4502 0005 1332"
    ibans = [spaced, spaced.replace(" ", ""), "AT61 1904 3002 3457 3201", "PL61 1090 1014 0000 0712 1981 2874", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "BE68 5390 0754 7034", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "DZ58 0002 1000 0111 3000 0005 70"]
    after = ["", ".", " BIC CAIXESBB", " EUR 50", " CODE x", " X", " 12", " 1234 5678", " DE89 3704 0044 0532 0130 00"]
    assert all(int("".join(str(int(c, 36)) for c in (i[4:] + i[:4]).replace(" ", ""))) % 97 == 1 for i in ibans)
    texts = [f"a {i}{x}" for i in ibans for x in after] + [i + "7" for i in ibans] + ["x" + i for i in ibans]
    got = by_id(pii.pii_digest(docs(spark, texts)))
    clean = by_id(pii.redact(docs(spark, texts)))
    n = len(ibans) * len(after)
    for k in range(n):
        two = k % len(after) == len(after) - 1
        assert (got[k]["n_iban"], clean[k]["text"]) == (1 + two, "a [IBAN]" + (" [IBAN]" if two else after[k % len(after)])), texts[k]
    assert [got[k]["n_iban"] for k in range(n, len(texts))] == [0] * (2 * len(ibans))
