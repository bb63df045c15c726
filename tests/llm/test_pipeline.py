"""The corpus pipeline against a plain version, stage by stage, and what the registered queries are held against."""

from __future__ import annotations

import random
import re

import numpy as np
import sentencepiece
import xxhash

import corpus_pipeline
from sylva.llm import oracle, queries, toxicity
from sylva.llm.queries import vocabulary

# queries without SQL, and the test that holds each against a plain version, a library or a round trip
HELD_BY = {
    "op1_token_counts": "test_operators.test_token_counts_equal_the_library",
    "op2_sentencepiece": "test_operators.test_sentencepiece_parity_and_round_trip",
    "op3_decontamination": "test_pipeline.test_run_equals_a_plain_version",
    "op4_simhash": "test_pipeline.test_run_equals_a_plain_version",
    "op5_language": "test_operators",
    "op6_toxicity": "test_pipeline.test_run_equals_a_plain_version",
    "op7_lattice_scores": "test_operators.test_lattice_equals_the_sum_over_segmentations",
    "op8_licences": "test_operators.test_licence_templates_of_any_length",
    "op9_hilbert_neighbours": "test_operators.test_neighbours_recall_and_order",
    "op10_pii": "test_operators.test_personal_data_equals_plain_expressions",
    "op11_token_alignment": "test_alignment.test_alignment_equals_whole_texts",
    "op12_conversation_repair": "test_conversations.test_repair_equals_a_search_over_all_edits",
}


def test_every_query_has_sql_or_a_plain_version():
    assert set(queries.QUERIES) == set(HELD_BY) | set(oracle.ORACLE_SQL) and not set(HELD_BY) & set(oracle.ORACLE_SQL)


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    h = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def heads(rows):
    """Rows of ``(doc_id, text, ...)`` that head their group of fingerprints."""
    prints = [fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min(r[0] for r, k in zip(rows, group) if k == g) for g in set(group)}
    return [r for r, g in zip(rows, group) if r[0] == least[g]]


def test_run_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(31)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, prose(60)) for i in range(4)]
    texts = [prose(rng.randint(20, 120)) for _ in range(30)]
    texts += [texts[0], texts[0].upper(), texts[3], texts[4] + " end"]  # copies, and nearly one
    texts += [prose(30) + " " + items[1][1] + " " + prose(10), items[2][1], prose(25) + " " + items[3][1].title()]  # benchmark passages
    texts += [prose(40) + " You are a stupid idiot, a worthless moron. " + prose(10), "I will kill you, you pathetic scum. " + prose(30)]
    texts += [prose(20) + " write to ann.b@example.org or +1 (017) 555-7713, card 4149601755386017, from 10.1.2.3 " + prose(5)]
    texts += [None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    sf = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in (37, 38))) for i in range(0, len(rows), 2)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "sentencepiece"]
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert [i for i, p in scored.items() if p] == [37, 38]
    want = [r for r in rows if not scored[r[0]]]
    now = docs

    def stage(name):
        return stages[name](spark, now, sf)

    def same(out, expected):
        assert out.columns == docs.columns
        got = sorted(map(tuple, out.collect()))
        assert got == sorted(expected)
        return spark.createDataFrame(got, docs.schema)

    now = same(stage("toxicity"), want)
    want = heads(want)
    assert len(want) < len(scored) - 5
    now = same(stage("simhash_near_dedup"), want)
    plain = lambda t: re.sub(r"\W+", " ", (t or "").lower())
    want = [r for r in want if not any(plain(x) in plain(r[1]) for _, x in items)]
    now = same(stage("benchmark_decontamination"), want)
    hidden = lambda t: t and re.sub(r"4149601755386017", "[CARD]", re.sub(r"\+1 \(017\) 555-7713", "[PHONE]", re.sub(r"\b10\.1\.2\.3\b", "[IP]", re.sub(r"\S+@\S+", "[EMAIL]", t))))
    want = [(r[0], hidden(r[1]), r[2], r[3], None if r[1] is None else len(hidden(r[1]))) for r in want]
    now = same(stage("pii"), want)
    slow = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    ids = {r[0]: None if r[1] is None else slow.encode(r[1]) for r in want}
    assert {r["doc_id"]: r["ids"] for r in stage("sentencepiece").collect()} == ids
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf).collect()} == ids
    assert not np.any([i in ids for i in (37, 38)])
