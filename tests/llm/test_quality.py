"""Quality rules against a plain version, and the ledger's policies and ablations."""

from __future__ import annotations

import random
import re
from collections import Counter

from sylva.llm import quality

SCHEMA = "doc_id long, text string, n_words long, fail_bits string, kept string"
WORD = re.compile("[^\x20\x09-\x0d]+")
EDGE = [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "\n\nx\nx\n \n \nx ", "# * $ | a b", "é 日本語\x85x y z\x0bq", "w " * 50_000, "x" * 5000]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 7, "x", "y") for i, t in enumerate(texts)], SCHEMA)


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed


def test_measurements_equal_a_plain_version(spark):
    rng = random.Random(5)
    texts = EDGE + ["".join(rng.choices(["a ", "b ", "c\n", "d|", "\t"], k=rng.randint(1, 90))) for _ in range(300)]
    got = {r["doc_id"]: r for r in quality.verdicts(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain(t), t and t[:80]
        assert not (r["base_failed"] and r["kept"])
    assert got[0].asDict() | {"doc_id": 1} == got[1].asDict()


def test_policies_and_ablations_from_the_ledger(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefg", k=5)) for _ in range(500)]
    good = [" ".join(rng.choices(words, k=40)) for _ in range(20)]
    texts = [*good, *(g.replace(" ", " | ", 20) for g in good[:3]), "few words", "few | words", None, " ".join(words[:6] * 9)]
    led = quality.ledger(frame(spark, texts)).cache()
    rows = led.collect()
    got = {(r["version"], r["rule"]): (r["n_docs"], r["n_kept"], r["n_failing"], r["n_alone"]) for r in quality.ablations(led).collect()}
    for version, names in quality.POLICIES.items():
        m = quality.mask(names)
        kept = sum(r["fail_bits"] & m == 0 for r in rows)
        assert led.where(quality.apply_policy(led, m)).count() == kept
        for n in names:
            b = quality.mask([n])
            assert got[version, n] == (len(texts), kept, sum(r["fail_bits"] & b > 0 for r in rows), sum(r["fail_bits"] & m == b for r in rows))
    assert len(got) == sum(map(len, quality.POLICIES.values()))
    (s,) = quality.summary(led.selectExpr("1 as g", "fail_bits"), "g").collect()
    assert s["any_bits"] & 0b1011 == 0b1011 and s["all_bits"] == 0
    led.unpersist()


def test_empty_tables_repeated_and_null_ids(spark):
    assert quality.verdicts(frame(spark, [])).count() == 0 and quality.ablations(quality.ledger(frame(spark, []))).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in quality.verdicts(twice).collect()) == [(0, 1), (1, 2), (1, 2)]
