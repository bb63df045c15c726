"""Operator 13: quality rules kept as a ledger of failure bits.

``measure`` reads every text once and gives its counts; ``ledger`` evaluates every rule once
over them and stores one long of failure bits beside the measurements. Policies are rows
(version, mask): ``apply_policy`` keeps what fails no rule of the mask, ``ablations`` says
what each rule of each policy costs. Both read the ledger alone, never a text again.

Null texts have no words and no lines: all counts are 0, so they fail the least word count.
Empty texts and texts of blanks alike. Repeated rows get a row each; null ids stay null;
an empty table gives an empty ledger; further columns of any name are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import texts

WORD = re.compile("[^\x20\x09-\x0d]+").findall
HAS_WORD = re.compile("[^\x20\x09-\x0d]").search
SYMBOL = re.compile("[#*$%&|<>]").findall
WINDOW = 5  # words of a repeated window
MIX = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier

# what is measured: column, and the type Arrow gives it
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "longest_word"]


@dataclass(frozen=True)
class Rule:
    """A rule's bit, name and the SQL condition over the measurements that fails a document."""

    bit: int
    name: str
    fails: str


# the bit of a rule never changes its meaning: a changed rule gets a new bit, old ledgers stay readable
RULES = [
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "duplicate_lines", "n_dup_lines >= 5 and 10 * n_dup_lines > 3 * n_lines"),
    Rule(3, "symbols", "10 * n_symbols > n_words"),
    Rule(4, "short_words", "word_chars < 3 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
    Rule(6, "endless_word", "longest_word > 1000"),
]
BASE = ["few_words", "repeated_windows"]

# fixed values: the policies by version, as rule names
POLICIES = {
    "v1": BASE,
    "v2": [*BASE, "duplicate_lines", "symbols"],
    "v3": [r.name for r in RULES],
}
CURRENT = "v3"


def mask(names: list[str], rules: list[Rule] = RULES) -> int:
    """The bits of some rules, by name."""
    bit = {r.name: r.bit for r in rules}
    return sum(1 << bit[n] for n in set(names))


def repeat_words(words: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more (the first included).

    Equal windows have equal hashes, so windows whose hash is alone differ from all others.
    The rest are numbered exactly: a window of k + 1 words is its first k words' number and
    its last word, renumbered, so equal numbers mean equal words.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    hashed = np.zeros(n, np.uint64)
    for k in range(width):
        hashed = hashed * MIX + words[k : k + n].astype(np.uint64)
    order = np.sort(hashed)
    shared = order[1:][order[1:] == order[:-1]]
    if not len(shared):
        return 0
    at = np.flatnonzero(np.isin(hashed, shared))
    number, most = words[at], int(words.max()) + 1
    for k in range(1, width):
        number = np.unique(number * most + words[at + k], return_inverse=True)[1]
    at = at[np.bincount(number)[number] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    edge[at] += 1
    edge[at + width] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measurements(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of ``MEASURES``."""
    text = text or ""
    words = WORD(text)
    if not words:
        return (0, 0, len(SYMBOL(text)), 0, 0, 0, 0)
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    sizes = list(map(len, words))
    lines = [x for x in text.split("\n") if HAS_WORD(x)]
    return (len(words), sum(sizes), len(SYMBOL(text)), len(lines) - len(set(lines)), repeat_words(ids), len(lines), max(sizes))


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measurements of every row."""
    kept = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([measurements(t.as_py()) for t in b.column("text")], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(rows[:, k]) for k in range(len(MEASURES)))], schema=kept)

    return texts(docs).mapInArrow(run, ", ".join(["doc_id long", *(f"{m} long" for m in MEASURES)]))


def failure_bits(rules: list[Rule] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``doc_id``, the measurements and ``fail_bits``: every rule evaluated once."""
    return measure(docs).withColumn("fail_bits", failure_bits(rules))


def policy_rows(named: dict[str, list[str]] = POLICIES, rules: list[Rule] = RULES) -> Column:
    """The policies as an array of ``version, rule, bit, mask``, one entry for each rule of each policy."""
    return F.array(*[F.struct(F.lit(v).alias("version"), F.lit(n).alias("rule"), F.lit(mask([n], rules)).cast("long").alias("bit"),
                              F.lit(mask(names, rules)).cast("long").alias("mask")) for v, names in sorted(named.items()) for n in names])


def apply_policy(led: DataFrame, bits: int) -> Column:
    """Whether a ledger row fails no rule of a policy's mask."""
    return led["fail_bits"].bitwiseAND(F.lit(bits).cast("long")) == 0


def ablations(led: DataFrame, named: dict[str, list[str]] = POLICIES, rules: list[Rule] = RULES) -> DataFrame:
    """``version, rule, n_docs, n_kept, n_failing, n_alone``: for each rule of each policy, the documents that
    the policy keeps, that fail the rule, and that only this rule of the policy rejects (what
    leaving it out would give back). Rows are counted by distinct bits first (at most 2 to the
    number of rules), so the policies meet that small table, not the documents."""
    by_bits = led.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rows = by_bits.select("fail_bits", "n", F.inline(policy_rows(named, rules)))
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("long")

    return rows.groupBy("version", "rule").agg(
        F.sum("n").alias("n_docs"), total(failed == 0).alias("n_kept"),
        total(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0).alias("n_failing"), total(failed == F.col("bit")).alias("n_alone"))


def summary(led: DataFrame, group: str) -> DataFrame:
    """``group, n_docs, any_bits, all_bits``: the rules that some, and that all, documents of a group fail."""
    return led.groupBy(group).agg(F.count(F.lit(1)).alias("n_docs"), F.bit_or("fail_bits").alias("any_bits"), F.bit_and("fail_bits").alias("all_bits"))


def verdicts(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under one policy version."""
    led = ledger(docs)
    base = apply_policy(led, mask(BASE))
    return led.select("doc_id", *MEASURES[:5], (~base).alias("base_failed"),
                      (base & apply_policy(led, mask(POLICIES[version]))).alias("kept"), *MEASURES[5:], "fail_bits")
