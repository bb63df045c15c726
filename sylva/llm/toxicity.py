"""Operator 6: toxicity by a weighted finite-state grammar over clauses.

Five transducers are composed: the lexicon maps words to classes (insult, threat,
target, negation, report); reported speech, negation and target each rewrite the
insults and threats of a clause by what precedes them; the last sums arc counts.
The arcs' weights are a logistic model learned from labelled training rows.

Fixed words seed the lexicon. Further insults are learned from the training sample:
words mostly of toxic rows whose excess there chance can't explain (a binomial bound).
A word counts by its contexts or its documents, whichever are fewer, so that neither a
group of copies nor one repetitive document counts as many. A learned word is weaker
evidence than a seed and has an arc of its own, so that one in a long clean text, where
it may stand by chance, doesn't reject it.

Null, empty and wordless texts score as a text without matches. The sample is bounded
(``sample_rows``, in order of a hash of the id); with no labelled row, or rows of one
class only, the fixed prior weights score alone. Labels that are null or whose
document is missing aren't learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import fold, texts
from sylva.session import materialize

SAMPLE_ROWS = 20_000
LEARNED_WORDS = 2_000
CHANCE = -5.0  # log10 of the chance that a learned word may have come by
PURE = 0.75  # share of a learned word's evidence that is toxic

# fixed values: seed lexicon
INSULTS = """idiot idiots moron morons loser losers stupid scum trash clown clowns pathetic worthless disgusting
imbecile cretin jerk bastard bitch dumbass scumbag dimwit retard vermin degenerate
idiota imbécil estúpido estúpida basura escoria payaso inútil asqueroso tonto
idiote imbécile connard connasse salaud ordure crétin débile minable dégoûtant
dummkopf trottel arschloch abschaum versager widerlich erbärmlich schwachkopf""".split()
THREATS = """kill murder hurt destroy shoot stab strangle beat burn hang crush
matar matarte destruir tuer détruire frapper töten umbringen vernichten schlagen""".split()
TARGETS = """you your youre yourself they them their he she him
tú usted ustedes ellos tu vous toi ils elles du dich dein sie ihr euch""".split()
NEGATIONS = "not no never isnt arent dont without nicht kein keine nie nunca jamás pas jamais ni".split()
REPORTS = """said says called calls wrote writes quoted quotes claimed claims reported told alleged
dijo llamó escribió dit écrit appelé sagte schrieb nannte""".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, END, LEARNED = 1, 2, 3, 4, 5, 6, 7
NEGATION_REACH = 3  # words that a negation reaches
TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]+")
BREAK = frozenset(".!?;\n")
ARCS = ("insult", "targeted insult", "reported insult", "negated insult", "threat", "targeted threat", "reported or negated threat", "clauses with a match", "learned insult")
# intercept, a weight for log(1 + each arc), and one for a plain or targeted insult or targeted threat at all
PRIOR = np.array([-4.0, 3.0, 3.5, 0.5, 0.5, 0.5, 2.0, 0.2, 0.5, 2.0, 3.0])


def seed_lexicon() -> dict[str, int]:
    kinds = ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT), (INSULTS, INSULT))
    return {w: k for words, k in kinds for w in words}


class Grammar:
    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon
        self.keys = frozenset(w for w, k in lexicon.items() if k in (INSULT, THREAT, LEARNED))

    def _classes(self, tokens: list[str]) -> Iterator[int]:
        get = self.lexicon.get
        for t in tokens:
            yield END if t[0] in BREAK else get(t, 0)
        yield END

    @staticmethod
    def _reported(stream: Iterator[int]) -> Iterator[tuple[int, bool]]:
        on = False
        for k in stream:
            on = k != END and (on or k == REPORT)
            yield k, on

    @staticmethod
    def _negated(stream: Iterator[tuple[int, bool]]) -> Iterator[tuple[int, bool, bool]]:
        left = 0
        for k, rep in stream:
            left = 0 if k == END else NEGATION_REACH + 1 if k == NEGATION else max(0, left - 1)
            yield k, rep, left > 0 and k != NEGATION

    @staticmethod
    def _clauses(stream: Iterator[tuple[int, bool, bool]]) -> Iterator[tuple[list, bool]]:
        held, target = [], False
        for k, rep, neg in stream:
            if k == END:
                if held:
                    yield held, target
                held, target = [], False
            elif k == TARGET:
                target = True
            elif k in (INSULT, THREAT, LEARNED):
                held.append((k, rep, neg))

    def arcs(self, text: str | None) -> list[int]:
        """How often each of ARCS was taken."""
        n = [0] * len(ARCS)
        if not text:
            return n
        tokens = TOKEN.findall(text.lower())
        if self.keys.isdisjoint(tokens):
            return n
        for held, target in self._clauses(self._negated(self._reported(self._classes(tokens)))):
            n[7] += 1
            for k, rep, neg in held:
                if k == LEARNED and not (neg or rep):
                    n[8] += 1
                elif k != THREAT:
                    n[3 if neg else 2 if rep else 1 if target else 0] += 1
                else:
                    n[6 if neg or rep else 5 if target else 4] += 1
        return n


def _features(arcs: np.ndarray) -> np.ndarray:
    a = np.asarray(arcs, dtype=float).reshape(-1, len(ARCS))
    return np.hstack([np.ones((len(a), 1)), np.log1p(a), (a[:, [0, 1, 5]].sum(1) > 0)[:, None]])


def _score(arcs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_features(arcs) @ weights, -30, 30)))


def _fit(arcs: np.ndarray, y: np.ndarray, pull: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to the prior weights."""
    x = _features(arcs)
    w = PRIOR.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * (w - PRIOR)
        hess = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """``doc_id, text, toxic`` of a bounded sample of labelled training rows (a hash orders
    the ids; one label and one text for each id, the greatest of each)."""
    known = (labels.filter("toxic is not null and doc_id is not null").filter(fold("doc_id", 3) != 1)
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # the documented bound of a broadcast
    return texts(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))


def learned_insults(sample: DataFrame, most: int) -> list[str]:
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)
    pair = F.explode(F.arrays_zip(F.col("w"), F.slice(F.concat(F.array(F.lit("")), F.col("w")), 1, F.size("w")).alias("p"))).alias("x")
    said = (sample.filter("text is not null").select("toxic", F.xxhash64("text").alias("d"), words.alias("w"))
            .select("toxic", "d", pair).select("toxic", "d", "x.w", "x.p").filter("length(w) > 2 and toxic in (0, 1)"))
    seen = said.groupBy("w", "p", "d", "toxic").agg(F.lit(1).alias("n"))  # repeats collapse before anything is counted
    by_context = seen.groupBy("w", "p").agg(F.max("toxic").alias("bad"), F.max(1 - F.col("toxic")).alias("good")).groupBy("w").agg(F.sum("bad").alias("cb"), F.sum("good").alias("cg"))
    by_document = seen.groupBy("w", "d").agg(F.max("toxic").alias("bad"), F.max(1 - F.col("toxic")).alias("good")).groupBy("w").agg(F.sum("bad").alias("db"), F.sum("good").alias("dg"))
    counts = by_context.join(by_document, "w").select("w", F.least("cb", "db").alias("bad"), F.least("cg", "dg").alias("good"))
    counts = materialize(counts.filter("w is not null"), "toxic_words")
    whole = counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    if not whole["bad"] or not whole["good"]:
        return []
    rate, n = whole["bad"] / (whole["bad"] + whole["good"]), F.col("bad") + F.col("good")
    share = F.col("bad") / n
    # Chernoff's bound of a binomial tail: n times the divergence of the share from the rate
    chance = -n * (share * F.log10(share / rate) + F.when(share < 1, (1 - share) * F.log10((1 - share) / (1 - rate))).otherwise(0.0))
    odd = counts.filter("bad > 0").filter((share >= PURE) & (chance <= CHANCE)).orderBy(chance, "w").limit(most)
    return [r["w"] for r in odd.select("w", chance.alias("chance")).orderBy("chance", "w").collect()]


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[dict[str, int], np.ndarray]:
    """Lexicon and arc weights."""
    sample = training_sample(docs, labels, sample_rows)
    lexicon = {w: LEARNED for w in learned_insults(sample, LEARNED_WORDS)} | seed_lexicon()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = Grammar(lexicon)
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "arcs": [g.arcs(t) for t in b["text"]]})

    seen = sample.select("toxic", "text").mapInPandas(count, "toxic int, arcs array<long>").toPandas()
    y = seen["toxic"].to_numpy(dtype=float)
    return lexicon, _fit(np.array(seen["arcs"].tolist()), y) if len(set(y)) > 1 else PRIOR


def scorer(lexicon: dict[str, int], weights: np.ndarray):
    """A column function: text to struct<score, n_clauses>."""

    @F.pandas_udf("score double, n_clauses long")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        g = Grammar(lexicon)
        for b in batches:
            arcs = np.array([g.arcs(t) for t in b]).reshape(-1, len(ARCS))
            yield pd.DataFrame({"score": _score(arcs, weights), "n_clauses": arcs[:, 7]})

    return score


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and ``n_clauses`` (clauses with a match) of every row."""
    rows = texts(docs).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), scorer(*learn(docs, labels, sample_rows))("text").alias("x"))
    return rows.select("doc_id", "held_out", "x.score", (F.col("x.score") >= threshold).cast("int").alias("predicted"), "x.n_clauses")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows whose text scores below ``threshold``; texts stay where they are, nothing is shuffled."""
    return docs.filter(scorer(*learn(docs, labels))(F.col("text").cast("string"))["score"] < threshold)
