"""Toxicity by a weighted finite-state pattern grammar over clauses.

Tokens become symbols (insult, threat, target, negator, reporter, other); a cascade of transducers rewrites them: negation weakens an
insult or threat shortly after a negator, reported speech weakens what follows a reporter in the clause, a target strengthens the clause.
The transducers are composed once into one machine. Insult words and word beginnings, and their weights, are learned from labels; a
logistic curve fitted on the same sample turns the sum of clause scores into a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pdpspark.llm.common import bound_batches, shingle_hashes, written

#: Bound of the labelled sample that lexicon and curve are learned from: rows of each class, by hash of the id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2500, 5000
#: Lengths of word beginnings that are tried as lexicon entries beside whole words (which end in $).
BEGINNINGS = range(3, 9)
MIN_DOCS, MIN_G2, MIN_WEIGHT, MAX_TERMS = 2, 16.0, 1.2, 2000
THRESHOLD = 0.3

#: Fixed word lists of the grammar.
NEGATORS = frozenset("not no never isn't aren't wasn't don't nicht kein keine jamais nunca".split())
REPORTERS = frozenset("said says say called calls wrote writes reported claims quoted sagte schrieb nannte dit écrit dijo escribió llamó".split())
TARGETS = frozenset("you your you're u he she they him her them du dich dir ihr euch sie tu te toi vous ils elle usted ustedes tú ellos".split())
THREATS = frozenset("kill hurt destroy beat stab shoot murder töten umbringen schlagen tuer frapper matar golpear".split())
THREAT_WEIGHT, TARGET_FACTOR, NEGATED_FACTOR, REPORTED_FACTOR = 1.5, 1.25, 0.6, 0.7
NEGATION_SPAN = 2

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.!?;:,\n]")


# -- transducers -----------------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Transducer:
    """step(state, symbol) -> (state, symbol); states and symbols are small and hashable, so a composition can be tabled."""

    start: object
    step: object


def negation() -> Transducer:
    def step(state: int, symbol: str) -> tuple[int, str]:
        if symbol == "N":
            return NEGATION_SPAN + 1, symbol
        return max(0, state - 1), symbol + "-" if state > 0 and symbol[0] in "IT" else symbol

    return Transducer(0, step)


def reported() -> Transducer:
    return Transducer(False, lambda state, symbol: (state or symbol == "R", symbol + "~" if state and symbol[0] in "IT" else symbol))


def target() -> Transducer:
    """Ends in True where the clause names a target; a threat without one says nothing before the end of the clause."""
    return Transducer(False, lambda state, symbol: (state or symbol == "P", symbol))


@dataclass
class Machine:
    """The composition of transducers, tabled as its (state, symbol) pairs are met."""

    parts: tuple[Transducer, ...] = field(default_factory=lambda: (negation(), reported(), target()))
    table: dict = field(default_factory=dict)

    def step(self, state: tuple, symbol: str) -> tuple[tuple, str]:
        found = self.table.get((state, symbol))
        if found is None:
            after, out = [], symbol
            for part, own in zip(self.parts, state, strict=True):
                own, out = part.step(own, out)
                after.append(own)
            found = self.table[state, symbol] = tuple(after), out
        return found

    def score(self, tokens: list[tuple[str, float]]) -> float:
        """Weight of a clause of (symbol, weight) tokens."""
        state, insults, threats = tuple(p.start for p in self.parts), 0.0, 0.0
        for symbol, weight in tokens:
            state, out = self.step(state, symbol)
            if out[0] in "IT":
                weight *= (NEGATED_FACTOR if "-" in out else 1.0) * (REPORTED_FACTOR if "~" in out else 1.0)
                if out[0] == "I":
                    insults += weight
                else:
                    threats += weight
        aimed = state[-1]
        return insults * (TARGET_FACTOR if aimed and insults else 1.0) + (threats if aimed else 0.0)


class Grammar:
    """Scores texts with a lexicon of word beginnings and whole words (ending in $)."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        import ahocorasick

        self.lexicon, self.machine, self.finder = lexicon, Machine(), ahocorasick.Automaton()
        for term in {*lexicon, *(f"{t}$" for t in THREATS)}:
            self.finder.add_word(term.rstrip("$"), len(term.rstrip("$")))
        self.finder.make_automaton()

    def symbol(self, word: str) -> tuple[str, float]:
        weight = self.lexicon.get(f"{word}$", 0.0)
        for n in BEGINNINGS:
            if n > len(word):
                break
            weight = max(weight, self.lexicon.get(word[:n], 0.0))
        if weight:
            return "I", weight
        if word in THREATS:
            return "T", THREAT_WEIGHT
        return ("N" if word in NEGATORS else "R" if word in REPORTERS else "P" if word in TARGETS else "o"), 0.0

    def clauses(self, text: str) -> Iterator[tuple[float, int]]:
        """Score and hits of each clause that holds a term at a word's beginning."""
        done = -1
        for end, size in self.finder.iter(text):
            start = end - size + 1
            if start < done or start and text[start - 1].isalpha():
                continue
            begin = max(text.rfind(c, max(done, 0), start) for c in ".!?;:,\n") + 1 or max(done, 0)  # no further back than the last clause
            stop = CLAUSE_END.search(text, end)
            done = stop.start() if stop else len(text)
            tokens = [self.symbol(w) for w in WORD.findall(text, begin, done)]
            hits = sum(s in "IT" for s, _ in tokens)
            if hits:
                yield self.machine.score(tokens), hits

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Sum of clause scores, of hits, and score per thousand words; each as log(1 + x)."""
        total = hits = 0.0
        if text:
            for score, n in self.clauses(text.lower()):
                total, hits = total + score, hits + n
        return math.log1p(total), math.log1p(hits), math.log1p(1000 * total / (1 + text.count(" "))) if total else 0.0


# -- learning --------------------------------------------------------------------------------------------------------------------

@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    weights: list[float]

    def scores(self, texts: Iterator[str | None], grammar: Grammar) -> list[float]:
        w = self.weights
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + sum(a * b for a, b in zip(w[1:], grammar.features(t), strict=True)))))) for t in texts]


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of at most SAMPLE_TOXIC + SAMPLE_CLEAN labelled documents, one of each group of likely copies."""
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for value, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        part = rows.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids
    found = found.withColumn("tokens", F.split(F.lower(F.coalesce("text", F.lit(""))), " "))  # a column of its own: split once a row
    alike = F.coalesce(F.array_min(shingle_hashes(F.col("tokens"))), F.xxhash64("text"))
    return written(found.withColumn("alike", alike).groupBy("alike").agg(F.min(F.struct("doc_id", "text", "toxic")).alias("first")).select("first.*"), "toxicity-sample")


def _lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms with their log odds: word beginnings and words that toxic documents hold significantly more often."""
    sizes = {bool(r.toxic): r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    if not bad or not good:
        return {}
    tokens = F.array_distinct(F.split(F.lower("text"), "[^\\p{L}]+"))
    terms = F.flatten(F.transform(tokens, lambda w: F.concat(F.array(F.concat(w, F.lit("$"))), F.filter(F.array(*[F.when(F.length(w) >= n, F.substring(w, 1, n)) for n in BEGINNINGS]), lambda t: t.isNotNull()))))
    counts = sample.select("toxic", F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    rate = (a + b) / (bad + good)
    g2 = 2 * (part(a, rate * bad) + part(b, rate * good) + part(bad - a, (1 - rate) * bad) + part(good - b, (1 - rate) * good))
    weight = F.log(((a + 0.5) / (bad + 1)) / ((b + 0.5) / (good + 1)))
    chosen = counts.where(F.length(F.rtrim("term")) > 3).where(a >= MIN_DOCS).withColumns({"g2": g2, "weight": weight}).where((F.col("g2") >= MIN_G2) & (F.col("weight") >= MIN_WEIGHT))
    return {r.term: r.weight for r in chosen.orderBy(F.desc("g2"), "term").limit(MAX_TERMS).collect()}


def _curve(rows: list[tuple[tuple[float, ...], int]]) -> list[float]:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.array([(1.0, *f) for f, _ in rows])
    y = np.array([t for _, t in rows], dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = 1e-2 * np.eye(len(w))
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += change
        if np.abs(change).max() < 1e-8:
            break
    return [float(v) for v in w]


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learns lexicon and curve from a bounded sample of labelled documents (labels: doc_id, toxic). Without both classes: all scores are 0."""
    sample = _sample(docs, labels)
    lexicon = _lexicon(sample)
    if not lexicon:
        return ToxicityModel({}, [-30.0, 0.0, 0.0, 0.0])

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(lexicon)
        for pdf in batches:
            yield pd.DataFrame([(*grammar.features(t), int(y)) for t, y in zip(pdf["text"], pdf["toxic"], strict=True)], columns=["a", "b", "c", "toxic"])

    rows = sample.mapInPandas(features, "a double, b double, c double, toxic int").collect()  # as many as the sample's bound
    return ToxicityModel(lexicon, _curve([((r.a, r.b, r.c), r.toxic) for r in rows]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from threshold on), read from the whole text alone.

    Null, empty and clean texts have the score of a text without a match. Rows stay as they are, repeated ones too, whatever their
    other columns hold; columns named score and predicted are replaced.
    """
    bound_batches(docs.sparkSession)

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grammar = Grammar(model.lexicon) if model.lexicon else None
        for part in texts:  # one text at a time leaves the batch
            yield pa.array(model.scores((t.as_py() for t in part), grammar) if grammar else [0.0] * len(part), pa.float64())

    scored = docs.drop("score", "predicted").withColumn("score", F.arrow_udf(score, "double")("text"))  # the text alone goes to Python, one number comes back
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
