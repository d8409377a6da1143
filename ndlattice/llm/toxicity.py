"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer maps words to classes: insults (stems with weights learned from labels),
threats, targets, negators, reporters.  Four small transducers read a clause's classes - one each
for insults, threats at a target, negation and reported speech - and are composed into one
machine whose best path weighs the clause.  Only clauses that the machine accepts count: an
insult, or a threat with a target.  A target raises an insult's weight; a negator up to three other
words before it or a reporting verb before it in the clause takes most of it away, so that a text
whose only insults are denied or quoted is not predicted as toxic.  A text's evidence is the sum
over its accepted clauses, turned into a probability by a logistic curve fitted on the labelled
rows.

Defined cases: a null or empty text has no clause and gets the curve's value at 0; without
labelled rows, or with labels of one kind only, there are no insults and the share of label 1
(0 if none) is the score of a text without evidence; repeated rows are scored one by one;
a document with labels of both kinds trains as toxic; null ids and labels other than 0 and 1 never
train; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD_OUT, chunks, fold, record

#: At most about so many labelled rows (those with the smallest hash of doc_id) train the lexicon and the curve.
TRAIN_ROWS = 20_000
#: Stems of these lengths are tried beside whole words.
STEMS = (3, 4, 5, 6)
#: An insult must occur in so many toxic texts, in such a share of them, between as many different neighbours, and so purely.
SUPPORT, SHARE, PURITY = 4, 0.004, 0.95
#: Weights of the grammar: of a target before and after an insult, of a threat at a target, of what a negator and a reporting verb take away.
TARGETED, AT, THREATENED, DENIED, REPORTED = 0.7, 0.1, 2.0, -6.0, -6.0

#: Fixed word classes of the grammar.
THREATS = ("kill", "hurt", "beat", "burn", "destroy", "shoot", "stab", "töten", "umbringen", "tuer", "matar")
TARGETS = ("you", "your", "yours", "yourself", "he", "him", "she", "her", "they", "them", "everyone", "dich", "euch", "toi", "vous", "usted", "ustedes")
NEGATORS = ("not", "never", "isn't", "aren't", "wasn't", "don't", "nicht", "kein", "nunca", "jamais")
REPORTERS = ("said", "says", "wrote", "quoted", "reported", "claimed", "sagte", "schrieb", "dijo", "disait")
OTHER, INSULT, THREAT, TARGET, NEGATOR, REPORTER = range(6)
_TOKEN = re.compile(r"\w+(?:'\w+)?|[.!?;\n]")
_ENDS = frozenset(".!?;\n")


class Transducer(NamedTuple):
    """Deterministic and complete: step[state][class] = (next state, weight); accepts: final states."""

    step: tuple[tuple[tuple[int, float], ...], ...]
    accepts: frozenset[int]


def machine(states: int, arcs: dict[tuple[int, int], tuple[int, float]], accepts: set[int]) -> Transducer:
    """Classes without an arc leave the state as it is, at no weight."""
    return Transducer(tuple(tuple(arcs.get((s, c), (s, 0.0)) for c in range(6)) for s in range(states)), frozenset(accepts))


def both(a: Transducer, b: Transducer, either: bool) -> Transducer:
    """Composition over the shared class tape: weights add; accepts where one (either) or both do."""
    n = len(b.step)
    step = tuple(tuple((x[0] * n + y[0], x[1] + y[1]) for x, y in zip(a.step[i], b.step[j], strict=True)) for i, j in itertools.product(range(len(a.step)), range(n)))
    join = any if either else all
    return Transducer(step, frozenset(i * n + j for i, j in itertools.product(range(len(a.step)), range(n)) if join((i in a.accepts, j in b.accepts))))


def grammar() -> Transducer:
    insult = machine(3, {(0, TARGET): (1, 0.0), (0, INSULT): (2, 0.0), (1, INSULT): (2, TARGETED), (2, TARGET): (2, AT)}, {2})
    threat = machine(4, {(0, THREAT): (1, 0.0), (0, TARGET): (2, 0.0), (1, TARGET): (3, THREATENED), (2, THREAT): (3, THREATENED)}, {3})
    # a negator is forgotten four other words later
    negation = machine(5, {(0, NEGATOR): (1, 0.0), **{(s, OTHER): ((s + 1) % 5, 0.0) for s in range(1, 5)}, **{(s, NEGATOR): (1, 0.0) for s in range(2, 5)}, **{(s, c): (0, DENIED) for s in range(1, 5) for c in (INSULT, THREAT)}}, {*range(5)})
    # a reporting verb is spent on the first insult or threat that it reports
    reported = machine(3, {(0, REPORTER): (1, 0.0), (1, INSULT): (2, REPORTED), (1, THREAT): (2, REPORTED)}, {0, 1, 2})
    return both(both(both(insult, threat, True), negation, False), reported, False)


class Scorer:
    """Lexicon, grammar and curve."""

    def __init__(self, stems: dict[str, float], words: dict[str, float], slope: float = 1.0, base: float = 0.0):
        self.stems, self.words, self.slope, self.base = stems, words, slope, base
        self.grammar = grammar()
        self.lengths = sorted({len(s) for s in stems})
        self.known: dict[str, tuple[int, float]] = {}

    def __getstate__(self):
        return self.stems, self.words, self.slope, self.base

    def __setstate__(self, state):
        self.__init__(*state)

    def look_up(self, word: str) -> tuple[int, float]:
        """Class and weight of a lower-case word; learned insults come before the fixed classes."""
        weight = self.words.get(word, 0.0)
        for n in self.lengths:
            if n > len(word):
                break
            weight = max(weight, self.stems.get(word[:n], 0.0))
        kind = INSULT if weight else next((k for k, own in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATOR, NEGATORS), (REPORTER, REPORTERS)) if word in own), OTHER)
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[word] = kind, weight
        return kind, weight

    def evidence(self, text: str | None) -> float:
        """Sum of the weights of the accepted clauses, none below 0."""
        if not text:
            return 0.0
        get, total = self.known.get, 0.0
        state, weight, step, accepts = 0, 0.0, self.grammar.step, self.grammar.accepts
        for word in _TOKEN.findall(text.lower()):
            if word in _ENDS:
                if state:
                    total += max(0.0, weight) if state in accepts else 0.0
                state, weight = 0, 0.0
                continue
            kind, more = get(word) or self.look_up(word)
            if kind or state:
                state, w = step[state][kind]
                weight += w + more
        return total + (max(0.0, weight) if state in accepts else 0.0)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.base + self.slope * math.log1p(evidence)))))


def _features(text: str) -> Iterator[tuple[str, str]]:
    """(feature, neighbours) of each word; stems end in a star."""
    found = [w for w in _TOKEN.findall(text.lower()) if w not in _ENDS]
    if not found:
        return
    for before, word, after in zip(["", *found[:-1]], found, [*found[1:], ""], strict=True):
        if len(word) > 2:
            around = f"{before} {after}"
            yield word, around
            for n in STEMS:
                if n < len(word):
                    yield f"{word[:n]}*", around


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Scorer:
    """Lexicon and curve from a bounded hash sample of the labelled rows outside the held-out fold.

    The features that reach the driver occur in at least SUPPORT toxic texts of that sample each, so it bounds their number.
    """
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not toxic or toxic == n:
        return Scorer({}, {}, 1.0, -40.0 if not toxic else 40.0)
    share = F.xxhash64("doc_id").bitwiseAND((1 << 30) - 1) / float(1 << 30)
    chosen = known.where(share < rows / n)
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (share < rows / n)).join(F.broadcast(chosen), "doc_id").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("feature", pa.string()), ("bad", pa.int64()), ("good", pa.int64())])
        for batch in batches:
            for part in chunks(batch, "text"):
                total: dict[str, list[int]] = {"": [0, 0]}
                for text, bad in zip(part["text"], part["toxic"], strict=True):
                    total[""][1 - bad] += 1
                    for f in {f for f, _ in _features(text)}:
                        total.setdefault(f, [0, 0])[1 - bad] += 1
                yield record(schema, {"feature": [*total], "bad": [x[0] for x in total.values()], "good": [x[1] for x in total.values()]})

    counts = sample.mapInArrow(count, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    need = max(SUPPORT, SHARE * toxic * min(1.0, rows / n))
    pure = counts.where((F.col("feature") == "") | ((F.col("bad") >= need) & (F.col("bad") >= PURITY * (F.col("bad") + F.col("good")))))
    found = {r["feature"]: (r["bad"], r["good"]) for r in pure.collect()}
    all_bad, all_good = found.pop("", (0, 0))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("feature", pa.string()), ("around", pa.string())])
        for batch in batches:
            for part in chunks(batch, "text"):
                seen = sorted({x for t in part["text"] for x in _features(t) if x[0] in found})
                yield record(schema, {"feature": [x[0] for x in seen], "around": [x[1] for x in seen]})

    # copies of one text share a word's neighbours, so what only one copied text says has one context
    around = sample.where("toxic = 1").select("text").mapInArrow(contexts, "feature string, around string").distinct().groupBy("feature").count()
    varied = {r["feature"] for r in around.where(F.col("count") >= need).collect()}
    weigh = lambda bad, good: min(6.0, math.log((bad + 0.5) / (all_bad + 1)) - math.log((good + 0.5) / (all_good + 1)))
    # the shortest pure stem shows where an insult begins; the longest form that nearly all its texts share is what it is
    stems: dict[str, float] = {}
    words: dict[str, float] = {}
    for f in sorted(varied, key=lambda f: (len(f), f)):
        start = f.rstrip("*")
        if any(start[:n] in stems for n in range(1, len(start) + 1)) or start in words:
            continue
        longest = max((g for g in varied if g.startswith(start) and found[g][0] >= 0.9 * found[f][0]), key=lambda g: (len(g.rstrip("*")), g))
        (stems if longest.endswith("*") else words)[longest.rstrip("*")] = weigh(*found[longest])
    scorer = Scorer(stems, words)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("evidence", pa.float64()), ("toxic", pa.int32())])
        for batch in batches:
            for part in chunks(batch, "text"):
                yield record(schema, {"evidence": [round(scorer.evidence(t), 1) for t in part["text"]], "toxic": part["toxic"]})

    seen = sample.mapInArrow(judge, "evidence double, toxic int").groupBy("evidence", "toxic").count().collect()
    x, y, m = (np.array([r[k] for r in seen], float) for k in ("evidence", "toxic", "count"))
    scorer.slope, scorer.base = curve(np.log1p(x), y, m)
    return scorer


def curve(x: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple[float, float]:
    """Slope and base of a logistic curve by Newton's method with a small ridge."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.array([0.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w + np.linalg.solve((a * (m * p * (1 - p))[:, None]).T @ a + np.eye(2), a.T @ (m * (y - p)) - w)
    return float(w[0]), float(w[1])


SCORE = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.3) -> DataFrame:
    """SCORE for every row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                said = [scorer.probability(scorer.evidence(t)) for t in part["text"]]
                yield record(schema, {"doc_id": part["doc_id"], "held_out": part["held_out"], "score": said, "predicted": [int(s >= threshold) for s in said]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(judge, SCORE)
