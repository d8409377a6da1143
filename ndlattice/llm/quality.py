"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every text.  Only the counts of the vote
patterns over all documents (at most 3 to the number of labellers) reach the driver, where
expectation-maximisation estimates each labeller's accuracy and the posterior of every pattern.
Those posteriors label a bounded hash sample, on which a hashed linear scorer is trained; the
scorer then judges every whole text.

Defined cases: null and empty texts (no word) are bad, with score 0; an empty table gives no rows;
if no labeller ever votes, posteriors stay at the prior; repeated rows and null ids are judged one
by one; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, record

#: At most about so many documents (those with the smallest hash of doc_id) train the scorer.
TRAIN_ROWS = 4000
DIM = 1 << 15
BAD, GOOD, ABSTAIN = 0, 1, 2
#: Share of good texts before any vote; kept even, or labellers that never overlap could argue each other away.
PRIOR = 0.5
_PLAIN = re.compile(r"[\w\s.,;:'\"()\-]+")


WINDOW = 5  # words of a window


def looping(tokens: list[str]) -> float:
    """Share of a text's windows of WINDOW words that stood before in it, however long it is; 0 below 50 words."""
    n = len(tokens) - WINDOW + 1
    # a text of many different words has few repeated windows; n distinct windows hold at most n + WINDOW - 1 distinct words
    if len(tokens) < 50 or len(set(tokens)) > 0.8 * len(tokens):
        return 0.0
    return 1 - len(set(zip(*(tokens[i:] for i in range(WINDOW)), strict=False))) / n


def votes(text: str, tokens: list[str], loops: float) -> tuple[int, ...]:
    """One vote of each labeller on a text with at least one token; loops: its looping(tokens).

    Each labeller but the last two knows one kind of junk and abstains where it sees none; those two know plain prose.
    """
    n, chars = len(tokens), len(text)
    repeats = sum(map(str.__eq__, tokens, tokens[1:])) / n
    symbols = len(_PLAIN.sub("", text)) / chars
    ends = (text.count(". ") + text.count(".\n") + text.endswith(".")) / n
    shouted = sum(map(str.isupper, tokens)) / n
    bad = lambda x: BAD if x else ABSTAIN
    good = lambda x: GOOD if x else ABSTAIN
    return (
        bad(repeats >= 0.3),
        bad(symbols >= 0.06),
        bad(shouted >= 0.5),
        bad(text.count("!") >= 0.3 * n),
        bad(text.count("|") >= 0.2 * n),
        bad(loops >= 0.5),
        bad(n < 4),
        good(n >= 8 and repeats <= 0.05 and loops <= 0.2 and symbols <= 0.03 and shouted <= 0.15 and text.count("|") <= 0.02 * n),
        good(0.01 <= ends <= 0.4 and symbols <= 0.03 and repeats <= 0.1 and loops <= 0.2),
    )


LABELLERS = 9


class LabelModel:
    """How often each labeller is right when it votes, by expectation-maximisation over counted vote patterns."""

    def __init__(self, counts: dict[tuple[int, ...], int], steps: int = 60):
        self.prior, self.accuracy = PRIOR, np.full(LABELLERS, 0.85)
        if not counts:
            return
        patterns = np.array(sorted(counts), int).reshape(-1, LABELLERS)
        m = np.array([counts[tuple(p)] for p in patterns.tolist()], float)[:, None]
        for _ in range(steps):
            p = self._posterior(patterns)[:, None]
            right = m * np.where(patterns == GOOD, p, np.where(patterns == BAD, 1 - p, 0))
            votes = (m * (patterns != ABSTAIN)).sum(0)
            self.accuracy = np.clip((right.sum(0) + 8.5) / (votes + 10), 0.55, 0.995)

    def _posterior(self, patterns: np.ndarray) -> np.ndarray:
        weight = np.log(self.accuracy / (1 - self.accuracy))
        odds = np.log(self.prior / (1 - self.prior)) + (np.where(patterns == GOOD, 1, np.where(patterns == BAD, -1, 0)) * weight).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def posterior(self, pattern: tuple[int, ...]) -> float:
        return float(self._posterior(np.array([pattern]))[0])


def _shape(token: str) -> str:
    out = ""
    for c in token[:40]:
        s = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out.endswith(s):
            out += s
        if len(out) == 8:
            break
    return out


def places(token: str) -> tuple[int, int]:
    """Hashed features of a token: its shape, and itself."""
    return zlib.crc32(b"s" + _shape(token).encode("utf-8", "surrogatepass")) % DIM, zlib.crc32(b"w" + token.lower().encode("utf-8", "surrogatepass")) % DIM


REPEAT, LOOP = DIM, DIM + 1  # places of the shares of tokens that repeat the one before, and of windows that stood before


class Scorer:
    def __init__(self, weights: np.ndarray, base: float):
        self.weights, self.base = weights, base
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.weights, self.base

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, tokens: list[str], loops: float) -> float:
        if not tokens:
            return 0.0
        if len(self.known) > 500_000:
            self.known.clear()
        get, total = self.known.get, 0.0
        for token, n in Counter(tokens).items():
            w = get(token)
            if w is None:
                w = self.known[token] = float(sum(self.weights[i] for i in places(token)))
            total += n * w
        z = self.base + (total + self.weights[REPEAT] * sum(map(str.__eq__, tokens, tokens[1:]))) / len(tokens) + self.weights[LOOP] * loops
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(rows: list[tuple[list[int], list[float], float]], steps: int = 120) -> Scorer:
    """Logistic regression on (places, shares, wanted probability) by AdaGrad over all rows."""
    if not rows:
        return Scorer(np.zeros(DIM + 2), 2.0)
    at = np.concatenate([np.array(r[0], np.int64) for r in rows])
    x = np.concatenate([np.array(r[1]) for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    w, g, base, gb = np.zeros(DIM + 2), np.full(DIM + 2, 1e-8), 1.0, 1e-8
    for _ in range(steps):
        z = base + np.bincount(owner, w[at] * x, len(rows))
        error = y - 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        step = np.bincount(at, error[owner] * x, DIM + 2) / len(rows) - 1e-6 * w
        g += step**2
        w += 0.5 * step / np.sqrt(g)
        gb += error.mean() ** 2
        base += 0.1 * error.mean() / gb**0.5
    return Scorer(w, float(base))


def learn(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[LabelModel, Scorer]:
    """The label model from all documents, the scorer from a bounded sample."""
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                if tokens := (text.as_py() or "").split():
                    total[votes(text.as_py(), tokens, looping(tokens))] += 1
        yield record(pa.schema([("votes", pa.string()), ("n", pa.int64())]), {"votes": ["".join(map(str, v)) for v in total], "n": [*total.values()]})

    counted = docs.select("text").mapInArrow(vote, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    model = LabelModel({tuple(map(int, r["votes"])): r["n"] for r in counted})
    n = sum(r["n"] for r in counted)
    share = F.xxhash64("doc_id", F.length("text")).bitwiseAND((1 << 30) - 1) / float(1 << 30)
    # rows of one id and length are in or out together: equal ones train once
    sample = docs.where(share < rows / max(n, 1)).select("doc_id", "text").distinct().select("text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("at", pa.list_(pa.int64())), ("x", pa.list_(pa.float64())), ("y", pa.float64())])
        for batch in batches:
            out: dict[str, list] = {"at": [], "x": [], "y": []}
            for text in batch.column(0):
                if tokens := (text.as_py() or "").split():
                    own, loops = Counter(), looping(tokens)
                    for token, m in Counter(tokens).items():
                        for i in places(token):
                            own[i] += m / len(tokens)
                    own[REPEAT] = sum(map(str.__eq__, tokens, tokens[1:])) / len(tokens)
                    own[LOOP] = loops
                    for k, v in zip(out, ([*own], [*own.values()], model.posterior(votes(text.as_py(), tokens, loops))), strict=True):
                        out[k].append(v)
            yield record(schema, out)

    seen = sample.mapInArrow(describe, "at array<long>, x array<double>, y double").collect()
    return model, fit([(r["at"], r["x"], r["y"]) for r in seen])


SCORE = "doc_id long, score double, posterior double, keep boolean"


def score(docs: DataFrame, model: LabelModel, scorer: Scorer, threshold: float = 0.35) -> DataFrame:
    """SCORE for every row of docs: the scorer's probability of good, the labellers' posterior, and the decision."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("posterior", pa.float64()), ("keep", pa.bool_())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, ...], float] = {}
        for batch in batches:
            for part in chunks(batch, "text"):
                out: dict[str, list] = {f.name: [] for f in schema}
                for doc, text in zip(part["doc_id"], part["text"], strict=True):
                    tokens = (text or "").split()
                    loops = looping(tokens)
                    said, posterior = scorer.score(tokens, loops), 0.0
                    if tokens:
                        pattern = votes(text, tokens, loops)
                        posterior = known[pattern] if pattern in known else known.setdefault(pattern, model.posterior(pattern))
                    for k, v in zip(out, (doc, said, posterior, said >= threshold), strict=True):
                        out[k].append(v)
                yield record(schema, out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, SCORE)
