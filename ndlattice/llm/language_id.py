"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent letter n-grams (one to three letters, words
padded by a blank), most frequent first.  A word is a run of letters and the marks that combine with
them; digits, fractions, numerals and signs part words.  A document's own list is compared to each profile by
the out-of-place distance: the sum over the document's n-grams of how far the ranks lie apart,
with the profile's size for an n-gram that the profile lacks.

Defined cases: text that is null or has no letter -> ``und`` with score 0; no training rows ->
every text is ``und``; ties in frequency go by code point, ties in distance to the language that
sorts first; repeated rows are judged one by one; a null doc_id is kept and held out; all other
columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HELD_OUT, chunks, fold, record

#: n-grams in a profile and in a document's list.
PROFILE = 400
#: At most about so many training documents of each language (those with the smallest hash of doc_id) shape its profile.
TRAIN_PER_LANG = 1500
UND = "und"

#: Characters in which the plain expression for letters errs: numerals that are no digits, and marks that combine with letters.
_ODD = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal() or unicodedata.category(c)[0] == "M")
_PLAIN = re.compile(r"[^\W\d_]+")
_BITS = 21
_BLANK = ord(" ")


def words(text: str) -> list[str]:
    """Runs of letters and of the marks that combine with them; a run of marks alone is none."""
    if _ODD.isdisjoint(text):
        return _PLAIN.findall(text)
    kept = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in text)
    return [w for w in kept.split() if any(map(str.isalpha, w))]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram keys of a text and their counts; empty if it has no letter."""
    found = words(text.lower())
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.frombuffer(f" {' '.join(found)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    two = (a[:-1] << _BITS) | a[1:]
    three = (two[:-1] << _BITS) | a[2:]
    keys = np.concatenate([a[a != _BLANK], two, three[a[1:-1] != _BLANK]])
    return np.unique(keys, return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    return keys[np.lexsort((keys, -counts))[:size]]


class Profiles:
    """Ranks of every profile's n-grams, one column for each language."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.keys = np.unique(np.array([k for p in profiles.values() for k in p], np.int64))
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            own = np.array(profiles[lang], np.int64)
            self.ranks[np.searchsorted(self.keys, own), j] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = grams(text or "")
        if not len(keys) or not self.langs:
            return UND, 0.0
        own = ranked(keys, counts, self.size)
        at = np.searchsorted(self.keys, own)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != own)] = len(self.keys)
        theirs = self.ranks[at]
        apart = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(own))[:, None])).sum(0)
        best = int(apart.argmin())
        return self.langs[best], float(1 - apart[best] / (self.size * len(own)))


def learn(docs: DataFrame, size: int = PROFILE, per_lang: int = TRAIN_PER_LANG) -> Profiles:
    """Profiles from text and lang of the rows outside the held-out fold.

    The executors count n-grams of a bounded hash sample of each language; only the top lists,
    ``size`` numbers a language, reach the driver.
    """
    known = docs.select("doc_id", "text", "lang").where((fold(F.col("doc_id")) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.xxhash64("doc_id").bitwiseAND((1 << 30) - 1) / float(1 << 30)
    sample = known.join(F.broadcast(rows), "lang").where(share * F.col("n") < per_lang).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            for part in chunks(batch, "text"):
                for lang, text in zip(part["lang"], part["text"], strict=True):
                    own = total.setdefault(lang, {})
                    for k, n in zip(*(x.tolist() for x in grams(text)), strict=True):
                        own[k] = own.get(k, 0) + n
        out = [(lang, k, n) for lang, own in total.items() for k, n in own.items()]
        schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
        for i in range(0, len(out), 50_000):
            yield record(schema, dict(zip(schema.names, map(list, zip(*out[i : i + 50_000], strict=True)), strict=True)))

    sums = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for lang, gram in sums.select("lang", "gram", rank.alias("at")).where(F.col("at") <= size).orderBy("lang", "at").select("lang", "gram").collect():
        profiles.setdefault(lang, []).append(gram)
    return Profiles(profiles, size)


def identify(docs: DataFrame, model: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                said = [model.predict(t) for t in part["text"]]
                yield record(schema, {"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": [x[0] for x in said], "score": [x[1] for x in said]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(judge, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Profiles, min_score: float = 0.02) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language: not ``und`` and not as far from every profile as a text can be."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = 0, pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index("text"))], names=["text"])
            for part in chunks(texts, "text"):
                kept = [lang != UND and score >= min_score for lang, score in map(model.predict, part["text"])]
                yield batch.slice(at, len(kept)).filter(pa.array(kept, pa.bool_()))
                at += len(kept)

    return docs.mapInArrow(keep, docs.schema)
