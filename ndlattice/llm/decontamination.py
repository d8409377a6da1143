"""Benchmark decontamination by spaced seeds.

A mask of fixed length reads some of the word positions under it and ignores the others, so a
window keeps its hash when an ignored word is replaced.  Test windows are hashed under every
mask; training windows are joined to them by hash; and each hit is verified along its diagonal:
some stretch of agreeing words, substitutions allowed but charged, must be long enough.

The benchmark is the stated query set.  It is joined in blocks of bounded text, each broadcast
and met with all training rows, so the training texts are never shuffled.

Defined cases: null and empty texts on either side match nothing; an item shorter than the masks
matches only as a whole and verbatim; repeated training rows each give their rows, equal rows of
the benchmark count once, one text under several ids is an item of each; null ids are kept; empty tables give no rows; other columns are ignored (and kept by ``clean``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, record

#: Fixed masks: 1 reads a word, 0 ignores it.
MASKS = ("110110011", "101110101", "111001011", "110101110")
#: A leak agrees in so many words (or in all words of a shorter item) at this share of its stretch.
LEAST_WORDS, LEAST_SHARE = 10, 0.75
#: Words under a mask.
SPAN = len(MASKS[0])
#: Characters of benchmark text in one block; a block is what is broadcast at once.
BLOCK_CHARS = 8_000_000
_WORD = re.compile(r"\w+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD], np.uint64)
Leak = tuple[int, int, int, int]  # item's place, first word in the document, words agreeing, words of the stretch


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def window_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each window of the word ids."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, j in enumerate(j for j, c in enumerate(mask) if c == "1"):
        total = (total ^ ids[j : j + n]) * _MIX[k % 6]
        total ^= total >> np.uint64(32)
    return total


def fresh(hashes: np.ndarray, span: int) -> np.ndarray:
    """Places whose hash does not stand up to span places before: of a run that repeats itself the start.

    Shifts by a run's period lay equal words over each other, so its start stands for them all, and
    the windows across its ends have hashes of their own.
    """
    new = np.ones(len(hashes), bool)
    for p in range(1, min(span, len(hashes) - 1) + 1):
        new[p:] &= hashes[p:] != hashes[:-p]
    return new


class Index:
    """Hashes of a benchmark block under every mask, and its texts as word ids."""

    def __init__(self, texts: list[str | None], masks: tuple[str, ...] = MASKS, least: int = LEAST_WORDS, share: float = LEAST_SHARE):
        self.masks, self.least, self.share = masks, least, share
        items = [words(t) for t in texts]
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for x in items for w in x}))}  # 0: not a benchmark word
        self.items = [np.array([self.ids[w] for w in x], np.uint64) for x in items]
        self.span = max(map(len, masks))
        self.seeds = []
        for mask in masks:
            found = [(window_hashes(x, mask), i) for i, x in enumerate(self.items)]
            self.seeds.append((mask, *self._sorted(found)))
        short = sorted({len(x) for x in self.items if 0 < len(x) < self.span})
        for n in short:  # items that no mask fits: all words count
            self.seeds.append(("1" * n, *self._sorted([(window_hashes(x, "1" * n), i) for i, x in enumerate(self.items) if len(x) == n])))

    @staticmethod
    def _sorted(found: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, items and places by hash, and a bitmap of the low hash bits."""
        if not found:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1 << 20, bool)
        keep = [np.flatnonzero(fresh(h, SPAN)) for h, _ in found]
        hashes = np.concatenate([h[k] for (h, _), k in zip(found, keep, strict=True)])
        order = np.argsort(hashes, kind="stable")
        bitmap = np.zeros(1 << 20, bool)
        bitmap[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return hashes[order], np.concatenate([np.full(len(k), i) for (_, i), k in zip(found, keep, strict=True)])[order], np.concatenate(keep)[order], bitmap

    def leaks(self, texts: list[str | None]) -> list[list[Leak]]:
        """For each text its verified overlaps, the best one of each item, by item."""
        out: list[list[Leak]] = [[] for _ in texts]
        get, ids, starts = self.ids.get, [], []
        pad = [0] * self.span
        for t in texts:
            starts.append(len(ids))
            ids += [get(w, 0) for w in words(t)]
            ids += pad
        a, begin, ends = np.array(ids, np.uint64), np.array(starts), np.array([*starts[1:], len(ids)]) - self.span
        tried: set[tuple[int, int, int]] = set()
        best: dict[tuple[int, int], Leak] = {}
        for mask, hashes, items, places, bitmap in self.seeds:
            own = window_hashes(a, mask)
            maybe = np.flatnonzero(bitmap[(own & np.uint64((1 << 20) - 1)).astype(np.int64)])
            again = np.zeros(len(maybe), bool)
            for p in range(1, SPAN + 1):
                again |= (maybe >= p) & (own[maybe] == own[maybe - p])
            maybe = maybe[~again]
            lo, hi = np.searchsorted(hashes, own[maybe], "left"), np.searchsorted(hashes, own[maybe], "right")
            for at, s, e in zip(maybe[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                d = int(np.searchsorted(begin, at, "right")) - 1
                for k in range(s, e):
                    item, shift = int(items[k]), at - int(places[k])
                    if (d, item, shift) in tried:
                        continue
                    tried.add((d, item, shift))
                    leak = self.verify(a, item, shift, int(begin[d]), int(ends[d]))
                    if leak and ((d, item) not in best or (leak[2], -leak[1]) > (best[d, item][2], -best[d, item][1])):
                        best[d, item] = leak
        for (d, _), leak in sorted(best.items()):
            out[d].append(leak)
        return out

    def verify(self, a: np.ndarray, item: int, shift: int, begin: int, end: int) -> Leak | None:
        """Best stretch of the item laid over the document at this shift: agreeing words count 1, others -1.

        Where that one breaks a rule, of all stretches that keep both rules the one of most agreeing words.
        """
        x = self.items[item]
        s, e = max(shift, begin), min(shift + len(x), end)
        if e <= s:
            return None
        same = a[s:e] == x[s - shift : e - shift]
        least = min(self.least, len(x))
        if np.count_nonzero(same) < least:
            return None
        agreed, at = np.concatenate([[0], np.cumsum(same)]), np.arange(len(same) + 1)
        runs = 2 * agreed - at
        low = np.minimum.accumulate(runs)
        stop = int((runs - low).argmax())
        start = int(runs[: stop + 1].argmin())
        agree = int(agreed[stop] - agreed[start])
        if agree < least or agree < self.share * (stop - start):
            over = agreed - self.share * at  # a stretch has its share if this is no lower at its end than at its start
            highest = np.maximum.accumulate(over[::-1])
            farthest = len(same) - np.searchsorted(highest, over - 1e-9)
            agrees = agreed[farthest] - agreed
            agree = int(agrees.max())
            if agree < least:
                return None
            start = int(agrees.argmax())
            stop = int(np.searchsorted(agreed, agreed[farthest[start]]))
            start = int(np.searchsorted(agreed, agreed[start], "right")) - 1
        return item, s + start - begin, agree, stop - start


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """(item_id, text) of the benchmark in blocks of about so many characters."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("length(text) > 0").distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // most)
    for i in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) if parts > 1 else rows
        yield sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda x: (x[0] is None, x))


LEAKS = "doc_id long, item_id long, first_word long, n_agree long, n_words long, item_words long"


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """LEAKS: one row for each document and each item that it holds a passage of."""
    spark = docs.sparkSession
    schema = pa.schema([(k, pa.int64()) for k in ("doc_id", "item_id", "first_word", "n_agree", "n_words", "item_words")])
    out = None
    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast((Index([t for _, t in block]), [i for i, _ in block]))

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, names = shared.value
            for batch in batches:
                for part in chunks(batch, "text"):
                    rows = [(doc, names[i], at, agree, n, len(index.items[i])) for doc, leaks in zip(part["doc_id"], index.leaks(part["text"]), strict=True) for i, at, agree, n in leaks]
                    yield record(schema, {f.name: [r[j] for r in rows] for j, f in enumerate(schema)})

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(look, LEAKS)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], LEAKS) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, with all their columns, without the rows that hold a passage of an item."""
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Index([t for _, t in block]))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for part in chunks(batch, "text"):
                    leaks = shared.value.leaks(part["text"])
                    yield batch.slice(at, len(leaks)).filter(pa.array([not x for x in leaks], pa.bool_()))
                    at += len(leaks)

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
