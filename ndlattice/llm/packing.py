"""Best-fit packing of token sequences by length patterns and non-negative least squares.

Only a histogram of piece lengths (as many numbers as a sequence has tokens) reaches the driver.
There, patterns of two or three lengths that fill a sequence exactly are enumerated, their repeat
counts are fitted to the histogram by non-negative least squares and rounded down, and the pieces
left over are packed by best fit, again length by length.  The plan says for the k-th piece of a
length which sequence and offset it gets; the executors number the pieces of a length and look
their places up.

Defined cases: a null or empty text is the end token alone; the text of a token that the file adds
to its vocabulary (``<|endoftext|>``) is that token, as ``tokenizers`` reads it; white space runs
of any length are encoded whole; an empty table gives no rows; pieces of one length are numbered
inside shares of the written rows, so repeated rows share their places out among themselves
whichever way; a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import chunks, record, settled, shuffle_width

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Split of a byte-level BPE's text into words: fixed by the vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: tiktoken's matcher keeps a stack frame for each blank of a run and fails beyond some 900,000; texts with longer runs than this go through tokenizers.
LONG_RUN = 100_000
_BLANKS = re.compile(r"\s+")
_LOADED: dict[str, Vocabulary] = {}


class Vocabulary:
    """A byte-level BPE file of tokenizers, run by tiktoken, which gives the same ids several times faster."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.added = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in self.added}
        self.fast = tiktoken.Encoding("pack", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=self.added)
        self.names = set(self.added)
        self.path = path

    def encode(self, text: str) -> list[int]:
        """The ids of tokenizers without added start and end tokens; the text of an added token is that token."""
        if len(text) >= LONG_RUN and max(map(len, _BLANKS.findall(text)), default=0) >= LONG_RUN:
            return Tokenizer.from_file(self.path).encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special=self.names, disallowed_special=())


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def cuts(n: int, width: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones behind a first one that takes the remainder."""
    first = n % width or min(n, width)
    return [(0, first), *((at, width) for at in range(first, n, width))]


def pieces(docs: DataFrame, path: str, width: int = 1024, end: int = 2) -> DataFrame:
    """Token pieces of every document: PIECES."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(path).encode
        for batch in batches:
            for part in chunks(batch, "text"):
                out: dict[str, list] = {f.name: [] for f in schema}
                for doc, text in zip(part["doc_id"], part["text"], strict=True):
                    ids = encode(text or "")
                    ids.append(end)
                    raw = np.array(ids, "<u4").tobytes()
                    for i, (start, n) in enumerate(cuts(len(ids), width)):
                        for k, v in zip(out, (doc, i, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)])), strict=True):
                            out[k].append(v)
                yield record(schema, out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def patterns(width: int, lengths: list[int]) -> np.ndarray:
    """Pairs and triples of the lengths at hand that fill a sequence exactly, padded by 0, longest length first."""
    have, out = set(lengths), []
    for a in lengths:
        rest = width - a
        if 0 < rest <= a and rest in have:
            out.append((a, rest, 0))
        out += [(a, b, rest - b) for b in lengths if b <= a and 0 < rest - b <= b and rest - b in have]
    return np.array(out, np.int64).reshape(-1, 3)


def fit(made: np.ndarray, histogram: np.ndarray, steps: int = 200) -> np.ndarray:
    """Non-negative least squares: repeat counts x >= 0 least in |A x - histogram|, by accelerated projected gradient.

    A is never formed: a pattern adds one to each of its lengths, so A x is a weighted count.
    """
    width, slots = len(histogram), made.ravel()
    used = slots > 0
    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(slots[used], np.repeat(x, 3)[used], width)
    def back(r: np.ndarray) -> np.ndarray:
        return np.where(made > 0, r[made], 0).sum(1)
    v = np.ones(len(made))
    norm = 1.0
    for _ in range(20):
        v = back(times(v))
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    x = y = np.zeros(len(made))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(times(y) - histogram) / (1.01 * norm))
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (was - 1) / t * (new - x)
    return x


def best_fit(left: dict[int, int], width: int) -> dict[tuple[int, ...], int]:
    """Best fit, longest first, of left[length] pieces; whole runs of equal bins move at once."""
    bins: dict[int, dict[tuple[int, ...], int]] = {}  # free space -> bins by content
    for n in sorted(left, reverse=True):
        count = left[n]
        while count > 0:
            space = min((s for s in bins if s >= n and bins[s]), default=None)
            if space is None:
                each = min(width // n, count)
                runs, held, count = {(n,) * each: count // each}, width - n * each, count % each
            else:
                held, runs = space - n, {}
                for content in list(bins[space]):
                    if not count:
                        break
                    took = min(count, bins[space][content])
                    bins[space][content] -= took
                    if not bins[space][content]:
                        del bins[space][content]
                    runs[(*content, n)] = took
                    count -= took
                if not bins[space]:
                    del bins[space]
            own = bins.setdefault(held, {})
            for content, m in runs.items():
                own[content] = own.get(content, 0) + m
    out: dict[tuple[int, ...], int] = {}
    for own in bins.values():
        for content, m in own.items():
            out[content] = out.get(content, 0) + m
    return out


def plan(histogram: dict[int, int], width: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) that hold every piece of the histogram once."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out: list[tuple[tuple[int, ...], int]] = []
    if full := left.pop(width, 0):
        out.append(((width,), full))
    made = patterns(width, sorted(left, reverse=True))
    if len(made):
        counts = np.zeros(width + 1)
        for n, c in left.items():
            counts[n] = c
        wanted = fit(made, counts)
        for i in np.argsort(-wanted, kind="stable"):
            if wanted[i] < 0.3:
                break
            content = tuple(int(n) for n in made[i] if n)
            most = min(left.get(n, 0) // content.count(n) for n in content)
            if (times := min(int(wanted[i] + 0.7), most)) > 0:
                out.append((content, times))
                for n in content:
                    left[n] -= times
    return out + sorted(best_fit({n: c for n, c in left.items() if c}, width).items())


def places(found: list[tuple[tuple[int, ...], int]], width: int) -> dict[str, np.ndarray]:
    """For each length, runs of consecutive pieces: key (length and first number), first sequence, offset; sorted by key."""
    taken, rows, sequence = [0] * (width + 1), [], 0
    for content, times in found:
        offset = 0
        for n in content:
            rows.append((n, taken[n], sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 44) | a[:, 1], "first": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def pack(cut: DataFrame, width: int = 1024) -> DataFrame:
    """sequence_id and offset for every piece (a DataFrame with the columns PIECES)."""
    spark = cut.sparkSession
    cut = settled(cut)
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = spark.sparkContext.broadcast(places(plan(histogram, width), width))
    # a length may hold most pieces: they are numbered in shares, two for each task, and each share starts where the last one ended;
    # the rows were written above, so a row's place in them, which also splits equal rows, stays the same when a task is run again
    share = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2 * shuffle_width(spark)))
    cut = cut.withColumn("share", share)
    sizes = cut.groupBy("length", "share").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "share", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "start", "ids_crc32"))
    numbered = cut.withColumn("own", own).join(starts, ["length", "share"])
    rows = numbered.select(*cut.columns[:5], (F.col("own") + F.col("before") - 1).alias("number"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = where.value
        for batch in batches:
            length, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(runs["key"], (length << 44) | number, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(runs["sequence"][at] + number - runs["first"][at]), pa.array(runs["offset"][at])], schema=schema)

    return rows.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, width: int = 1024, end: int = 2) -> DataFrame:
    return pack(pieces(docs, path, width, end), width)
