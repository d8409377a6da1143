"""Jaccard self-join of documents on word n-grams by MinHash banding.

Texts with one set of n-grams form a node.  Bands of MinHash rows, their number and height chosen
for a target recall at the threshold, put nodes into buckets.  A bucket is cut into blocks of
bounded size, by nodes and by n-grams, and a task sees one pair of blocks at a time, so no group is
ever gathered whole.  A pair counts in the first band whose bucket it shares, and only nodes with
such a pair are sent on, with one text each, to be verified on their full n-gram sets.  A task
returns each node's number of links and a spanning forest of the linked nodes, never the pairs
themselves; groups are the connected components of those forests.  Exact link counts ask for every
pair of a group once: the work of a group of m nodes grows with m^2, its shuffle with m^2 / BLOCK.

Defined cases: a text of fewer words than n has one n-gram, all its words; texts without a word
(null, empty) share the empty set: they are one class and link to nothing; equal rows (of one
doc_id and text, told apart by a 128-bit hash) are copies; a null doc_id is kept; of a group's
documents the smallest doc_id stays (null last), of equal rows one; other columns pass through
untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import look_up, record, settled

N, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Nodes of one bucket that meet in a task are two blocks of about so many, with about so many n-grams in all.
BLOCK, BLOCK_NGRAMS = 256, 2_000_000
_WORD = re.compile(r"\w+")
_HASHES: dict[str, int] = {}
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93], np.uint64)


def bands_for(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the tallest bands that find a pair at the threshold with the wanted probability, of at most so many hashes."""
    best = (most, 1)
    for rows in range(1, 17):
        bands = next((b for b in range(1, most // rows + 1) if 1 - (1 - threshold**rows) ** b >= recall), None)
        if bands:
            best = (bands, rows)
    return best


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    if len(_HASHES) > 100_000:
        _HASHES.clear()
    get, ids = _HASHES.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _HASHES[w] = xxhash.xxh64_intdigest(w)
        ids.append(h)
    a = np.array(ids, np.uint64)
    n = min(n, len(a))
    total = np.full(len(a) - n + 1, n, np.uint64)
    for j in range(n):
        total = (total ^ (a[j : len(a) - n + 1 + j] + _MIX[j % 8])) * _MIX[(j + 3) % 8]
        total ^= total >> np.uint64(29)
    return np.unique(total)


def minhash_bands(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band."""
    odd = np.random.default_rng(5).integers(1 << 62, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (odd[:, None] * hashes[None, at : at + 2048]).min(1), out=least)
    out = np.zeros(bands, np.uint64)
    for j in range(rows):
        out = (out ^ least.reshape(bands, rows)[:, j]) * _MIX[j % 8]
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def node_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(hashes.tobytes())


def row_key() -> Column:
    """Of a document: equal rows share it."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text").isNull().cast("string"), "text").cast("binary")))


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """row, doc_id, node, size, bands (empty for the empty set) and a hash of the text of every document."""
    schema = pa.schema([("row", pa.binary()), ("doc_id", pa.int64()), ("own", pa.int64()), ("node", pa.binary()), ("size", pa.int32()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, every = [], [], []
            for text in batch.column(3):
                found = shingles(text.as_py(), n)
                nodes.append(node_of(found))
                sizes.append(len(found))
                every.append(minhash_bands(found, bands, rows) if len(found) else [])
            yield record(schema, {"row": batch.column(0), "doc_id": batch.column(1), "own": batch.column(2), "node": nodes, "size": sizes, "bands": every})

    own = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("own"), "text").mapInArrow(sign, "row binary, doc_id long, own long, node binary, size int, bands array<long>")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Contiguous rows with equal first columns, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if s and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def candidates(bands: np.ndarray, side: np.ndarray, low: int, high: int, band: int) -> np.ndarray:
    """Pairs (i < j in place) of a block pair that no earlier band has together, as a Boolean matrix."""
    pairs = np.triu(np.ones((len(bands), len(bands)), bool), 1)
    if low != high:
        pairs &= side[:, None] != side[None, :]
    for b in range(band):
        pairs &= bands[:, b, None] != bands[None, :, b]
    return pairs


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections."""
    m = len(sets)
    if m == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    keys, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    at, owner = column[at[keep]], owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out = np.zeros((m, m), np.float64)
    for s in range(0, int(shared.sum()), 8192):
        lo, hi = np.searchsorted(at, (s, s + 8192))
        x = np.zeros((m, 8192), np.float32)
        x[owner[lo:hi], at[lo:hi] - s] = 1
        out += x @ x.T
    return np.rint(out).astype(np.int64)


def forest(linked: np.ndarray) -> list[int]:
    """The smallest place in the component of each place."""
    label = np.arange(len(linked))
    linked = linked | linked.T | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(linked, label[None, :], len(label)).min(1)
        if (new == label).all():
            return label.tolist()
        label = new


def links(docs: DataFrame, reps: DataFrame, n: int, threshold: float) -> DataFrame:
    """node, root, n for nodes with links: n different texts linked in one task, root a node of the same group there."""
    # buckets are found on narrow rows; the bands of their nodes, few of all, are fetched afterwards
    spread = reps.where("size > 0").select("node", "size", F.posexplode("bands").alias("band", "h"))
    sizes = settled(spread.groupBy("band", "h").agg(F.count("*").alias("m"), F.sum("size").alias("held")).where("m > 1"))
    total = sizes.agg(F.sum("m")).first()[0] or 0
    held = look_up(spread.drop("size"), sizes, ["band", "h"], "m", total).join(reps.select("node", "row", "n_texts", "bands"), "node")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("held") / BLOCK_NGRAMS)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    held = held.select("band", "h", "node", "row", "n_texts", "bands", own.alias("side"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    keys = ["band", "h", "low", "high"]
    held = held.select("band", "h", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "node", "row", "n_texts", "bands")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for t in runs(batches, 4):
            if t.num_rows > 1:
                band, low, high = (t.column(k)[0].as_py() for k in (0, 2, 3))
                flat = t.column(8).combine_chunks()
                pairs = candidates(flat.flatten().to_numpy().reshape(t.num_rows, -1), t.column(4).to_numpy(), low, high, band)
                wanted = pairs.any(0) | pairs.any(1)
                if wanted.any():
                    held.append(t.filter(pa.array(wanted)))
            if len(held) >= 512:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    shape = "band int, h long, low int, high int, side int, node binary, row binary, n_texts int, bands array<long>"
    wanted = held.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(first, shape)
    texts = docs.select(row_key().alias("row"), "text").dropDuplicates(["row"])  # in each task before the shuffle, which the join then shares
    filled = wanted.join(texts, "row").select(*keys, "side", "node", "n_texts", "bands", "text")
    schema = pa.schema([("node", pa.binary()), ("root", pa.binary()), ("n", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {f.name: [] for f in schema}
        for t in runs(batches, 4):
            seen: dict[bytes, tuple[np.ndarray, int, list[int], int]] = {}
            for side, node, same, own, text in zip(*(t.column(k) for k in (4, 5, 6, 7, 8)), strict=True):
                if (key := node.as_py()) not in seen:
                    seen[key] = shingles(text.as_py(), n), side.as_py(), own.as_py(), same.as_py()
            if len(seen) < 2:
                continue
            band, low, high = (t.column(k)[0].as_py() for k in (0, 2, 3))
            nodes = sorted(seen)
            sets = [seen[k][0] for k in nodes]
            pairs = candidates(np.array([seen[k][2] for k in nodes]), np.array([seen[k][1] for k in nodes]), low, high, band)
            both, size = common(sets), np.array([len(s) for s in sets])
            linked = pairs & (both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9)
            same = np.array([seen[k][3] for k in nodes])
            many = same @ linked + linked @ same
            for i, root in enumerate(forest(linked)):
                if many[i]:
                    for k, v in zip(out, (nodes[i], nodes[root], int(many[i])), strict=True):
                        out[k].append(v)
            if len(out["n"]) >= 20_000:
                yield record(schema, out)
                out = {f.name: [] for f in schema}
        yield record(schema, out)

    return filled.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, "node binary, root binary, n long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each connected component, by minimum label and pointer jumping.

    Every round is written to the shared folder; the rounds grow with the logarithm of a component's
    diameter.  Neither the edges of a hub nor the nodes of a large group are gathered in one task.
    """
    pairs = edges.where("node <> root").select("node", F.col("root").alias("other"))
    pairs = settled(pairs.union(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    total = pairs.count()
    label = settled(pairs.groupBy("node").agg(F.min("other").alias("label"), F.count("*").alias("edges")).select("node", F.least("node", "label").alias("label"), "edges"))
    nodes = label.count()
    while True:
        near = look_up(pairs, label.select(F.col("node").alias("other"), "label", "edges"), ["other"], "edges", total).groupBy("node").agg(F.min("label").alias("near"))
        low = settled(label.join(near, "node").select("node", F.least("label", "near").alias("low"), "label", "edges"))
        if low.where("low <> label").isEmpty():
            return label.select("node", "label")
        # every label is a node, so each has its own label to jump to
        jump = settled(low.groupBy("low").agg(F.count("*").alias("members")).join(low.select(F.col("node").alias("low"), F.col("low").alias("jump")), "low"))
        label = settled(look_up(low, jump, ["low"], "members", nodes).select("node", F.least("low", "jump").alias("label"), "edges"))


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, copy_of, n_copies, n_texts, n_links, row, keep for every row of docs.

    copy_of is the smallest doc_id with the same n-gram set, n_copies how many rows have it and
    n_texts how many different texts; n_links is the number of other texts at or above the
    threshold, class_id the smallest doc_id of the group; keep marks the rows (equal ones alike)
    of the group's first document.
    """
    bands, rows = bands_for(threshold, recall)
    signed = settled(signatures(docs, n, bands, rows))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")).alias("first")
    texts = signed.groupBy("node", "own").agg(first, F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    reps = texts.groupBy("node").agg(F.min("first").alias("first"), F.sum("n_copies").alias("n_copies"), F.count("*").cast("int").alias("n_texts"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    reps = settled(reps.withColumn("row", F.col("first.row")))
    found = settled(links(docs, reps, n, threshold))
    label = components(found)
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    alike = F.when(F.col("size") > 0, F.coalesce("n", F.lit(0)) + F.col("n_texts") - 1).otherwise(0).cast("long")
    nodes = reps.drop("bands", "row").join(label, "node", "left").join(counts, "node", "left").withColumn("label", F.coalesce("label", "node")).withColumn("n_links", alike)
    nodes = settled(nodes.select("node", "label", "first", "n_copies", "n_texts", "n_links"))
    heads = settled(nodes.groupBy("label").agg(F.min("first").alias("head"), F.count("*").alias("members")))
    n_nodes, n_rows = nodes.agg(F.count("*"), F.sum("n_copies")).first()
    nodes = look_up(nodes, heads, ["label"], "members", n_nodes)
    nodes = settled(nodes.select("node", "n_copies", "n_texts", "n_links", F.col("first.doc_id").alias("copy_of"), "head"))
    out = look_up(signed.select("doc_id", "row", "node"), nodes, ["node"], "n_copies", n_rows or 0)
    return out.select("doc_id", F.col("head.doc_id").alias("class_id"), "copy_of", "n_copies", "n_texts", "n_links", "row", (F.col("row") == F.col("head.row")).alias("keep"))


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs, with all their columns, without the documents that another of their group stands for."""
    name = "row"
    while name in docs.columns:
        name += "_"
    kept = join(docs, n, threshold, recall).where("keep").groupBy("row").agg(F.count("*").alias("same"))
    kept = settled(kept.select(F.col("row").alias(name), "same"))
    rows = docs.withColumn(name, row_key())
    # rows that many others equal, fewer kinds than 1000, are reduced to one in each task before they meet
    often = F.col("same") > (kept.agg(F.sum("same")).first()[0] or 0) / 1000
    hot = rows.join(F.broadcast(kept.where(often & (F.col("same") > 1)).select(name)), name, "left_semi").dropDuplicates([name])
    rest = rows.join(kept.where(~often | (F.col("same") == 1)).select(name), name, "left_semi").dropDuplicates([name])
    return rest.unionByName(hot).drop(name)
