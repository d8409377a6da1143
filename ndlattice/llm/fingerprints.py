"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text's k-mers are its runs of k words, shorter ones at its end; words stand between blanks, and a
character of a script without blanks is a word of its own.  The o-th occurrence of a k-mer
is told from its others by its number, so that a repeated passage weighs by how often it stands
there.  A hash of k-mer and number deals the numbered k-mers over a fixed number of bins; each bin
keeps the two least, puts them back into text order and hashes that pair.  Two texts are alike in
the share of bins, of those that either fills, whose pairs agree: edits, moves and repeats lower it.

One sort by k-mer finds the occurrence numbers and one sort by hash the bins, so the work of a
text grows as n log n and nothing is exploded into rows.

Defined cases: null text counts as empty; a text without a word has empty bins only, and two of
them are alike at 1; equal texts have equal fingerprints.  For the edited text, rows with one
doc_id count as one document when they are another's next one, with the longest of their texts (of equally
long ones that of the greatest hash);
a null doc_id counts as the smallest one (-2**63, which
is read as null); a table's only document is its own next one; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, shuffle_width

K, BINS, EMPTY = 3, 64, -1
_PLACE = 24  # bits of a word's place; places of longer texts count from 0 again, which only blurs the order of their pairs
#: Scripts written without blanks: Thai, Lao, Burmese, Khmer, kana, Chinese characters.
_UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\p{IsHan}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(a: Column, key: Callable[[Column], Column]) -> Column:
    """Places of a sorted array where the key changes."""
    return F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda j: (j == 0) | (key(F.get(a, j)) != key(F.get(a, j - 1))))


def sketch(text: Column, k: int = K, bins: int = BINS) -> Column:
    """array<smallint>: for each bin the hash of its pair, 15 bits, or EMPTY."""
    place = (1 << _PLACE) - 1
    head = lambda v: F.shiftrightunsigned(v, _PLACE)
    packed = lambda h, at: F.shiftleft(F.shiftrightunsigned(h, _PLACE + 1), _PLACE).bitwiseOR(at.cast("long").bitwiseAND(place))
    given = F.coalesce(text, F.lit(""))
    spaced = F.when(given.rlike(_UNSPACED), F.regexp_replace(given, f"({_UNSPACED})", " $1 ")).otherwise(given)
    words = F.filter(F.split(spaced, r"\s+"), lambda w: w != "")

    def kmers(a: Column) -> Column:
        return F.array_sort(F.transform(a, lambda w, i: packed(F.xxhash64(w, *(F.get(a, i + j) for j in range(1, k))), i)))

    def numbers(s: Column) -> Column:
        """Occurrence numbers along the sorted k-mers."""
        return let(_starts(s, head), lambda st: F.flatten(F.transform(st, lambda at, x: F.sequence(F.lit(0), F.coalesce(F.get(st, x + 1), F.size(s)) - at - 1))))

    def numbered(s: Column) -> Column:
        return let(numbers(s), lambda o: F.array_sort(F.transform(s, lambda v, j: packed(F.xxhash64(head(v), F.get(o, j)), v.bitwiseAND(place)))))

    width = (63 - _PLACE - 1) - (bins.bit_length() - 1) + 1  # bits below a bin's number
    bin_of = lambda v: F.shiftrightunsigned(v, _PLACE + width)

    def pair(w: Column, j: Column) -> Column:
        one, two = F.get(w, j), F.get(w, j + 1)
        ordered = F.when(two.isNull() | (bin_of(one) != bin_of(two)), F.xxhash64(head(one))).when(one.bitwiseAND(place) < two.bitwiseAND(place), F.xxhash64(head(one), head(two))).otherwise(F.xxhash64(head(two), head(one)))
        return F.struct(bin_of(one).cast("int").alias("bin"), ordered.bitwiseAND(0x7FFF).cast("smallint").alias("hash"))

    def filled(w: Column) -> Column:
        found = F.map_from_entries(F.transform(_starts(w, bin_of), lambda j: pair(w, j)))
        return let(found, lambda m: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.element_at(m, b), F.lit(EMPTY).cast("smallint"))))

    made = let(words, lambda a: F.when(F.size(a) == 0, F.array_repeat(F.lit(EMPTY).cast("smallint"), bins)).otherwise(let(let(kmers(a), numbered), filled)))
    return made


def printed(a: Column) -> Column:
    """A sketch as text, four hexadecimal digits a bin."""
    return F.array_join(F.transform(a, lambda x: F.when(x < 0, "----").otherwise(F.lpad(F.lower(F.hex(x.cast("long"))), 4, "0"))), "")


def alike(a: Column, b: Column) -> Column:
    """Share of the bins filled in either sketch that agree; 1 if none is filled."""
    agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x >= 0)), lambda x: x))
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x >= 0) | (y >= 0)), lambda x: x))
    return F.when(either == 0, 1.0).otherwise(agree / either)


def successors(ids: DataFrame) -> DataFrame:
    """k, next: every k of ids (distinct) with the next smaller one, and the least with the greatest.

    Ranges of ids are linked inside themselves; only one row for each range meets in one task.
    """
    ranged = ids.select("k").repartitionByRange(shuffle_width(ids.sparkSession), F.desc("k")).withColumn("part", F.spark_partition_id())
    ranged = settled(ranged)
    heads = ranged.groupBy("part").agg(F.max("k").alias("head"))
    after = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(after), F.first("head").over(after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("then"))
    own = F.lead("k").over(Window.partitionBy("part").orderBy(F.desc("k")))
    return ranged.withColumn("own", own).join(F.broadcast(heads), "part").select("k", F.coalesce("own", "then").alias("next"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs."""
    # both joins take the same two columns, so that the texts are shuffled once and reused
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    third = F.floor(F.length("text") / 3).cast("int")
    ids = rows.groupBy("k").agg(F.max(third).alias("need"))
    follow = settled(successors(ids).join(ids, "k"))
    wanted = follow.select(F.col("next").alias("k"), F.col("k").alias("to"), "need")
    which = F.struct(F.length("text").cast("long"), F.xxhash64("text"))
    sent = rows.join(wanted, "k").groupBy(F.col("to").alias("k")).agg(F.max_by(F.expr("substring(text, 1, need)"), which).alias("tail"))
    edited = F.concat(F.expr("substring(text, 1, length(text) - floor(length(text) / 3))"), F.expr("substring(tail, 1, floor(length(text) / 3))"))
    both = rows.join(sent, "k").join(follow.select("k", "next"), "k")
    made = settled(both.select("k", "next", F.length("text").cast("long").alias("n_chars"), sketch(F.col("text")).alias("own"), let(edited, lambda e: F.struct(F.unhex(F.sha2(e.cast("binary"), 256)).alias("sha"), sketch(e).alias("sketch"))).alias("edited"), F.xxhash64("text").alias("h")))
    theirs = made.groupBy(F.col("k").alias("next")).agg(F.max_by("own", F.struct("n_chars", "h")).alias("theirs"))
    return made.join(theirs, "next").select(F.nullif("k", F.lit(-(1 << 63))).alias("doc_id"), "n_chars", F.lower(F.hex("edited.sha")).alias("edited_sha256"), printed(F.col("own")).alias("fingerprint"), printed(F.col("edited.sketch")).alias("edited_fingerprint"), alike(F.col("own"), F.col("edited.sketch")).alias("near_edited"), alike(F.col("own"), F.col("theirs")).alias("near_next"))
