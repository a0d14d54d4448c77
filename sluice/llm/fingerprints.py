"""Document fingerprints by one-permutation min-hashing, and how alike they say that texts are.

Every shingle of five words is hashed once; the upper bits name one of BINS bins and the least rest of each bin is kept. An
empty bin takes the value of a filled one: of those, the first in an order that is drawn for the bin alone, so that two texts
take from the same bin as often as they would if all bins were drawn anew (optimal densification, its attempts without
repetition). Of each value the BITS low-order ones are stored, packed; values of different texts then agree by chance once in
2**BITS bins, which likeness() takes out of the share of agreeing bins.

A document's neighbour is the next one by doc_id. A task reads documents in their order on disk and takes the one that
follows as the next; what a table of true neighbours (from ids alone, by blocks of blocks of ids) then refutes is done again by
joining the texts. So tables that are stored by id, but for borders of files, send no text over the network, and any order
gives the same rows.

Defined cases: a null text is empty; a text without words has the fingerprint "", alike (1.0) only to its equals; with fewer than
five words the whole sequence is the one shingle. Rows that repeat a doc_id are documents of their own with the same next one,
which is, where an id repeats, the one with the least text; a row with a null doc_id comes last, so its next is the first
document (an empty text where no row has an id). A single document is its own next. Empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm import textcodes
from sluice.llm.common import Scratch, table

WORDS, BINS, BITS = 5, 512, 4
BLOCK_BITS = 12  # ids are compared within blocks of 4096 of them, then blocks within blocks
_EMPTY = np.uint64(2**64 - 1)
_LOG = BINS.bit_length() - 1
#: For each bin all bins in the order in which it takes from them.
_ORDER = np.argsort(textcodes.mix(textcodes.mix(np.arange(BINS * BINS, dtype=np.uint64)) ^ textcodes.STEPS[50]).reshape(BINS, BINS), axis=1)


def densify(bins: np.ndarray) -> np.ndarray:
    """Rows of bins, of which each has some that are filled, without empty ones."""
    filled, out = bins != _EMPTY, bins.copy()
    row, bin_ = np.nonzero(~filled)
    for attempt in range(BINS):
        if not len(row):
            break
        source = _ORDER[bin_, attempt]
        has = filled[row, source]
        out[row[has], bin_[has]] = bins[row[has], source[has]]
        row, bin_ = row[~has], bin_[~has]
    return out


def pack(bins: np.ndarray) -> np.ndarray:
    """The BITS low-order bits of each bin's value, mixed, as rows of bytes."""
    low = (textcodes.mix(bins) & np.uint64(2**BITS - 1)).astype(np.uint8)
    bits = (low[:, :, None] >> np.arange(BITS, dtype=np.uint8)) & 1
    return np.packbits(bits.reshape(len(low), BINS * BITS), axis=1)


def fingerprints(texts: pa.Array) -> Iterator[bytes]:
    """The fingerprint of every text, empty for one without words."""
    for first, last, data, offsets in textcodes.chunks(texts):
        codes, _, _, begin = textcodes.words(data, offsets)
        every, n = textcodes.shingles(codes, WORDS), last - first
        sizes = np.diff(begin)
        owner = np.repeat(np.arange(n), sizes)[: len(every)]
        hashes = every[np.arange(len(every)) + WORDS <= begin[1:][owner]] if len(every) else every
        owner = np.repeat(np.arange(n), np.maximum(sizes - WORDS + 1, 0))
        short = np.flatnonzero((sizes > 0) & (sizes < WORDS))
        hashes = np.concatenate([hashes, *(textcodes.short_shingle(codes[begin[k] : begin[k + 1]]) for k in short)])
        owner = np.concatenate([owner, short])
        hashes = textcodes.mix(hashes ^ textcodes.STEPS[51])
        bins = np.full(n * BINS, _EMPTY)
        np.minimum.at(bins, owner * BINS + (hashes >> np.uint64(64 - _LOG)).astype(np.int64), hashes << np.uint64(_LOG))
        bins = bins.reshape(n, BINS)
        packed, full = np.zeros((n, BINS * BITS // 8), np.uint8), np.flatnonzero(sizes)
        packed[full] = pack(densify(bins[full]))
        yield from (row.tobytes() if size else b"" for row, size in zip(packed, sizes, strict=True))


def alike(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The estimated Jaccard similarities of the shingles behind pairs of packed fingerprints, from 0 to 1."""
    size = BINS * BITS // 8
    rows = lambda own: np.frombuffer(b"".join(x or bytes(size) for x in own), np.uint8).reshape(-1, size)
    bits = np.unpackbits(rows(a) ^ rows(b), axis=1).reshape(-1, BINS, BITS)
    chance = 2.0**-BITS
    estimate = np.maximum(((~bits.any(axis=2)).mean(axis=1) - chance) / (1 - chance), 0.0)
    empty_a, empty_b = (np.array([not x for x in own], bool) for own in (a, b))
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), estimate)


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """alike() of two columns of packed fingerprints (unbase64 of the text form)."""
    return pd.Series(alike(a.tolist(), b.tolist()))


def next_ids(ids: DataFrame) -> DataFrame:
    """ids (doc_id) -> (doc_id, n, next_id) of all distinct ids, n times given; the last one's next is the first. An id's next is the next one
    of its block or the first of the next block that has any, which is found in the same way among blocks: so every window
    holds at most 2**BLOCK_BITS rows."""
    ids = ids.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    low, high = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    level, n = ids.select(F.col("doc_id").alias("first"), F.shiftright("doc_id", BLOCK_BITS).alias("_block"), F.col("doc_id").alias("key"), "n"), 0
    levels = [level]
    while low is not None and (high >> BLOCK_BITS * n) - (low >> BLOCK_BITS * n) >> BLOCK_BITS:
        n += 1
        level = level.groupBy(F.col("_block").alias("key")).agg(F.min("first").alias("first")).withColumn("_block", F.shiftright("key", BLOCK_BITS))
        levels.append(level)
    levels[-1] = level.withColumn("_block", F.lit(0))  # 2**BLOCK_BITS keys at most
    above = None
    for level in reversed(levels):
        after = F.lead("first").over(Window.partitionBy("_block").orderBy("key"))
        level = level.withColumn("_next", after)
        if above is not None:
            level = level.join(above.select(F.col("key").alias("_block"), F.col("_next").alias("_above")), "_block", "left").withColumn("_next", F.coalesce("_next", "_above")).drop("_above")
        above = level
    return above.select(F.col("key").alias("doc_id"), "n", F.coalesce("_next", F.lit(low)).alias("next_id"))


_SCHEMA = "doc_id long, assumed long, n_chars long, edited_sha256 string, own binary, edited binary, near_edited double, near_next double"
RESULT = ("doc_id", "n_chars", "edited_sha256", "own", "edited", "near_edited", "near_next")


def edit(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _rows(ids: list, texts: list[str], own: list[bytes], after_ids: list, after: list[str], after_own: list[bytes]) -> pa.RecordBatch:
    edits = [edit(t, f) for t, f in zip(texts, after, strict=True)]
    edited = list(fingerprints(pa.array(edits, pa.large_string())))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array(after_ids, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits]),
            pa.array(own, pa.binary()), pa.array(edited, pa.binary()), pa.array(alike(own, edited)), pa.array(alike(own, after_own)),
        ],
        ["doc_id", "assumed", "n_chars", "edited_sha256", "own", "edited", "near_edited", "near_next"],
    )


def _in_order(batches):
    """Every document edited with the one that follows it in its task; the last one with itself, which no table of two ids
    confirms."""
    ids, texts, own = [], [], []
    for batch in batches:
        new = [t or "" for t in batch.column("text").to_pylist()]
        ids, texts, own = ids[-1:] + batch.column("doc_id").to_pylist(), texts[-1:] + new, own[-1:] + list(fingerprints(pa.array(new, pa.large_string())))
        if len(ids) > 1:
            yield _rows(ids[:-1], texts[:-1], own[:-1], ids[1:], texts[1:], own[1:])
    if ids:
        yield _rows(ids[-1:], texts[-1:], own[-1:], [None], texts[-1:], own[-1:])


def _given(batches):
    """Every document edited with the text it comes with."""
    for batch in batches:
        texts, after = ([t or "" for t in batch.column(c).to_pylist()] for c in ("text", "following"))
        own, after_own = list(fingerprints(pa.array(texts, pa.large_string()))), [o or b"" for o in batch.column("following_own").to_pylist()]
        yield _rows(batch.column("doc_id").to_pylist(), texts, own, batch.column("next_id").to_pylist(), after, after_own)


def _following(batches):
    """(next_id, the first k code points of its text, the whole text's fingerprint)"""
    for batch in batches:
        texts, k = batch.column("text").to_pylist(), batch.column("k").to_pylist()
        own = pa.array(fingerprints(batch.column("text")), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("next_id"), pa.array([t[:n] for t, n in zip(texts, k, strict=True)], pa.string()), own], ["next_id", "following", "following_own"])


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of docs (doc_id,
    text): fingerprints as base64, the edited text being the text with its last quarter of code points replaced by as many of
    the next document, and the likeness of the fingerprint to the edited text's and to the next document's."""
    docs, scratch = docs.select(F.col("doc_id").cast("long"), "text"), Scratch(docs.sparkSession)
    after = scratch.keep(next_ids(docs.select("doc_id")))
    first = after.agg(F.min("doc_id")).first()[0]
    repeated = after.filter("n > 1").select(F.col("doc_id").alias("next_id"), F.lit(True).alias("_repeats"))

    read = scratch.keep(docs.mapInArrow(_in_order, _SCHEMA))
    checked = read.select("doc_id", "assumed", "n_chars").join(after.drop("n"), "doc_id", "left").withColumn("next_id", F.coalesce("next_id", F.lit(first).cast("long")))
    # order tells neither the least text of an id that repeats, nor anything of rows without an id
    true = F.coalesce(F.col("assumed") == F.col("next_id"), F.lit(False)) & F.col("_repeats").isNull()
    left = checked.join(repeated, "next_id", "left").filter(~true).groupBy(F.col("doc_id").alias("_left"), "next_id").agg(F.floor(F.max("n_chars") / 4).cast("int").alias("k"))
    left = scratch.keep(left)  # written, so that Spark knows how few they are and broadcasts them, or else shuffles
    is_left = F.col("doc_id").eqNullSafe(F.col("_left"))
    done = read.join(left, is_left, "left_anti").select(*RESULT)

    wanted = scratch.keep(left.groupBy("next_id").agg(F.max("k").alias("k")))
    least = docs.withColumnRenamed("doc_id", "next_id").join(wanted, "next_id").groupBy("next_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "k")).alias("t"))
    following = scratch.keep(least.select("next_id", "t.*").mapInArrow(_following, "next_id long, following string, following_own binary"))
    again = docs.join(left.drop("k"), is_left).join(following, "next_id", "left").select("doc_id", "text", "next_id", "following", "following_own")
    both = done.unionByName(again.mapInArrow(_given, _SCHEMA).select(*RESULT))
    return both.select("doc_id", "n_chars", "edited_sha256", _text("own").alias("fingerprint"), _text("edited").alias("edited_fingerprint"), "near_edited", "near_next")


def _text(packed: str) -> Column:
    return F.translate(F.base64(packed), "\r\n", "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))
