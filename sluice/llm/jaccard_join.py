"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Documents are sets of five-word shingles; two are linked when 100 * |A & B| >= 75 * |A | B|.

1. Shingle frequencies over all documents go into a table of BUCKETS counters (a fixed size, so it may be broadcast); the
   order "rarer bucket first, then code" is total, which is all that prefix filtering needs to be exact.
2. A document of n shingles must share at least a = ceil(0.75 n) with a partner, so the L rarest shared shingles lie among
   its n - a + L rarest ones. Each document takes the L in MATCHES (at most a) with the least estimated cost: postings read
   plus verifications, which fall as more matches are required. A pair of prefixes with L and M needs min(L, M) matches, so
   a document with fewer shared tokens in its prefix than any partner's L allows drops out before pairs are made.
3. Documents with equal sets form a class and are represented by their least id.
4. Postings: shingles in the prefixes of two or more representatives. First every representative is compared with that
   leader of its postings that it shares most with, and linked ones are joined into components; this is repeated while it finds links. Then
   the pairs that are still in different components are matched completely, where their sketches allow it: SKETCH bits, of
   which every shingle turns one over, so that two sets differ in as many shingles at least as their sketches do in bits
   (sets of many hundred shingles fill them, and are left to the other filters). No pair within a component is ever emitted.

The result lists each document with its class and component; links within a component need no pairs, and no link between
components is lost.

Defined cases: documents without words are linked with nothing; fewer than five words make one shingle; a null doc_id gets
a null component; rows with one doc_id are one node; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import textcodes
from sluice.llm.common import Scratch, table
from sluice.llm.components import components

PERCENT = 75
BITS = 20
BUCKETS = 1 << BITS
MATCHES = (4, 8)
VERIFY_COST = 40.0
STAR_ROUNDS = 6
PROMISING = 8
SKETCH = 256


def _bucket(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(64 - BITS)).astype(np.int64)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Shingle frequencies of all documents by bucket; BUCKETS numbers whatever the input."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, codes in textcodes.shingle_sets(batch.column("text")):
                np.add.at(total, _bucket(codes), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return counts


def least_shared(n: int) -> int:
    return -(-PERCENT * n // 100)


def prefix(codes: np.ndarray, counts: np.ndarray, usual: float) -> tuple[int, np.ndarray]:
    """The number of matches chosen for a document and its prefix, rarest first."""
    n, loads = len(codes), counts[_bucket(codes)]
    ordered = np.lexsort((codes, loads))
    shared = least_shared(n)
    least, most = (min(m, shared) for m in MATCHES)
    extra = np.maximum(loads[ordered[: n - shared + most]] - usual, 0.0)
    postings = np.cumsum(extra)[n - shared + least - 1 :]
    matches = least + int(np.argmin(postings * (1.0 + VERIFY_COST / np.arange(least, most + 1))))
    return matches, codes[ordered[: n - shared + matches]]


def sketch(codes: np.ndarray) -> np.ndarray:
    """SKETCH bits, each of which tells whether the codes with its number are odd in number, in words of 64."""
    odd = np.bincount((codes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def least_matches(n):
    """Matches that a pair of a document of n tokens needs at least: a partner has ceil(0.75 n) tokens or more."""
    smallest = F.ceil(PERCENT * n / F.lit(100))
    return F.least(F.lit(MATCHES[0]), F.ceil(PERCENT * smallest / F.lit(100)))


def signatures(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(doc_id, n, sig_a, sig_b, sketch, matches, prefix) for every row."""
    filled = counts[counts > 0]
    usual = float(np.median(filled)) * 2 if len(filled) else 0.0
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # BUCKETS numbers

    def sign(batches):
        table_ = shared.value
        for batch in batches:
            ids, columns, sketches = batch.column("doc_id"), ([], [], [], [], []), []
            for _, codes in textcodes.shingle_sets(batch.column("text")):
                matches, head = prefix(codes, table_, usual) if len(codes) else (0, codes)
                mixed = textcodes.mix(codes + textcodes.STEPS[9])
                for column, value in zip(
                    columns, (len(codes), codes.sum(dtype=np.uint64).view(np.int64), mixed.sum(dtype=np.uint64).view(np.int64), matches, head.view(np.int64)), strict=True
                ):
                    column.append(value)
                sketches.append(sketch(codes))
            lengths = np.concatenate([[0], np.cumsum([len(x) for x in columns[4]])]).astype(np.int32)
            flat = np.concatenate(columns[4]) if columns[4] else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(sketches, pa.list_(pa.int64())), pa.array(columns[3], pa.int32()), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))],
                ["doc_id", "n", "sig_a", "sig_b", "sketch", "matches", "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, sig_a long, sig_b long, sketch array<long>, matches int, prefix array<long>")


def shingle_vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, codes binary): the sorted shingle codes of each document."""

    def vectors(batches):
        for batch in batches:
            codes = [c.tobytes() for _, c in textcodes.shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes, pa.binary())], ["doc_id", "codes"])

    return docs.select("doc_id", "text").mapInArrow(vectors, "doc_id long, codes binary")


def verify(scratch: Scratch, pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets meet the threshold; only texts that some pair needs are read into sets."""

    def exact(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    vectors = scratch.keep(shingle_vectors(docs.join(wanted, "doc_id").dropDuplicates(["doc_id"])))
    found = scratch.keep(
        pairs.join(vectors.select(F.col("doc_id").alias("a"), F.col("codes").alias("x")), "a")
        .join(vectors.select(F.col("doc_id").alias("b"), F.col("codes").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(exact, "a long, b long")
    )
    scratch.drop(vectors)
    return found


def _sizes_fit(n: str, m: str):
    return (100 * F.col(n) >= PERCENT * F.col(m)) & (100 * F.col(m) >= PERCENT * F.col(n))


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, links): doc_id, n_shingles, class_id, component_id of each row; the verified links (a, b) between
    class representatives that the components rest on."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = scratch.keep(signatures(docs, bucket_counts(docs)))
    rows = scratch.keep(signed.drop("prefix", "matches", "sketch"))
    named = signed.filter("n > 0 AND doc_id IS NOT NULL").select("sig_a", "sig_b", "n", F.struct("doc_id", "sketch").alias("of"))
    classes = scratch.keep(named.groupBy("sig_a", "sig_b", "n").agg(F.min("of").alias("of")).select("sig_a", "sig_b", "n", F.col("of.doc_id").alias("class_id"), "of.sketch"))
    tokens = signed.filter("n > 0 AND doc_id IS NOT NULL").select(F.posexplode("prefix").alias("i", "token"), "sig_a", F.col("n").cast("int"), "matches")
    several = tokens.groupBy("token").agg(F.min("sig_a").alias("x"), F.max("sig_a").alias("y")).filter("x < y").select("token")
    several = scratch.keep(several)  # in the prefixes of two or more classes
    shared = scratch.keep(tokens.join(several, "token").distinct())
    scratch.drop(signed, several)
    enough = shared.groupBy("sig_a").agg(F.count("*").alias("c"), F.first("n").alias("m")).filter(F.col("c") >= least_matches(F.col("m"))).select("sig_a")
    named = classes.select("sig_a", F.col("class_id").alias("doc_id"))
    postings = scratch.keep(shared.join(enough, "sig_a").join(named, "sig_a").select("token", "i", "doc_id", "n", "matches"))
    scratch.drop(shared)
    # Only texts with postings are ever verified: they are picked once, so that no round shuffles all texts again.
    docs = scratch.keep(docs.join(postings.select("doc_id").distinct(), "doc_id").dropDuplicates(["doc_id"]))
    links = tried = None
    parts = postings.select("*", F.col("doc_id").alias("part"))
    for star in range(STAR_ROUNDS):
        # another member stands for each component in each round, and the same one in most of its postings
        one = parts.groupBy("token", "part").agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(star)).alias("k"), "doc_id", "n")).alias("of"))
        lead = one.groupBy("token").agg(F.min(F.struct("part", "of")).alias("lead"), F.count("*").alias("parts")).filter("parts > 1")
        pairs = (
            one.join(lead, "token").filter(F.col("part") != F.col("lead.part"))
            .filter(_sizes_fit("of.n", "lead.of.n"))
            .groupBy(F.col("of.doc_id").alias("own"), F.col("lead.of.doc_id").alias("other")).agg(F.count("*").alias("shared"), F.min(F.least("of.n", "lead.of.n")).alias("least"))
            .filter(PROMISING * F.col("shared") >= F.col("least"))
            .groupBy("own").agg(F.max(F.struct("shared", "other")).alias("best"))  # the others are left to later rounds and the last step
            .select(F.greatest("own", "best.other").alias("a"), F.least("own", "best.other").alias("b")).distinct()
        )
        pairs = scratch.keep(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        found = verify(scratch, pairs, docs)
        tried = pairs if tried is None else tried.union(pairs)
        if star > 1 and found.isEmpty():
            break
        links = found if links is None else links.union(found)
        # Components only grow, so a token within one of them brings no pairs any more.
        named = _parts(postings, components(scratch, links))
        split = named.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x < y").select("token")
        parts = scratch.keep(named.join(split, "token"))
        scratch.drop(postings)
        postings = parts
    left = parts
    for _ in range(2):  # tokens of several components, in documents that share enough of those
        split = left.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x < y").select("token")
        several = scratch.keep(left.join(split, "token"))
        enough = several.groupBy("doc_id").agg(F.count("*").alias("c"), F.first("n").alias("m")).filter(F.col("c") >= least_matches(F.col("m"))).select("doc_id")
        pruned = scratch.keep(several.join(enough, "doc_id"))
        scratch.drop(postings if left is parts else left)
        left = pruned
        scratch.drop(several)
    left = left.join(classes.select(F.col("class_id").alias("doc_id"), "sketch"), "doc_id")
    a, b = (left.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "i", "matches", "part", "sketch"))) for s in "ab")
    rest = (
        a.join(b, "token").filter((F.col("part_a") < F.col("part_b")) & _sizes_fit("n_a", "n_b") & _places_fit() & _sketches_fit())
        .groupBy(F.greatest("doc_id_a", "doc_id_b").alias("a"), F.least("doc_id_a", "doc_id_b").alias("b"))
        .agg(
            F.count("*").alias("shared"), F.first(F.least("matches_a", "matches_b")).alias("needed"), F.first(F.col("n_a") + F.col("n_b")).alias("sum"),
            F.least(F.first("n_a") - F.max("i_a"), F.first("n_b") - F.max("i_b")).alias("after"),
        )
        .withColumn("most", F.col("shared") + F.col("after") - 1)  # those up to the last shared one, and what follows it at most
        .filter(F.col("shared") >= F.col("needed")).filter(100 * F.col("most") >= PERCENT * (F.col("sum") - F.col("most")))
        .select("a", "b").join(tried, ["a", "b"], "left_anti")
    )
    links = scratch.keep(links.union(verify(scratch, scratch.keep(rest), docs)))
    scratch.drop(docs)
    groups = components(scratch, links).withColumnRenamed("node", "class_id")
    documents = (
        rows.join(classes.drop("sketch"), ["sig_a", "sig_b", "n"], "left")
        .withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")))
        .join(groups, "class_id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
    )
    return documents, links


def _places_fit():
    """Of a pair that shares at least o = ceil(75 (n_a + n_b) / 175), the L rarest shared tokens stand in the first n - o + L
    of both; and with a token at places i and j, at most min(i, j) are shared before it and min(n_a - i, n_b - j) from it on."""
    total, matches = F.col("n_a") + F.col("n_b"), F.least("matches_a", "matches_b")
    needed = F.ceil(PERCENT * total / F.lit(100 + PERCENT))
    most = F.least("i_a", "i_b") + F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
    return (F.col("i_a") < F.col("n_a") - needed + matches) & (F.col("i_b") < F.col("n_b") - needed + matches) & (most >= needed)


def _sketches_fit():
    """Linked sets of n_a and n_b shingles differ in at most 25 (n_a + n_b) / 175 of them, and each of those turns one bit over."""
    words = range(SKETCH // 64)
    bits = sum((F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in words), F.lit(0))
    return (100 + PERCENT) * bits <= (100 - PERCENT) * (F.col("n_a") + F.col("n_b"))


def _parts(postings: DataFrame, groups: DataFrame) -> DataFrame:
    named = groups.withColumnRenamed("node", "doc_id")
    return postings.drop("part").join(named, "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id")).drop("component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))[0]
