"""Importance resampling towards a target distribution of hashed word n-grams.

All texts of a batch are joined with sentinels between them and one regular expression pass finds their words; a search of
the words' places among the texts' begins masks the pairs of words that would cross texts, and the buckets of the rest are
counted by bincount. A first pass over documents and target gives the counts of BUCKETS buckets (all a task keeps, and all
the driver sees), a second one each document's mean gain. Scores are whole numbers of a narrow range, so that their
histogram, which is bounded by that range and not by the number of documents, tells how many documents stand before each
score; places within one score come from a window over the documents that share it. No sort of all documents is needed.

Defined cases: a null or empty text has no features and weight 0, and is never drawn; a null doc_id is hashed as an empty
one, keeps its place in the ties (first) and its row; rows that repeat a doc_id are documents of their own, drawn one after
the other; an empty target or corpus has counts of 0; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, table
from sluice.llm.terms import pieces, words

BUCKETS = 10_000
PERCENT, SEED, LEAST_WORDS = 25, 7, 20
SCALE = 1000


def buckets_of(texts: list[bytes], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text of each feature, its bucket, text of each word) of all runs of one and two words, block by block."""
    last_owner, last_code = -1, 0
    for owner, found in words(texts):
        codes = list(map(crc32, found))
        before = np.concatenate([[last_owner], owner[:-1]])
        pairs = np.fromiter(map(crc32, [b" " + w for w in found], [last_code, *codes[:-1]]), np.int64, len(found))
        within = before == owner  # the others would join the last word of a text with the first one of the next
        last_owner, last_code = int(owner[-1]), codes[-1]
        yield np.concatenate([owner, owner[within]]), np.concatenate([np.array(codes, np.int64), pairs[within]]) % buckets, owner


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in pieces(batch.column("text")):
                for _, bucket, _ in buckets_of(texts, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(buckets, np.int64)
    for r in rows:  # one row a bucket
        total[r.bucket] = r.n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share of the target over that of the corpus) of each bucket."""
    s_all, t_all, n = int(corpus.sum()), int(target.sum()), len(corpus)
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(SCALE * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in pairs], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document: weight is the floored mean of its features' gains."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def weigh(batches):
        own = shared.value
        for batch in batches:
            size = batch.num_rows
            n_words, n_features, total = (np.zeros(size, np.int64) for _ in range(3))
            for first, texts in pieces(batch.column("text")):
                for feature, bucket, word in buckets_of(texts, len(own)):
                    here = slice(first, first + len(texts))
                    n_words[here] += np.bincount(word, minlength=len(texts))
                    n_features[here] += np.bincount(feature, minlength=len(texts))
                    # whole numbers far below 2**53, so the sums in doubles are exact
                    total[here] += np.bincount(feature, own[bucket], len(texts)).astype(np.int64)
            weight = np.floor_divide(total, np.maximum(n_features, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 times a Gumbel draw) that rests on seed and id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """weighed (doc_id, n_words, score, ...) with rank: 1, 2, ... of the percent highest scores among the documents of
    least_words words or more, ties to the smaller doc_id; null for all others. Reads weighed twice."""
    fit = F.col("n_words") >= least_words
    histogram = {r.score: r.n for r in weighed.filter(fit).groupBy("score").agg(F.count("*").alias("n")).collect()}  # bounded by the range of scores
    wanted, before, rows = percent * sum(histogram.values()) // 100, 0, []
    for score in sorted(histogram, reverse=True):
        if before >= wanted:
            break
        rows.append((score, before))
        before += histogram[score]
    if not rows:
        return weighed.withColumn("rank", F.lit(None).cast("long"))
    above = F.broadcast(weighed.sparkSession.createDataFrame(rows, "score long, _before long"))
    inside = fit & (F.col("score") >= rows[-1][0])
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_first("doc_id"), "weight", "n_features"))
    ranked = weighed.filter(inside).join(above, "score").withColumn("rank", F.col("_before") + place)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).select(*weighed.columns, "rank")
    return ranked.unionByName(weighed.filter(~inside).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document: documents whose n-grams are those of the target
    score high, and rank is the order in which percent of the documents of least_words words or more are drawn without
    replacement."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = weights(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return draw(Scratch(docs.sparkSession).keep(scored), percent, least_words)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LETTERS = ", ".join(f"'{''.join(chr(c + k) for k in range(26))}'" for c in (65, 97))
_BIT = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"


def _features(name: str, source: str, key: str) -> str:
    return f"""
{name}_w AS (SELECT {key} AS k, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '{_WORD}') AS ws FROM {source}),
{name} AS (
  SELECT k, unnest(ws) AS f FROM {name}_w
  UNION ALL SELECT k, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM {name}_w WHERE len(ws) > 1
)"""


#: The checksum is computed by its definition: eight steps of a shift for each value of a byte give its table.
ORACLE_SQL = f"""
WITH RECURSIVE {_features("d", "documents", "doc_id").strip()}, {_features("b", "benchmark", "item_id")},
steps AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS step FROM range(256) AS r(i)
  UNION ALL SELECT i, {_BIT.format("c")}, step + 1 FROM steps WHERE step < 8
),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE step = 8),
bytes AS (
  SELECT f, list_transform(range(0, octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT)) AS bs
  FROM (SELECT DISTINCT f FROM (SELECT f FROM d UNION ALL SELECT f FROM b))
),
buckets AS (
  SELECT f, xor(list_reduce(bs, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket FROM bytes, crc
),
own AS (SELECT k, bucket FROM d JOIN buckets USING (f)),
s AS (SELECT bucket, count(*) AS n FROM own GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN buckets USING (f) GROUP BY bucket),
g AS (
  SELECT s.bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM s) + 10000) AS DOUBLE) / ((s.n + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)
),
weighed AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features, coalesce(CAST(floor(total / n) AS BIGINT), 0) AS weight
  FROM (SELECT k AS doc_id, ws FROM d_w) LEFT JOIN (SELECT k, count(*) AS n, sum(gain) AS total FROM own JOIN g USING (bucket) GROUP BY k) ON k = doc_id
),
scored AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed
),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_words >= 20 AND r <= (25 * n) // 100 THEN r END AS rank FROM placed
"""
