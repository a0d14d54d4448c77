"""Sharding by a hypergeometric communication matrix.

A uniform shuffle into shards of exact size without one global sort: rows lie in blocks; for each block the number of rows
that it sends to each shard is drawn from the multivariate hypergeometric law (the law those counts have under a uniformly
random permutation of all rows), a random order within the block decides which rows go, and a random order within the
shard gives the slots. The result has the law of a uniform permutation cut into shards whose counts differ by one at most.

A block is what a hash of the row puts together, so a task that is run again sends the same rows to the same places; the
number of blocks is fixed, so the matrix has a fixed size (BLOCKS x shards) however many rows there are. Only the block
counts reach the driver. Within a shard, rows are numbered in pieces of about PIECE_ROWS rows: random piece, random order
in the piece, and the offsets of the pieces from their counts; no task holds a shard.

Defined cases: a null text has size 1 and the checksum of no bytes; null ids are dealt like others; equal rows are
interchangeable, each gets a slot of its own; an empty table gives no rows; other columns pass through, and input columns
named shard or slot are replaced.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, table

SHARDS = 16
BLOCKS = 1024
PIECE_ROWS = 200_000


def draw_hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Exact draw by inversion, walking outwards from the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at_mode = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - at_mode
    down = up = at_mode
    left, right = mode, mode
    while u > 0 and (left > low or right < high):
        if right < high:
            up *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= up
            if u <= 0:
                return right
        if left > low:
            down *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= down
            if u <= 0:
                return left
    return mode


def draw_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Rows of block i that go to shard j: row sums block_rows, column sums shard_rows."""
    rng, left, matrix = random.Random(seed), list(shard_rows), []
    for n in block_rows:
        row, rest = [], sum(left)
        for j, room in enumerate(left):
            k = draw_hypergeometric(rng, room, rest - room, n)
            rest -= room
            n -= k
            row.append(k)
            left[j] -= k
        matrix.append(row)
    return matrix


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def shard(df: DataFrame, key: list[Column], shards: int = SHARDS, seed: int = 7, blocks: int = BLOCKS) -> DataFrame:
    """The rows of df with shard and slot (gapless from 0 in each shard). key: what the random orders are drawn from, together
    with each row's place in df, so that equal rows are dealt out as others are; the draws hold for one layout of df. df is
    written once, as it is read for the counts and for the deal."""
    spark = df.sparkSession
    own = F.monotonically_increasing_id()
    df = Scratch(spark).keep(df.drop("shard", "slot").withColumns({"_block": F.xxhash64(F.lit(seed), *key, own), "_first": F.xxhash64(F.lit(seed + 1), *key, own)}))
    df = df.withColumns({"_block": F.pmod("_block", F.lit(blocks)).cast("int"), "_second": F.xxhash64(F.lit(seed + 2), "_block", "_first")})
    counts = {r["_block"]: r["n"] for r in df.groupBy("_block").agg(F.count("*").alias("n")).collect()}  # BLOCKS rows at most
    total = sum(counts.values())
    matrix = draw_matrix([counts.get(b, 0) for b in range(blocks)], even(total, shards), seed)
    ends = [[sum(row[: j + 1]) for j in range(shards)] for row in matrix]
    bounds = spark.range(1).select(
        F.posexplode(F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>")).alias("_block", "_ends")
    )
    pieces = max(1, math.ceil(total / shards / PIECE_ROWS))
    local = Window.partitionBy("_block").orderBy("_first", "_second")
    sent = (
        df.withColumn("_at", F.row_number().over(local))
        .join(F.broadcast(bounds), "_block")  # BLOCKS rows of `shards` numbers
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_at"))))
        .withColumn("_piece", F.pmod(F.shiftright("_second", 20), F.lit(pieces)).cast("int"))
        .drop("_block", "_ends", "_at")
    )
    in_piece = Window.partitionBy("shard", "_piece").orderBy("_second", "_first")
    sent = sent.withColumn("_slot", F.row_number().over(in_piece) - 1)
    if pieces == 1:
        return sent.withColumn("slot", F.col("_slot").cast("long")).drop("_piece", "_first", "_second", "_slot")
    sent = Scratch(spark).keep(sent)
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sent.groupBy("shard", "_piece").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ).drop("_n")
    return (
        sent.join(offsets, ["shard", "_piece"])
        .withColumn("slot", (F.col("_before") + F.col("_slot")).cast("long"))
        .drop("_piece", "_first", "_second", "_slot", "_before")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    light = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return shard(light, [F.col("doc_id"), F.col("text_crc32")]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
