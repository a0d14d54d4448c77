"""Line dedup as an exact set-similarity self-join, in DataFrame functions only.

A line's tokens are its distinct five-word shingles (of a line with fewer words: the whole line). A line goes when an
earlier line of any document (by doc_id, then line number) has Jaccard similarity of PERCENT / 100 or more with it.

Lines with equal tokens form a class, represented by its first line; all but the first of a class go. Between classes:
tokens are ordered by rarity (the tokens of all lines are counted in BUCKETS counters, a fixed size; those of fuller ones
come last; then the token; any order is exact), each class keeps the prefix that a partner must share a token with, and postings are the tokens found in the prefixes of two or
more classes. Length and positional filters bound the overlap before verification, and so does a sketch of each class, 64 bits
of which every token turns one over: two sets differ in as many tokens at least as their sketches do in bits (lines of
hundreds of words fill it, so it spares nothing there). First each class is compared with the
one that is the earliest class of most of its postings; a match settles it. Only classes that stay unsettled are compared with every earlier
class in their postings. So a group of near copies costs one comparison per member and token, and nothing is missed.

Defined cases: null text stays null and has no lines; lines without words are never removed; null ids come last in the
order; rows that repeat a doc_id are ordered by a hash of their text, and rows equal in id and text share their fate; input
columns n_lines and n_removed are replaced, others pass through; an empty table gives no rows.
"""

from __future__ import annotations

from math import log2
from statistics import median

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, table

PERCENT = 75
WORDS = 5
BITS = 17
BUCKETS = 1 << BITS
RANK_BITS = 7  # 16 ranks for each power of two; as a byte of ASCII
LAST = (1 << 63) - 1


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def with_tokens(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds tokens: the distinct codes of the line's shingles. Explode it by explode_outer alone: the filter that explode
    implies would be pushed below and compute the whole expression again for every shingle."""
    other = F.contains(F.col(line), F.lit("\t")) | F.contains(F.col(line), F.lit("\v")) | F.contains(F.col(line), F.lit("\f")) | F.contains(F.col(line), F.lit("\r"))
    split = F.when(other | F.contains(F.col(line), F.lit("\n")), F.split(line, "[ \\t-\\r]+")).otherwise(F.split(line, " "))  # one letter needs no regular expression
    lines = lines.withColumn("_w", F.array_remove(split, ""))
    lines = lines.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).withColumn("_n", F.size("_w"))
    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("_n") - WORDS, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(WORDS)]),
    )
    tokens = F.when(F.col("_n") >= WORDS, F.array_distinct(windows)).when(F.col("_n") > 0, F.array(F.xxhash64(F.lit(WORDS), "_h")))
    return lines.withColumn("tokens", tokens).drop("_w", "_h", "_n")


def _keys(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "_t": F.xxhash64("text")})


def _lines(docs: DataFrame) -> DataFrame:
    return _keys(docs).select("_d", "_t", F.posexplode_outer(_split(F.col("text"))).alias("line_no", "line")).filter(F.col("line").rlike("[^ \\t-\\r]"))


def bucket_ranks(tokenized: DataFrame) -> bytes:
    """A byte for each bucket of tokens: by how many sixteenths of a power of two it has more tokens than the usual bucket."""
    few = tokenized.coalesce(tokenized.sparkSession.sparkContext.defaultParallelism)  # a task has up to BUCKETS counters to send
    bucket = F.shiftrightunsigned(F.col("t"), 64 - BITS).cast("int").alias("bucket")
    counts = dict(few.select(F.explode("tokens").alias("t")).groupBy(bucket).count().collect())  # BUCKETS rows whatever the input
    usual = median(counts.values()) if counts else 1
    return bytes(min((1 << RANK_BITS) - 1, max(0, int(16 * log2(counts[k] / usual)))) if k in counts else 0 for k in range(BUCKETS))


def by_rarity(tokens: str, ranks: bytes) -> Column:
    """The sorted keys of the tokens: the rank of a token's bucket, then the token without its last bits. Tokens that share
    a key only add pairs to verify."""
    rank = lambda t: F.ascii(F.substring(F.lit(ranks), F.shiftrightunsigned(t, 64 - BITS).cast("int") + 1, F.lit(1)).cast("string"))
    key = lambda t: F.shiftleft(rank(t).cast("long"), 63 - RANK_BITS).bitwiseOR(F.shiftrightunsigned(t, RANK_BITS + 1))
    return F.sort_array(F.transform(tokens, key))


def signatures(tokenized: DataFrame, ranks: bytes) -> DataFrame:
    """(_d, _t, line_no, n, sig_a, sig_b, sketch, prefix) of every line with words."""
    n = F.size("tokens")
    prefix = F.slice(by_rarity("tokens", ranks), F.lit(1), n - least_shared(n) + 1)
    return tokenized.select("_d", "_t", "line_no", n.alias("n"), F.xxhash64("tokens").alias("sig_a"), F.xxhash64(F.lit(1), "tokens").alias("sig_b"), sketch("tokens").alias("sketch"), prefix.alias("prefix"))


def sketch(tokens: str) -> Column:
    """64 bits, each of which tells whether the tokens with its number are odd in number."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.hash(t))  # noqa: E731  a shift takes six bits of it
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, t: bits.bitwiseXOR(bit(t)))


def least_shared(n: Column) -> Column:
    return F.ceil(n * PERCENT / F.lit(100)).cast("int")


def _may_match(a: str, b: str) -> Column:
    """Length, prefix and positional filters for a token at place i of both lines' orders: similar lines of n and m tokens
    share at least o = ceil(75 (n + m) / 175), so the rarest shared one is among the first n - o + 1 and m - o + 1; and at
    most min(i, i') tokens are shared before this one and min(n - i, m - i') from it on."""
    n, m, i, j = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.i"), F.col(f"{b}.i")
    needed = F.ceil((n + m) * PERCENT / F.lit(100 + PERCENT))
    before = (F.least(i, j) + F.least(n - i, m - j)) * (100 + PERCENT) >= PERCENT * (n + m)
    return _sizes_fit(a, b) & before & (i <= n - needed) & (j <= m - needed)


def _sketches_fit(a: str, b: str) -> Column:
    """Similar lines of n and m tokens differ in at most 25 (n + m) / 175 of them, and each of those turns one bit over."""
    bits = F.bit_count(F.col(f"{a}.sketch").bitwiseXOR(F.col(f"{b}.sketch")))
    return (100 + PERCENT) * bits <= (100 - PERCENT) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _sizes_fit(a: str, b: str) -> Column:
    return 100 * F.least(f"{a}.n", f"{b}.n") >= PERCENT * F.greatest(f"{a}.n", f"{b}.n")


def _verified(scratch: Scratch, pairs: DataFrame, docs: DataFrame, named: DataFrame) -> DataFrame:
    """The ids x of the pairs (x, y) that are similar enough; only lines that some pair needs are read again."""
    ids = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct().join(named, "id")
    wanted = ids.select("first._d", "first._t", "first.line_no", "id")
    # a row for each line, none of which carries its text; rows equal in id and text give their lines once
    texts = _lines(docs).join(wanted, ["_d", "_t", "line_no"]).select("id", "line").dropDuplicates(["id"])
    vectors = scratch.keep(with_tokens(texts).select("id", "tokens"))
    x, y = (vectors.select(F.col("id").alias(k), F.col("tokens").alias(f"t{k}")) for k in "xy")
    both = F.size(F.array_intersect("tx", "ty"))
    similar = 100 * both >= PERCENT * (F.size("tx") + F.size("ty") - both)
    found = scratch.keep(pairs.join(x, "x").join(y, "y").filter(similar).select(F.col("x").alias("id")).distinct())
    scratch.drop(vectors)
    return found


def removed_lines(docs: DataFrame) -> tuple[Scratch, DataFrame]:
    """(_d, _t, line_no) of every line that goes, and the scratch folder that holds it."""
    scratch = Scratch(docs.sparkSession)
    tokenized = scratch.keep(with_tokens(_lines(docs)).select("_d", "_t", "line_no", F.sort_array("tokens").alias("tokens")))
    signed = scratch.keep(signatures(tokenized, bucket_ranks(tokenized)))
    scratch.drop(tokenized)
    tokens = signed.select("sig_a", "n", F.posexplode("prefix").alias("i", "token"))
    several = tokens.groupBy("token").agg(F.min("sig_a").alias("x"), F.max("sig_a").alias("y")).filter("x < y").select("token")
    several = scratch.keep(several)  # in the prefixes of two or more classes
    shared = scratch.keep(tokens.join(several, "token").distinct())
    lines = scratch.keep(signed.drop("prefix"))
    scratch.drop(several, signed)
    classes = scratch.keep(
        lines.groupBy("sig_a", "sig_b", "n").agg(F.min(F.struct("_d", "_t", "line_no")).alias("first"), F.min("sketch").alias("sketch")).withColumnRenamed("sig_a", "id")
    )
    named = classes.select("id", "first", "sketch")
    postings = scratch.keep(shared.withColumnRenamed("sig_a", "id").join(named, "id").select("token", F.struct("first", "id", "n", "i", "sketch").alias("own")))
    scratch.drop(shared)

    leaders = postings.groupBy("token").agg(F.min("own").alias("lead"))
    pairs = scratch.keep(
        postings.join(leaders, "token").filter((F.col("own.id") != F.col("lead.id")) & _may_match("own", "lead") & _sketches_fit("own", "lead"))
        .groupBy(F.col("own.id").alias("x"), F.col("lead.id").alias("y")).agg(F.count("*").alias("shared"))
        .groupBy("x").agg(F.max(F.struct("shared", "y")).alias("best")).select("x", "best.y")  # the others are left to the last step
    )
    settled = _verified(scratch, pairs, docs, named)
    unsettled = postings.join(settled.withColumn("done", F.lit(True)), F.col("own.id") == F.col("id"), "left").filter("done IS NULL").select("token", "own")
    after = F.least(F.first(F.col("own.n")) - F.max("own.i"), F.first(F.col("other.n")) - F.max("other.i")) - 1
    rest = (
        unsettled.join(postings.withColumnRenamed("own", "other"), "token")
        .filter((F.col("other.first") < F.col("own.first")) & _may_match("own", "other") & _sketches_fit("own", "other"))
        .groupBy(F.col("own.id").alias("x"), F.col("other.id").alias("y"))
        .agg((F.count("*") + after).alias("most"), F.first(F.col("own.n") + F.col("other.n")).alias("sum"))  # those up to the last place in the join, and what follows it at most
        .filter(100 * F.col("most") >= PERCENT * (F.col("sum") - F.col("most"))).select("x", "y")
        .join(pairs, ["x", "y"], "left_anti")
    )
    settled = settled.union(_verified(scratch, scratch.keep(rest), docs, named))
    scratch.drop(postings, pairs)
    fate = classes.join(settled.withColumn("matched", F.lit(True)), "id", "left").select(F.col("id").alias("sig_a"), "sig_b", "n", "first", "matched")
    gone = scratch.keep(
        lines.join(fate, ["sig_a", "sig_b", "n"]).filter(F.col("matched") | (F.col("first") != F.struct("_d", "_t", "line_no"))).select("_d", "_t", "line_no")
    )
    scratch.drop(lines, classes)
    return scratch, gone


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs, their text without the removed lines, with n_lines and n_removed."""
    _, gone = removed_lines(docs)
    gone = gone.groupBy("_d", "_t").agg(F.collect_set("line_no").alias("_gone"))
    lines = _split(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n"))
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return (
        _keys(docs).join(gone, ["_d", "_t"], "left").withColumn("_lines", lines)
        .withColumns({"text": kept, "n_lines": count("_lines"), "n_removed": count("_gone")})
        .select(*columns, "n_lines", "n_removed")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, line_no, line, row_number() OVER (ORDER BY doc_id, line_no) AS id
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
), w AS (
  SELECT id, list_filter(string_split_regex(line, '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM l
), g AS (
  SELECT DISTINCT id, array_to_string(ws[i:i + {WORDS - 1}], ' ') AS t
  FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - {WORDS - 2}, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT id, count(*) AS n FROM g GROUP BY id
), gone AS (
  SELECT DISTINCT a.id FROM (
    SELECT a.id, b.id AS other, count(*) AS c FROM g AS a JOIN g AS b ON a.t = b.t AND b.id < a.id GROUP BY a.id, b.id
  ) AS a JOIN n ON n.id = a.id JOIN n AS m ON m.id = a.other WHERE 100 * c >= {PERCENT} * (n.n + m.n - c)
)
SELECT doc_id, count(line_no) AS n_lines, count(gone.id) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (gone.id IS NULL), '')) AS kept_md5
FROM l LEFT JOIN gone USING (id) GROUP BY doc_id
"""
