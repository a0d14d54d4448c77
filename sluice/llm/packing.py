"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Tokens: a worker keeps a bounded memory of word codes and their token ids and hands only unseen words to the tokenizer. The
tokenizer never joins text over white space, so ids by word are the ids of the whole text.

Packing: pieces are dealt at random into demes of about DEME_SIZE pieces. Each deme lives on ISLANDS islands. An island
evolves a small population: crossover injects whole well-filled bins of one parent into the other, drops the bins that
hold duplicates, and best-fits the displaced pieces; then each island's elite moves to its neighbour and evolution goes on
from both. The best island of a deme wins. Bins with more than SLACK tokens free are opened again, their pieces dealt into
new, fewer demes, and so on until one deme is left or nothing is gained. A deme has a fixed size, so memory per task does
not depend on the input.

Defined cases: null and empty texts are one piece of one token, the end token; a text of more than CAPACITY tokens is cut
into CAPACITY-token pieces; null or repeated ids are packed like others (row by row); an empty table gives no rows.
"""

from __future__ import annotations

import os
import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm import textcodes
from sluice.llm.common import Scratch, table

CAPACITY = 4096
END_ID = 1
REMEMBERED = 1_000_000
DEME_SIZE = 2048
ISLANDS = 2
POPULATION = 4
GENERATIONS = 4
SLACK = 8
LEVELS = 5


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens:
    """Token ids by word code: sorted codes with the place of their ids in one flat array; emptied when full."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.codes, self.begin, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.uint16)
        self.used = 0

    def learn(self, codes: np.ndarray, new: list[str]) -> None:
        lengths, ids = [], []
        for i in range(0, len(new), 256):
            group = new[i : i + 256]
            found = self.tokenizer.encode(group, is_pretokenized=True, add_special_tokens=False)
            lengths.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(group)))
            ids.append(np.array(found.ids, np.uint16))
        lengths, ids = np.concatenate(lengths), np.concatenate(ids)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        at = np.searchsorted(self.codes, codes)
        self.codes, self.begin, self.length = np.insert(self.codes, at, codes), np.insert(self.begin, at, begin), np.insert(self.length, at, lengths)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offsets of the texts in them."""
        codes, starts, ends, first = textcodes.words(data, offsets)
        if len(self.codes) > REMEMBERED:
            self.clear()
        distinct, where, back = np.unique(codes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.codes, distinct), max(0, len(self.codes) - 1))
        unseen = self.codes[at] != distinct if len(self.codes) else np.ones(len(distinct), bool)
        if unseen.any():
            raw = data.tobytes()
            spans = zip(starts[where[unseen]].tolist(), ends[where[unseen]].tolist(), strict=True)
            self.learn(distinct[unseen], [raw[a:b].decode() for a, b in spans])
            at = np.searchsorted(self.codes, distinct)
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        length = self.length[at][back]
        ends_ = np.cumsum(length)
        total = int(ends_[-1])
        shift = np.repeat(self.begin[at][back] - (ends_ - length), length)
        return self.flat[shift + np.arange(total)].astype(np.uint32), np.concatenate([[0], ends_])[first]


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One per worker process, so that later tasks go on with the words that earlier ones have met."""
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, deal) of every row; deal is a number to deal pieces by."""

    def cut(batches):
        tokens, lane, k = word_tokens(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, out = batch.column("doc_id"), ([], [], [], [], [], [])
            for first, _, data, offsets in textcodes.chunks(batch.column("text")):
                every, begin = tokens.encode(data, offsets)
                for i in range(len(offsets) - 1):
                    own = np.append(every[begin[i] : begin[i + 1]], np.uint32(END_ID)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        k += 1
                        for column, value in zip(out, (first + i, piece, start, len(part), zlib.crc32(part.tobytes()), random.Random(lane << 40 | k).getrandbits(62)), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "deal"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, deal long")


def best_fit(sizes: list[int], order: list[int], bins: list[list[int]], free: list[int], capacity: int) -> None:
    """Puts each piece in the fullest bin that has room for it, or in a new one."""
    rooms = sorted((f, b) for b, f in enumerate(free))
    for i in order:
        at = bisect_left(rooms, (sizes[i], -1))
        if at == len(rooms):
            bins.append([i])
            free.append(capacity - sizes[i])
            insort(rooms, (free[-1], len(bins) - 1))
        else:
            _, b = rooms.pop(at)
            bins[b].append(i)
            free[b] -= sizes[i]
            insort(rooms, (free[b], b))


def pack(sizes: list[int], order: list[int], capacity: int) -> list[list[int]]:
    bins: list[list[int]] = []
    best_fit(sizes, order, bins, [], capacity)
    return bins


def cross(sizes: list[int], one: list[list[int]], two: list[list[int]], rng: random.Random, capacity: int) -> list[list[int]]:
    """Injects well-filled bins of two into one, drops bins of one that share a piece, best-fits what was displaced."""
    fill = sorted(two, key=lambda b: -sum(sizes[i] for i in b))
    inject = [b for b in fill[: max(1, len(fill) // 2)] if rng.random() < 0.5] or fill[:1]
    taken = {i for b in inject for i in b}
    kept = [b for b in one if taken.isdisjoint(b)]
    bins = [list(b) for b in inject + kept]
    displaced = sorted({i for b in one if not taken.isdisjoint(b) for i in b} - taken, key=lambda i: -sizes[i])
    best_fit(sizes, displaced, bins, [capacity - sum(sizes[i] for i in b) for b in bins], capacity)
    return bins


def fitness(sizes: list[int], bins: list[list[int]]) -> tuple[int, int]:
    """Fewer bins first, then the more uneven fill, which leaves room to gain."""
    return len(bins), -sum(sum(sizes[i] for i in b) ** 2 for b in bins)


def evolve(sizes: list[int], seed: int, own: list[int] | None, guest: list[int] | None, capacity: int = CAPACITY) -> list[int]:
    """The bin of each piece after GENERATIONS generations, from the given elites or from perturbed best-fit packings."""
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    by_size = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    people = [_bins(x) for x in (own, guest) if x is not None] or [pack(sizes, by_size, capacity)]
    best = min(people, key=lambda p: fitness(sizes, p))
    if len(best) > least:
        while len(people) < POPULATION:
            noisy = sorted(range(len(sizes)), key=lambda i: -sizes[i] * rng.uniform(0.7, 1.0))
            people.append(pack(sizes, noisy, capacity))
        for _ in range(GENERATIONS):
            children = [cross(sizes, *rng.sample(people, 2), rng, capacity) for _ in range(POPULATION)]
            people = sorted(people + children, key=lambda p: fitness(sizes, p))[:POPULATION]
            if len(people[0]) == least:
                break
        best = people[0]
    found = [0] * len(sizes)
    for b, bin_ in enumerate(best):
        for i in bin_:
            found[i] = b
    return found


def _bins(found: list[int]) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(max(found) + 1)]
    for i, b in enumerate(found):
        bins[b].append(i)
    return bins


def _evolve_column(capacity: int):
    @F.pandas_udf("array<int>")
    def run(sizes: pd.Series, seed: pd.Series, own: pd.Series, guest: pd.Series) -> pd.Series:
        as_list = lambda x: None if x is None else [int(v) for v in x]
        return pd.Series([evolve(as_list(s), int(k), as_list(a), as_list(b), capacity) for s, k, a, b in zip(sizes, seed, own, guest, strict=True)])

    return run


def evolve_demes(scratch: Scratch, pieces: DataFrame, demes: int, capacity: int) -> DataFrame:
    """pieces with deme, bin, fill (of its bin) and offset."""
    run = _evolve_column(capacity)
    dealt = pieces.withColumn("deme", F.pmod(F.xxhash64("deal", F.lit(demes)), F.lit(demes)))
    items = dealt.groupBy("deme").agg(F.sort_array(F.collect_list(F.struct("deal", "length", "doc_id", "piece", "start", "ids_crc32"))).alias("items"))
    items = scratch.keep(items)
    nobody = F.lit(None).cast("array<int>")
    seed = F.col("deme") * ISLANDS + F.col("island")
    first = items.select("deme", F.col("items.length").alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    first = first.withColumn("bins", run("sizes", seed, nobody, nobody))
    shores = first.groupBy("deme").agg(F.first("sizes").alias("sizes"), F.sort_array(F.collect_list(F.struct("island", "bins"))).alias("elites"))
    second = shores.select("deme", "sizes", "elites", F.explode("elites.island").alias("island"))
    second = second.select(
        "deme", "island",
        run(
            "sizes", seed + (1 << 30), F.get(F.col("elites"), F.col("island"))["bins"],
            F.get(F.col("elites"), (F.col("island") + 1) % ISLANDS)["bins"],
        ).alias("bins"),
    )
    best = second.groupBy("deme").agg(F.min_by("bins", F.struct(F.array_max("bins"), F.col("island"))).alias("bins"))
    placed = items.join(best, "deme").select("deme", F.explode(F.arrays_zip("items", "bins")).alias("x")).select("deme", "x.items.*", F.col("x.bins").alias("bin"))
    bin_ = Window.partitionBy("deme", "bin")
    before = F.sum("length").over(bin_.orderBy("deal").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return scratch.keep(placed.withColumn("offset", before).withColumn("fill", F.sum("length").over(bin_)))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, deme_size: int = DEME_SIZE) -> DataFrame:
    """The pieces with sequence_id and offset."""
    scratch = Scratch(pieces.sparkSession)
    left, count, settled, demes = pieces, pieces.count(), [], None
    for level in range(LEVELS):
        fewer = max(1, round(count / deme_size))
        placed = evolve_demes(scratch, left, fewer, capacity).withColumn(
            "sequence_id", F.lit(level).cast("long") * (1 << 56) + F.col("deme") * (1 << 24) + F.col("bin")
        )
        if demes is not None and placed.select("sequence_id").distinct().count() >= opened.select("sequence_id").distinct().count():
            settled.append(opened)  # nothing gained: the bins stay as they were
            break
        opened = placed.filter(F.col("fill") < capacity - SLACK)
        count, demes = opened.count(), fewer
        if fewer == 1 or count == 0 or level == LEVELS - 1:
            settled.append(placed)
            break
        settled.append(placed.filter(F.col("fill") >= capacity - SLACK))
        left = opened.select(pieces.columns)
    whole = settled[0]
    for s in settled[1:]:
        whole = whole.unionByName(s)
    return whole.select(*pieces.columns, "sequence_id", F.col("offset").cast("long"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    pieces = Scratch(docs.sparkSession).keep(cut_pieces(docs, path or default_tokenizer_path(), capacity))
    return pack_pieces(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
