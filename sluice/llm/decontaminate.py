"""Benchmark decontamination by q-gram lemma filtering.

A passage of a document leaks a benchmark item of m characters when it is within k = m // EDITS_PER edits of the item. By
the q-gram lemma such a passage shares at least m + 1 - q (k + 1) q-grams with the item, and their diagonals (place in the
document minus place in the item) lie within k of each other. So the q-grams of every whole document are looked up among
those of the items, hits are counted in diagonal bands of a width over k that overlap by k, bands that reach the bound are
retained, and each is verified by a banded alignment. Nothing within the edit budget is missed, and nothing beyond it is
reported. Documents are independent: no shuffle, however many documents share a passage.

Items go to the tasks in blocks of at most BLOCK_CHARS characters, so what is broadcast does not grow with the benchmark.

Letters are compared without case (A-Z and the Latin-1 capitals), every white-space character as a space. Defined cases:
null and empty texts and items match nothing; items of fewer than MIN_CHARS characters, for which the lemma demands no shared
q-gram, leak where a text has them verbatim as whole words; items with equal texts are both reported; the best passage (fewest edits, then first) of each document and item is
returned; repeated rows give repeated results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import textcodes
from sluice.llm.common import table

Q = 8
EDITS_PER = 10
MIN_CHARS = 32
BLOCK_CHARS = 4_000_000
LOOKUP_BITS = 22
FAR = 1 << 29
POSTINGS = 1 << 21
TOGETHER = 256  # alignments at a time


def characters(data: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes, without case, white space as spaces; as many as the text has."""
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
    capital = ((chars >= 65) & (chars <= 90)) | ((chars >= 0xC0) & (chars <= 0xDE) & (chars != 0xD7))
    chars[capital] += 32
    chars[(chars >= 9) & (chars <= 13)] = 32
    return chars


def grams(chars: np.ndarray) -> np.ndarray:
    n = max(0, len(chars) - Q + 1)
    codes = np.zeros(n, np.uint64)
    for k in range(Q):
        codes += chars[k : k + n].astype(np.uint64) * textcodes.STEPS[k]
    return textcodes.mix(codes)


class Items:
    """Benchmark items and an index from q-grams to their places. Items of fewer than MIN_CHARS characters, to which the lemma
    says nothing, are kept apart by their length."""

    def __init__(self, ids: list[int], texts: list[str]):
        chars = [characters(np.frombuffer(t.encode(), np.uint8)) for t in texts]
        use = [i for i, c in enumerate(chars) if len(c) >= MIN_CHARS]
        short = [i for i, c in enumerate(chars) if 0 < len(c) < MIN_CHARS]
        self.ids, self.chars = [ids[i] for i in use + short], [chars[i] for i in use + short]
        self.short: dict[int, list[int]] = {}
        for k in range(len(use), len(use) + len(short)):
            self.short.setdefault(len(self.chars[k]), []).append(k)
        long = self.chars[: len(use)]
        self.edits = np.array([len(c) // EDITS_PER for c in long], np.int64)
        self.bound = np.array([len(c) for c in long], np.int64) + 1 - Q * (self.edits + 1)
        self.band = np.array([max(64, 1 << int(k).bit_length()) for k in self.edits], np.int64)
        codes = [grams(c) for c in long]
        flat = np.concatenate([*codes, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([*(np.arange(len(c)) for c in codes), np.zeros(0, np.int64)])
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order], place[order]
        self.codes, self.begin = np.unique(flat[order], return_index=True)
        self.begin = np.append(self.begin, len(flat))
        self.seen = np.zeros(1 << LOOKUP_BITS, bool)
        self.seen[self._slot(self.codes)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes >> np.uint64(64 - LOOKUP_BITS)).astype(np.int64)

    def shared(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in chars of shared q-grams, and their entries in codes."""
        codes = grams(chars)
        at = np.flatnonzero(self.seen[self._slot(codes)])
        where = np.searchsorted(self.codes, codes[at])
        where[where == len(self.codes)] = 0
        exact = self.codes[where] == codes[at]
        return at[exact], where[exact]

    def postings(self, at: np.ndarray, where: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in chars, items and places in the items of shared q-grams, about POSTINGS at a time."""
        many = self.begin[where + 1] - self.begin[where]
        total = np.cumsum(many)
        first = 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(total, total[first] - many[first] + POSTINGS, "right")))
            n, ends = many[first:last], np.cumsum(many[first:last])
            posting = np.repeat(self.begin[where[first:last]] - (ends - n), n) + np.arange(ends[-1])
            yield np.repeat(at[first:last], n), self.item[posting], self.place[posting]
            first = last


def band_costs(items: list[np.ndarray], texts: list[np.ndarray], low: np.ndarray, costs: np.ndarray, budgets: np.ndarray) -> np.ndarray:
    """For each item (a row), the edit costs of the whole item ending after low + len(item) + b characters of its text, for each
    b of the band; costs are those of ending before the item's first character. Costs never fall from step to step: an item
    whose costs are all over its budget is given up."""
    width, sizes = costs.shape[1], np.array([len(x) for x in items])
    most = int(sizes.max())
    item = np.zeros((len(items), most), np.int64)
    window = np.full((len(items), most + width), -1, np.int64)
    place = low[:, None] + np.arange(most + width)
    length = np.array([len(t) for t in texts])[:, None]
    for k, (x, t) in enumerate(zip(items, texts, strict=True)):
        item[k, : len(x)] = x
        begin, end = max(0, int(low[k])), min(len(t), int(low[k]) + most + width)
        if begin < end:
            window[k, begin - low[k] : end - low[k]] = t[begin:end]
    outside = np.where((place >= 0) & (place < length), 0, FAR)
    beyond = np.where((place >= -1) & (place < length), 1, FAR)
    steps, out, row = np.arange(width), np.full(costs.shape, FAR), np.arange(len(items))
    costs = costs.copy()
    for i in range(most):
        replaced = costs + (window[:, i : i + width] != item[:, i, None]) + outside[:, i : i + width]
        dropped = np.full(costs.shape, FAR)
        dropped[:, :-1] = costs[:, 1:]
        dropped += beyond[:, i : i + width]
        costs = np.minimum(np.minimum.accumulate(np.minimum(replaced, dropped) - steps, axis=1) + steps, FAR)
        ended = sizes == i + 1
        if ended.any():
            out[row[ended]] = costs[ended]
        go_on = ~ended
        if i % 8 == 7:
            go_on &= costs.min(axis=1) <= budgets
        if not go_on.all():
            costs, item, window, outside, beyond, sizes, row, budgets = (x[go_on] for x in (costs, item, window, outside, beyond, sizes, row, budgets))
            if not len(row):
                break
    return out


def find(item: np.ndarray, text: np.ndarray) -> int:
    """The first place of the item in the text, or -1."""
    have, want, at = text.tobytes(), item.tobytes(), -1
    while (at := have.find(want, at + 1)) % 4:
        if at < 0:
            return -1
    return at // 4


def align(items: list[np.ndarray], texts: list[np.ndarray], low: np.ndarray, width: np.ndarray, budget: np.ndarray) -> list[tuple[int, int, int] | None]:
    """For each item (edits, start, end) of the best passage of its text whose diagonals lie in low .. low + width, or None
    beyond the budget."""
    found: list[tuple[int, int, int] | None] = [None] * len(items)
    if not items:
        return found
    begin = low[:, None] + np.arange(int(width.max()))
    length = np.array([len(t) for t in texts])[:, None]
    ends = band_costs(items, texts, low, np.where((begin >= 0) & (begin <= length) & (begin < (low + width)[:, None]), 0, FAR), budget)
    ends = np.where(np.arange(ends.shape[1]) < width[:, None], ends, FAR)
    best = ends.argmin(axis=1)
    good = np.flatnonzero(ends[np.arange(len(items)), best] <= budget)
    if not len(good):
        return found
    end = [int(low[k]) + len(items[k]) + int(best[k]) for k in good]
    back = np.arange(2 * int(budget[good].max()) + 1) - budget[good][:, None]
    inside = (back >= 0) & (back <= budget[good][:, None])
    starts = band_costs([items[k][::-1] for k in good], [texts[k][:e][::-1] for k, e in zip(good, end, strict=True)], -budget[good], np.where(inside, back, FAR), budget[good])
    starts = np.where(np.arange(starts.shape[1]) <= 2 * budget[good][:, None], starts, FAR)
    for k, e, s in zip(good.tolist(), end, starts.argmin(axis=1).tolist(), strict=True):
        found[k] = int(ends[k, best[k]]), e - (len(items[k]) - int(budget[k]) + s), e
    return found


def pairs_with_enough(items: Items, at: np.ndarray, where: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """doc * items + item of the pairs that share enough q-grams at all."""
    n = len(items.edits)
    size = (int(doc.max()) + 1) * n
    if size <= POSTINGS:
        count = np.zeros(size, np.int64)
        for k, item, _ in items.postings(np.arange(len(at)), where):
            count += np.bincount(doc[k] * n + item, minlength=size)
        pair = np.flatnonzero(count)
        return pair[count[pair] >= items.bound[pair % n]]
    found: list[np.ndarray] = []
    for k, item, _ in items.postings(np.arange(len(at)), where):
        found.append(np.stack(np.unique(doc[k] * n + item, return_counts=True)))
    pair, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    count = np.bincount(back, np.concatenate([f[1] for f in found]))
    return pair[count >= items.bound[pair % n]]


def leaks(items: Items, chars: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of the leaks in texts that begin at the given places of chars."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for size, own in items.short.items():
        for d, k, start in short_leaks([items.chars[k] for k in own], size, chars, begin):
            best.setdefault((d, own[k]), (0, start, start + size))
    at, where = items.shared(chars)
    doc = np.searchsorted(begin, at, "right") - 1
    whole = at + Q <= begin[doc + 1]
    at, where, doc = at[whole], where[whole], doc[whole]
    pairs = pairs_with_enough(items, at, where, doc) if len(at) else at
    n, keys = len(items.edits), [np.zeros(0, np.int64)]
    longest = max((len(c) for c in items.chars), default=1)
    lowest, bands = -longest // 64 - 2, (len(chars) + longest) // 64 + 5  # of any band's number
    if len(pairs):
        some = np.isin(doc, np.unique(pairs // n))
        at, where, doc = at[some], where[some], doc[some]
        for k, item, place in items.postings(np.arange(len(at)), where):
            pair = np.minimum(np.searchsorted(pairs, doc[k] * n + item), len(pairs) - 1)
            use = pairs[pair] == doc[k] * n + item
            k, item, place, pair = k[use], item[use], place[use], pair[use]
            diagonal = at[k] - begin[doc[k]] - place
            width = items.band[item]
            band = diagonal // width
            also = diagonal - band * width < items.edits[item]
            key = (pair * bands + band - lowest) * longest + place
            keys.append(np.concatenate([key, key[also] - longest]))
    places = np.unique(np.concatenate(keys))  # a place of the item counts once, however often a text repeats its q-gram
    found, count = np.unique(places // longest, return_counts=True)
    owner = pairs[found // bands] if len(found) else found
    enough = count >= items.bound[owner % n] if len(found) else np.zeros(0, bool)
    rest = []
    for pair, band in zip(owner[enough].tolist(), (found[enough] % bands + lowest).tolist(), strict=True):
        d, k, b = pair // n, pair % n, band
        if best.get((d, k), (FAR,))[0] == 0:
            continue  # bands come in order, so a later one has no earlier exact passage
        text, budget, item = chars[begin[d] : begin[d + 1]], int(items.edits[k]), items.chars[k]
        low, width = b * int(items.band[k]) - budget, int(items.band[k]) + 3 * budget + 1
        near = max(0, low)
        exact = find(item, text[near : max(0, low + width - 1 + len(item))])
        if exact >= 0:
            best[d, k] = 0, near + exact, near + exact + len(item)
        else:
            rest.append((d, k, text, low, width, budget))
    rest = [r for r in rest if best.get(r[:2], (FAR,))[0]]
    for first in range(0, len(rest), TOGETHER):
        own = rest[first : first + TOGETHER]
        hits = align([items.chars[r[1]] for r in own], [r[2] for r in own], *(np.array([r[c] for r in own], np.int64) for c in (3, 4, 5)))
        for (d, k, *_), hit in zip(own, hits, strict=True):
            if hit is not None and hit < best.get((d, k), (FAR,)):
                best[d, k] = hit
    for (d, k), (edits, start, end) in sorted(best.items()):
        yield d, k, start, end, edits


def short_leaks(own: list[np.ndarray], size: int, chars: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, item, start) where a text has one of the items, all of the given size, as whole words; the first places first."""
    n = len(chars) - size + 1
    if n <= 0:
        return
    codes = lambda c, m: sum(textcodes.mix(c[k : k + m].astype(np.uint64) + textcodes.STEPS[k]) for k in range(size))
    wanted = np.concatenate([codes(c, 1) for c in own])
    border = np.concatenate([[True], (chars == 32), [True]])
    starts = begin[:-1][begin[:-1] < len(chars)]
    free = border[:n].copy()  # before each place a space or the border of a text
    free[starts[starts < n]] = True
    after = border[size + 1 : size + 1 + n].copy()
    after[begin[1:][begin[1:] >= size] - size] = True
    all_codes = codes(chars, n)
    for at in np.flatnonzero(free & after & np.isin(all_codes, wanted)).tolist():
        d = int(np.searchsorted(begin, at, "right")) - 1
        if at + size <= begin[d + 1]:
            for k in np.flatnonzero(wanted == all_codes[at]).tolist():
                if (own[k] == chars[at : at + size]).all():
                    yield d, k, at - int(begin[d])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_char, end_char, edits) of every document and benchmark item that it leaks."""
    spark = docs.sparkSession
    benchmark = benchmark.filter(F.length("text") > 0).select(F.col("item_id").cast("long"), "text")
    blocks = max(1, math.ceil((benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) / BLOCK_CHARS))
    parts = []
    for block in range(blocks):
        own = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about BLOCK_CHARS
        parts.append(_scan(docs, spark.sparkContext.broadcast(([r.item_id for r in own], [r.text for r in own]))))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


def _scan(docs: DataFrame, shared) -> DataFrame:
    def scan(batches):
        items = Items(*shared.value)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for first, _, data, offsets in textcodes.chunks(batch.column("text")):
                heads = (data & 0xC0) != 0x80
                begin = np.concatenate([[0], np.cumsum(heads)])[offsets]
                for d, k, start, end, edits in leaks(items, characters(data), begin) if items.ids and len(data) else ():
                    for column, value in zip(out, (first + d, items.ids[k], start, end, edits), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(out[0], pa.int64())), *(pa.array(c, pa.int64()) for c in out[1:])],
                ["doc_id", "item_id", "start_char", "end_char", "edits"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        scan, "doc_id long, item_id long, start_char long, end_char long, edits long"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
