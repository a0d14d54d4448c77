"""Ranked lexical search: the best documents for each item of a query set, by whole-number scores of the BM25 kind.

Items go in blocks of BLOCK_CHARS of text. For a block, one pass over the documents writes each one's restricted vector: how
often it has which terms of the block. From these come document frequencies and the weights of terms. Each task then takes its
vectors in groups, orders every document's terms by frequency, most frequent first, and sorts the documents, so that those with
equal beginnings share the path of a trie; a node of the trie is a run of documents and keeps the greatest tf of every term
and the least m below it. A score grows with every tf and falls with m, so the score of such a node's numbers bounds all that is below.
For each item a depth-first search takes the children with the best bound first and leaves those whose bound is under the score
of the last of the best found so far, which a task keeps from trie to trie. Of the tasks' best, a window keeps the best of
all, first by parts of each item, then by item.

Defined cases: a null or empty text has no terms; an item without terms, or with none that any document has, has no rows; of
rows that repeat an item_id the one with the least text is the item, and an item without an id is left out; rows that repeat a doc_id are documents of their own;
documents without an id count in N, L and df, but are not found; empty tables give no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, table
from sluice.llm.terms import pieces, words

TOP = 20
BLOCK_CHARS = 1 << 18
#: Documents and cells (nodes times terms) of one trie.
TREE_DOCS, TREE_CELLS = 4096, 1 << 24
#: So many nodes of the search's stack are taken together.
TAKEN = 16
PARTS = 32
SCALE, UNIT = 1000, 1_000_000_000


def item_terms(texts: list[str]) -> list[list[bytes]]:
    found: list[list[bytes]] = [[] for _ in texts]
    for first, own in pieces(pa.array(texts, pa.large_string())):
        for owner, block in words(own):
            for k, w in zip(owner.tolist(), block, strict=True):
                found[first + k].append(w)
    return found


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, ids, tfs) of every document with a term: the number of all its terms, and which of the vocabulary it has how
    often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one block of items

    def restrict(batches):
        known = shared.value
        size = max(1, len(known))
        for batch in batches:
            n, keys, counts, rows = np.zeros(batch.num_rows, np.int64), [], [], np.zeros(batch.num_rows + 1, np.int64)
            for first, texts in pieces(batch.column("text")):
                own = []
                for owner, block in words(texts):
                    n[first : first + len(texts)] += np.bincount(owner, minlength=len(texts))
                    code = np.fromiter(map(known.get, block, repeat(-1)), np.int64, len(block))
                    own.append((owner * size + code)[code >= 0])
                key, count = np.unique(np.concatenate(own) if own else np.zeros(0, np.int64), return_counts=True)
                rows[first + 1 : first + len(texts) + 1] = np.bincount(key // size, minlength=len(texts))
                keys.append(key % size)
                counts.append(count)
            offsets = pa.array(np.cumsum(rows), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c) if c else [], pa.int32())) for c in (keys, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "ids", "tfs"]).filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(restrict, "doc_id long, n long, ids array<int>, tfs array<int>")


class Tree:
    """The trie of some documents. Row k < n of most, least and kids is document k; the others are inner nodes, the last one the
    root. most: greatest tf of each term; least: least m."""

    def __init__(self, doc_ids: np.ndarray, m: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        """vectors: (ranks by frequency, tfs) of each document, ranks ascending."""
        order = sorted(range(len(vectors)), key=lambda k: vectors[k][0].astype(">u4").tobytes())
        self.doc_ids, n = doc_ids[order], len(order)
        paths = [vectors[k][0] for k in order]
        inner = _inner_nodes([len(p) for p in paths], [_shared(a, b) for a, b in zip(paths, paths[1:], strict=False)])
        self.most, self.least = np.zeros((n + len(inner), terms), np.int32), np.zeros(n + len(inner), np.int64)
        self.least[:n] = m[order]
        for row, k in enumerate(order):
            self.most[row, vectors[k][0]] = vectors[k][1]
        self.kids = [None] * n + [np.array(own) for own in inner]
        for row in range(n, n + len(inner)):  # children come before their parents
            own = self.kids[row]
            self.most[row], self.least[row] = self.most[own].max(axis=0), self.least[own].min()

    def bounds(self, rows: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of documents the scores, of inner nodes what no score below them passes."""
        tf = self.most[rows[:, None], terms].astype(np.int64)
        return ((UNIT * tf) // (SCALE * tf + 12 * self.least[rows][:, None])) @ weight

    def search(self, terms: np.ndarray, weight: np.ndarray, scores: np.ndarray, found: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """The best top of (scores, found) and this tree's documents with a score above 0, best first, ties to the smaller id."""
        n, root = len(self.doc_ids), len(self.kids) - 1
        lowest = int(scores[-1]) if len(scores) == top else 1
        stack = [(int(self.bounds(np.array([root]), terms, weight)[0]), root)]
        while stack:
            taken = [row for bound, row in stack[-TAKEN:] if bound >= lowest]
            del stack[-TAKEN:]
            if not taken:
                continue
            own = np.concatenate([self.kids[row] for row in taken])
            bound = self.bounds(own, terms, weight)
            keep = bound >= lowest
            own, bound = own[keep], bound[keep]
            leaf = own < n
            if leaf.any():
                scores, found = np.concatenate([scores, bound[leaf]]), np.concatenate([found, self.doc_ids[own[leaf]]])
                best = np.lexsort((found, -scores))[:top]
                scores, found = scores[best], found[best]
                lowest = int(scores[-1]) if len(scores) == top else 1
            if not leaf.all():
                deeper = ~leaf
                stack += sorted(zip(bound[deeper].tolist(), own[deeper].tolist(), strict=True))
        return scores, found


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many terms two paths share from the root."""
    k = min(len(a), len(b))
    differ = a[:k] != b[:k]
    return int(differ.argmax()) if differ.any() else k


def _inner_nodes(sizes: list[int], shared: list[int]) -> list[list[int]]:
    """The children of every inner node of a trie of sorted paths, children before parents, the root last. A node is where paths
    part, or where a path ends on its own or another document's way; its number is len(sizes) plus its place in the list."""
    inner: list[list[int]] = []
    stack: list[tuple[int, list[int]]] = [(0, [])]  # (depth, children so far) from the root down
    for k in range(len(sizes)):
        depth = max(shared[k - 1] if k else 0, shared[k] if k < len(shared) else 0)  # of the deepest node that holds document k
        after = shared[k] if k < len(shared) else 0
        if stack[-1][0] < depth:
            stack.append((depth, []))
        stack[-1][1].append(k)
        while stack[-1][0] > after:
            closed = stack.pop()[1]
            inner.append(closed)
            if stack[-1][0] < after:
                stack.append((after, []))
            stack[-1][1].append(len(sizes) + len(inner) - 1)
    inner.append(stack.pop()[1])
    return inner


def _groups(batches, docs_at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(doc_ids, n, vectors) of so many documents at a time; documents without a term of the block or without an id are left out."""
    ids, n, own = [], [], []
    for batch in batches:
        offsets = batch.column("ids").offsets.to_numpy()
        terms, tfs = (batch.column(c).values.to_numpy(zero_copy_only=False) for c in ("ids", "tfs"))
        for k, (doc_id, size) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), strict=True)):
            a, b = offsets[k], offsets[k + 1]
            if doc_id is None or a == b:
                continue
            ids.append(doc_id)
            n.append(size)
            own.append((terms[a:b].copy(), tfs[a:b].copy()))
            if len(ids) == docs_at_once:
                yield np.array(ids), np.array(n), own
                ids, n, own = [], [], []
    if ids:
        yield np.array(ids), np.array(n), own


def _search_block(scratch: Scratch, docs: DataFrame, items: list, top: int) -> DataFrame:
    """(item_id, doc_id, score): for each of some items (item_id, terms) the best documents of every task."""
    spark = docs.sparkSession
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, own in items for w in own))}
    kept = scratch.keep(vectors(docs, vocabulary))
    n_docs, n_terms = kept.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in kept.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).collect():  # one row a term of the block
        df[r.id] = r.df
    weight = np.array([math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    rank = np.empty(len(df), np.int64)
    rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    queries = []
    for item_id, own in items:
        code, times = np.unique(np.array([vocabulary[w] for w in own], np.int64), return_counts=True)
        used = df[code] > 0
        queries.append((item_id, rank[code[used]], (weight[code] * times)[used]))
    shared = spark.sparkContext.broadcast((rank, queries))
    docs_at_once = max(64, min(TREE_DOCS, TREE_CELLS // (2 * max(1, len(vocabulary)))))

    def search(batches):
        rank, queries = shared.value
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(queries)
        for ids, n, own in _groups(batches, docs_at_once):
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            ranked = [(rank[terms], tfs) for terms, tfs in own]
            used, places = np.unique(np.concatenate([r for r, _ in ranked]), return_inverse=True)  # the terms of these documents
            ends = np.cumsum([len(r) for r, _ in ranked])
            ranked = [(places[e - len(r) : e], tfs) for e, (r, tfs) in zip(ends, ranked, strict=True)]
            ordered = [(r[o], tfs[o]) for r, tfs in ranked for o in [np.argsort(r)]]
            tree = Tree(ids, m, ordered, len(used))
            for k, (_, terms, weight) in enumerate(queries):
                here = np.isin(terms, used)
                if here.any():
                    best[k] = tree.search(np.searchsorted(used, terms[here]), weight[here], *best[k], top)
        sizes = [len(s) for s, _ in best]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([q[0] for q in queries], sizes), pa.int64()), pa.array(np.concatenate([none, *(d for _, d in best)]), pa.int64()),
                pa.array(np.concatenate([none, *(s for s, _ in best)]), pa.int64()),
            ],
            ["item_id", "doc_id", "score"],
        )

    return kept.mapInArrow(search, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): of every item (item_id, text) the top documents (doc_id, text) with the highest scores above
    0, ties to the smaller doc_id."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    items = items.select(F.col("item_id").cast("long"), "text").filter("item_id IS NOT NULL AND length(text) > 0").groupBy("item_id").agg(F.min("text").alias("text"))
    items = scratch.keep(items)
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / BLOCK_CHARS))
    parts = []
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about BLOCK_CHARS
        own = [(r.item_id, terms) for r, terms in zip(own, item_terms([r.text for r in own]), strict=True) if terms]
        if own:
            parts.append(_search_block(scratch, docs, own, top))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    for keys in (("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), ("item_id",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))
        found = found.withColumn("rank", place).filter(F.col("rank") <= top)
    return found.select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LETTERS = ", ".join(f"'{''.join(chr(c + k) for k in range(26))}'" for c in (65, 97))
_LOW = f"translate(coalesce(text, ''), {_LETTERS})"

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_TERM}') AS ws FROM documents),
sizes AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n FROM d WHERE len(ws) > 0),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
q AS (SELECT item_id, w, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOW}, '{_TERM}')) AS w FROM benchmark) GROUP BY item_id, w),
tf AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY doc_id, w),
weights AS (SELECT w, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT w, count(*) AS df FROM tf GROUP BY w), corpus),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN weights USING (w) JOIN tf USING (w) JOIN sizes USING (doc_id), corpus GROUP BY item_id, doc_id
)
SELECT item_id, CAST(r AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scores WHERE score > 0) WHERE r <= 20
"""
