import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from sluice.llm import lexical_search

SF = "/root/testdata/sf0.001"


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def brute(docs, items, top):
    tfs = [(d, Counter(terms(t))) for d, t in docs]
    tfs = [(d, c) for d, c in tfs if c]
    n_docs, n_terms, df = len(tfs), sum(sum(c.values()) for _, c in tfs), Counter(w for _, c in tfs for w in c)
    out = []
    for item, text in items.items():
        found = []
        for d, c in tfs:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if c[w])
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(item, k + 1, d, -s) for k, (s, d) in enumerate(sorted(found)[:top])]
    return sorted(out)


def got(spark, docs, items, top=20):
    d = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id long, text string, item_id long, score string").repartition(3)
    i = spark.createDataFrame([(a, b, 2) for a, b in items], "item_id long, text string, doc_id long")
    return sorted(map(tuple, lexical_search.search(d, i, top).collect()))


@pytest.mark.parametrize("at_once", [4096, 5])
def test_every_case_equals_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(lexical_search, "_groups", lambda batches, _, old=lexical_search._groups: old(batches, at_once))
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(4000)]
    docs = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for k in range(150)]
    docs += [(300 + k, docs[3][1]) for k in range(30)] + [(400, None), (401, ""), (402, "?! --"), (None, docs[7][1]), (3, docs[9][1]), (403, "W1 " * 5000 + "Größe 日本")]
    items = [(k, " ".join(rng.choices(words, k=8))) for k in range(25)] + [(50, None), (51, ""), (52, "absent"), (53, "w1 w1 größe 日本"), (54, docs[3][1]), (55, "w2 w2"), (55, "w2 w2"), (None, "w1")]
    assert got(spark, docs, items, 10) == brute(docs, {a: b for a, b in items if a is not None}, 10)


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_CHARS", 20)
    docs, items = [(k, f"common w{k % 7} w{k % 5}x") for k in range(40)], {k: f"w{k % 7} common w{k % 5}x" for k in range(12)}
    assert got(spark, docs, list(items.items()), 4) == brute(docs, items, 4)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == [] and got(spark, [(1, "a")], []) == [] and got(spark, [(1, None)], [(1, "a")]) == []


def test_bounds_hold_and_trie_is_one_tree():
    rng = np.random.default_rng(3)
    own = [np.unique(rng.integers(0, 30, rng.integers(1, 12))) for _ in range(200)] + [np.arange(5)] * 6 + [np.arange(9)] * 2
    vectors = [(ranks, rng.integers(1, 9, len(ranks))) for ranks in own]
    tree = lexical_search.Tree(np.arange(len(own)), rng.integers(75, 300, len(own)), vectors, 30)
    n, kids = len(own), [k.tolist() for k in tree.kids[len(own) :]]
    assert sorted(x for k in kids for x in k) == list(range(n + len(kids) - 1))  # every node but the root has one parent
    terms_, weight = np.array([1, 4, 17]), np.array([50, 200, 900])
    bound = tree.bounds(np.arange(n + len(kids)), terms_, weight)
    for k, children in enumerate(kids):
        assert all(bound[n + k] >= bound[c] for c in children)
    shared = [set.intersection(*(set(np.flatnonzero(tree.most[c])) for c in k)) for k in kids]
    assert max(len(s) for s in shared) >= 5  # paths are shared


def test_query_equals_sql(spark):
    rows = lexical_search.query(spark, SF)
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(lexical_search.ORACLE_SQL)
    assert sorted(map(tuple, rows.select(*want.columns).collect())) == sorted(want.fetchall())
