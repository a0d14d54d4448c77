import random

import numpy as np
from brute import component_ids, shingle_set

from sluice.llm import jaccard_join


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = {}
    base = [[rng.choice(vocab) for _ in range(rng.randint(3, 120))] for _ in range(20)]
    passage = [rng.choice(vocab) for _ in range(30)]
    for d in range(160):
        w = list(rng.choice(base)) if d % 3 else [rng.choice(vocab) for _ in range(rng.randint(1, 60))]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if d % 5 == 0:
            w = w + passage
        texts[d] = " ".join(w) if d % 7 else "\n".join(w).upper()
    texts[160], texts[161], texts[162], texts[163] = None, "", " \t ", " ".join(vocab * 30)
    return texts


def test_components_equal_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in texts.items()], "doc_id long, text string, n int, prefix string")
    got = {r.doc_id: r for r in jaccard_join.join(df)[0].collect()}
    want = component_ids(texts)
    assert {d: r.component_id for d, r in got.items()} == want
    assert {d: r.n_shingles for d, r in got.items()} == {d: len(shingle_set(t)) for d, t in texts.items()}
    assert len(set(want.values())) < len(want) - 40


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert jaccard_join.join(df.filter("false"))[0].count() == 0
    got = sorted((r.doc_id or -1, r.component_id) for r in jaccard_join.join(df)[0].collect())
    assert got == [(-1, None), (1, 1), (1, 1)]


def test_parts_of_many_documents_bring_no_pairs(spark, monkeypatch):
    """Every shingle but four is in ten documents, none of which is linked to it: places fit, sketches don't."""
    part = lambda name, k, n: [f"{name}{k}k{j}" for j in range(n)]
    rows = [(i, " ".join(part("a", i // 10, 30) + part("b", i % 10, 10))) for i in range(100)]
    seen, verify = [], jaccard_join.verify
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", 1)
    monkeypatch.setattr(jaccard_join, "verify", lambda scratch, pairs, docs: seen.append(pairs.count()) or verify(scratch, pairs, docs))
    df = spark.createDataFrame([*rows, (100, "other " + rows[7][1].partition(" ")[2])], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.join(df)[0].collect()}
    assert got == {**{i: i for i in range(100)}, 100: 7}
    assert seen[-1] < 10


def test_sketches_differ_by_less_than_sets():
    rng = np.random.default_rng(9)
    for n in (1, 7, 60, 300, 3000):
        a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
        b[: n - n // 8] = a[: n - n // 8]
        bits = bin(int.from_bytes((jaccard_join.sketch(a) ^ jaccard_join.sketch(b)).tobytes(), "little")).count("1")
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))


def test_only_texts_with_postings_are_verified(spark, monkeypatch):
    """No round reads the texts that share no shingle with another."""
    words = lambda d, n=40: [f"v{d}k{j}" for j in range(n)]
    rows = [(d, " ".join(words(d))) for d in range(50)] + [(100 + d, " ".join([*words(d)[:-1], "other"])) for d in range(3)]
    seen, verify = [], jaccard_join.verify
    monkeypatch.setattr(jaccard_join, "verify", lambda scratch, pairs, docs: seen.append({r.doc_id for r in docs.collect()}) or verify(scratch, pairs, docs))
    named, parts = [], jaccard_join._parts
    monkeypatch.setattr(jaccard_join, "_parts", lambda postings, groups: named.append(postings.count()) or parts(postings, groups))
    got = {r.doc_id: r.component_id for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    assert got == {d: d % 100 for d, _ in rows}
    assert named[0] > 0 and not any(named[1:])  # the first round joins all copies
    assert seen and all(ids <= {0, 1, 2, 100, 101, 102} for ids in seen)
