import hashlib
import random

from sluice.llm import substring_dedup as sd


def brute(docs):
    first, out = {}, {}
    data = {d: (t or "").encode() for d, t in docs.items()}
    for d in sorted(data):
        for i in range(len(data[d]) - 49):
            first.setdefault(data[d][i : i + 50], d)
    for d, b in data.items():
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = [True] * 50
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    rng = random.Random(12)
    word = lambda: rng.choice(["the", "ünï", "on", "thing", "ess", "ration", "a", "or"])
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(8, 60)) for _ in range(6)]
    docs = {}
    for d in range(120):
        t = prose(rng.randint(0, 60))
        for _ in range(rng.choice([0, 1, 2])):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            t += p[a : len(p) - rng.randint(0, 20)] + prose(rng.randint(0, 10))
        docs[d] = t
    for d in range(120, 150):
        t = list(docs[rng.randrange(120)])
        for _ in range(rng.choice([0, 1, 3])):
            if t:
                t[rng.randrange(len(t))] = "#"
        docs[d] = "".join(t)
    return docs | {150: None, 151: "", 152: "x" * 3000, 153: "x" * 49, 154: "x" * 50, 155: "ab" * 40}


def test_bytes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sd, "SEGMENT", 700)
    docs = corpus()
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in docs.items()], "doc_id long, text string, anchor string, n_bytes int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove(df).collect()}
    want = brute(docs)
    assert got == want
    assert sum(x[1] for x in want.values()) > 3000 and max(x[2] for x in want.values()) > 1


def test_null_ids_repeated_rows_and_empty_table(spark):
    t = "0123456789" * 6
    df = spark.createDataFrame([(None, t), (2, t), (2, t), (3, t)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in sd.remove(df).collect())
    assert got == [(-1, 0), (2, 0), (2, 0), (3, 60)]
    assert sd.remove(df.filter("false")).count() == 0
