import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import duckdb

from sluice.llm import importance, terms

SF = "/root/testdata/sf0.001"


def brute(docs, target, percent, least, buckets=10_000):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        return len(w), [crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    s, t = (Counter(b for text in texts for b in features(text)[1]) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for d, text in docs:
        n, own = features(text)
        gain = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in own)
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = gain // len(own) if own else 0
        rows.append((d, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[3], r[2]))
    drawn = fit[: percent * len(fit) // 100]
    ranks = Counter((r, k + 1) for k, r in enumerate(drawn))
    rest = Counter(rows) - Counter(drawn)
    return sorted([(*r, k) for r, k in ranks.elements()] + [(*r, None) for r in rest.elements()], key=str)


def got(spark, docs, target, **options):
    d = spark.createDataFrame([(a, b, 1.0, "x", 9) for a, b in docs], "doc_id long, text string, score double, rank string, n_words int").repartition(3)
    t = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    return sorted(map(tuple, importance.resample(d, t, **options).collect()), key=str)


def test_every_case_equals_brute_force(spark):
    docs = [(k, " ".join(f"w{(k * 7 + j * j) % 23}" for j in range(k % 31))) for k in range(120)]
    docs += [(200, None), (201, ""), (202, "  \n\t"), (203, "Ünïcode ÜNÏCODE Wörter 日本 語" * 9), (None, "w1 w2 " * 15), (5, "w1 again"), (5, docs[5][1]), (204, "one\0two\0three " * 10)]
    target = ["w1 w2 w3", None, "", "Wörter 日本 w4 w4"]
    assert got(spark, docs, target, percent=40, least_words=5) == brute(docs, target, 40, 5)


def test_words_do_not_join_across_texts_or_blocks(spark, monkeypatch):
    monkeypatch.setattr(terms, "TOGETHER", 16)
    texts = [b"one two", b"", b"three four five six seven eight nine", b"ten"]
    pairs = [(int(o), int(b)) for owner, bucket, _ in importance.buckets_of(texts, 1 << 32) for o, b in zip(owner, bucket, strict=True)]
    want = [(k, crc32(f)) for k, t in enumerate(texts) for w in [t.split()] for f in w + [b" ".join(x) for x in zip(w, w[1:], strict=False)]]
    assert sorted(pairs) == sorted(want)


def test_empty_tables(spark):
    assert got(spark, [], ["a b"]) == []
    rows = got(spark, [(1, "a b " * 12), (2, "c")], [], percent=100)
    assert rows == brute([(1, "a b " * 12), (2, "c")], [], 100, 20)


def test_target_like_documents_are_drawn_more(spark):
    docs = [(k, ("alpha beta gamma " if k % 4 == 0 else "delta eps zeta ") * 10) for k in range(400)]
    ranks = [(r[0], r[5]) for r in got(spark, docs, ["alpha beta gamma alpha beta gamma"] * 50) if r[5]]
    assert len(ranks) == 100 and sum(d % 4 == 0 for d, _ in ranks) > 60 and sorted(k for _, k in ranks) == list(range(1, 101))


def test_query_equals_sql(spark):
    rows = importance.query(spark, SF)
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(importance.ORACLE_SQL)
    assert sorted(want.columns) == sorted(rows.columns)
    assert sorted(map(str, map(tuple, rows.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
