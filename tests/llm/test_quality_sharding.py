import zlib
from collections import Counter

import numpy as np

from sluice.llm import quality, sharding

SCHEMA = "doc_id long, text string, n_words string, source string"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "s") for i, t in enumerate(texts)], SCHEMA)


def brute_repeat(words):
    at = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({i + k for i in range(len(words) - 4) if at[tuple(words[i : i + 5])] > 1 for k in range(5)})


def test_quality_measures(spark):
    prose = "the cat sat on the mat and it was the cat that was on the mat again"
    texts = [None, "", " \t\n", prose, (prose + " ") * 3, "a b c d e a b c d e f", "x | y & z\nx | y & z\n\nq #", "one " * 5000, "a a a a a a"]
    got = {r.doc_id: r for r in quality.score(rows(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = (t or "").replace("\t", " ").replace("\n", " ").split()
        lines = [x for x in (t or "").split("\n") if x.strip()]
        assert got[i].n_words == len(words)
        assert got[i].word_chars == sum(map(len, words))
        assert got[i].n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert got[i].n_dup_lines == len(lines) - len(set(lines))
        assert got[i].n_repeat_words == brute_repeat(words)
        assert got[i].base_failed == (len(words) < 10 or 100 * brute_repeat(words) > 20 * len(words))
    assert got[3].kept and not got[4].kept and not got[0].kept
    assert got[0].source == "s"


def test_quality_empty_table(spark):
    assert quality.score(rows(spark, ["x"]).filter("false")).count() == 0


def test_shards_are_exact_and_keep_every_row(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE_ROWS", 50)
    df = spark.createDataFrame([(i, f"t{i % 7}") for i in range(3001)] + [(5, "t5"), (None, None)], "doc_id long, text string")
    out = sharding.shard(df.selectExpr("*", "'old' AS shard"), [df.doc_id, df.text], blocks=37).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in df.collect())
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))


def test_equal_rows_are_dealt_out(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id < 1500 THEN 7 ELSE id END AS doc_id").repartition(5)
    out = sharding.shard(df, [df.doc_id], blocks=16).collect()
    slots = {}
    for r in out:
        slots.setdefault(r.shard, {})[r.slot] = r.doc_id
    assert all(sorted(s) == list(range(len(s))) and 187 <= len(s) <= 188 for s in slots.values()) and len(slots) == 16
    for s in slots.values():
        same = sorted(k for k, d in s.items() if d == 7)
        assert 60 <= len(same) <= 130 and same[-1] - same[0] > 150  # neither crowded in one shard nor side by side


def test_sharding_query_columns(spark, tmp_path):
    rows = [(1, "aé"), (2, None), (3, ""), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.query(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in out) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert {(r.law, r.slot, r.grown_shard) for r in out} == {("rows", 0, None)} and len({r.shard for r in out}) == 4


def test_shard_small_tables(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert sharding.shard(df.filter("false"), [df.doc_id]).count() == 0
    assert [(r.shard, r.slot) for r in sharding.shard(df, [df.doc_id]).collect()] == [(0, 0)]


def test_hypergeometric_law():
    import random

    rng = random.Random(1)
    draws = [sharding.draw_hypergeometric(rng, 30, 70, 20) for _ in range(20000)]
    expected = np.random.default_rng(1).hypergeometric(30, 70, 20, 200000)
    assert abs(np.mean(draws) - 6) < 0.05 and abs(np.var(draws) - np.var(expected)) < 0.1
    m = sharding.draw_matrix([5, 0, 11, 4], sharding.even(20, 3), 3)
    assert [sum(r) for r in m] == [5, 0, 11, 4] and [sum(c) for c in zip(*m)] == [7, 7, 6]
