import random

from sluice.llm import decontaminate as dc


def fold(s):
    return "".join(" " if c in "\t\n\x0b\x0c\r" else c.lower() for c in s)


def fewest_edits(item, text):
    """Edits of the best passage, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def edit(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        kind = rng.choice("rid")
        if kind == "r":
            s[i] = rng.choice("abc xyz")
        elif kind == "i":
            s.insert(i, rng.choice("abc xyz"))
        elif len(s) > 1:
            del s[i]
    return "".join(s)


def prose(rng, n):
    return " ".join(rng.choice(["the", "Ünited", "on", "thing", "ess", "ration", "A", "or", "bleed"]) for _ in range(n))


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randint(9, 40))) for i in range(8)] + [(50, None), (51, ""), (52, "short")]
    texts = [(None, prose(rng, 12)), (900, None), (901, ""), (902, "x" * 60000)]
    for d in range(70):
        t = prose(rng, rng.randint(1, 30))
        if d % 2:
            item = rng.choice(items[:8])[1]
            t += " " + edit(rng, item, rng.choice([0, 1, 3, len(item) // 10, len(item) // 8])).upper() + "\n" + prose(rng, rng.randint(0, 40))
        texts.append((d, t))
    docs = spark.createDataFrame([(*x, "clash") for x in texts], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in dc.find_leaks(docs, bench).collect()}
    want = {}
    for d, t in texts:
        for i, s in items:
            if t and s and len(t) < 50000 and len(s) >= dc.MIN_CHARS:
                n = fewest_edits(fold(s), fold(t))
                if n <= len(s) // dc.EDITS_PER:
                    want[d, i] = n
    assert {k: r.edits for k, r in got.items()} == want and len(want) > 15
    for (d, i), r in got.items():
        t, s = fold(dict(texts)[d]), fold(dict(items)[i])
        assert 0 <= r.start_char <= r.end_char <= len(t)
        assert fewest_edits(s, t[r.start_char : r.end_char]) == r.edits


def test_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_CHARS", 50)
    item = "an item text that is certainly long enough to count"
    docs = spark.createDataFrame([(1, "so " + item), (1, "so " + item)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, item), (3, item + " and more of it, which the document lacks")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.edits) for r in dc.find_leaks(docs, bench).collect()) == [(1, 1, 0), (1, 1, 0), (1, 2, 0), (1, 2, 0)]
    assert dc.find_leaks(docs.filter("false"), bench).count() == 0
    assert dc.find_leaks(docs, bench.filter("false")).count() == 0


def test_short_items_match_whole_words(spark):
    docs = spark.createDataFrame([(1, "say Open Sesame\tnow"), (2, "reopen sesames"), (3, "open sesame"), (4, "open  sesame"), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "open sesame"), (8, "now"), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start_char, r.end_char, r.edits) for r in dc.find_leaks(docs, bench).collect()}
    assert got == {(1, 7, 4, 15, 0), (1, 8, 16, 19, 0), (3, 7, 0, 11, 0)}


def test_query_lists_the_leaks(spark, tmp_path):
    item = "an item text that is certainly long enough to count"
    spark.createDataFrame([(1, "so " + item), (2, "nothing")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r.doc_id, r.item_id) for r in dc.query(spark, str(tmp_path)).collect()] == [(1, 4)]
