import random

from pyspark.sql import functions as F

from sluice.llm import line_dedup


def tokens(line):
    w = [x for x in line.replace("\t", " ").split(" ") if x]
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(docs):
    seen, out = [], {}
    for d, text in sorted(docs.items()):
        if text is None:
            out[d] = (None, 0, 0)
            continue
        kept, lines = [], text.split("\n")
        for line in lines:
            t = tokens(line)
            if not (t and any(100 * len(t & s) >= 75 * len(t | s) for s in seen)):
                kept.append(line)
            if t:
                seen.append(t)
        out[d] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def corpus():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 40))] for _ in range(12)]
    passage = [rng.choice(vocab) for _ in range(9)]
    docs = {}
    for d in range(90):
        lines = []
        for _ in range(rng.randint(1, 5)):
            w = list(rng.choice(base)) if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
            for _ in range(rng.choice([0, 0, 1, 2])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            lines.append(" ".join(w + passage * (rng.random() < 0.3)))
        docs[d] = "\n".join(lines)
    return docs | {90: None, 91: "", 92: "\n \t\n", 93: " ".join(vocab * 20), 94: "tail\n"}


def test_lines_equal_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, 9, "x") for d, t in docs.items()], "doc_id long, text string, n_lines int, id string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup(df).collect()}
    assert got == brute(docs)
    assert sum(x[2] for x in got.values()) > 60


def test_null_ids_repeated_rows_and_empty_table(spark):
    line = "one two three four five six"
    df = spark.createDataFrame([(None, line), (3, line), (3, line), (4, "x\n" + line)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text) for r in line_dedup.dedup(df).collect())
    assert got == [(-1, ""), (3, line), (3, line), (4, "x")]
    assert line_dedup.dedup(df.filter("false")).count() == 0


def test_long_documents_of_nearly_equal_lines(spark):
    """Texts of some 5 MB: their 20,000 lines pair up, and all of them end in one passage."""
    passage = "these nine words stand at the end of all"
    first = "\n".join(" ".join([*(f"w{i}k{k}" for k in range(21)), passage]) for i in range(20_000))
    second = "\n".join("other " + line.partition(" ")[2] for line in first.split("\n"))
    df = spark.createDataFrame([(1, first), (2, second), (3, second + "\nits own line of words that no other has")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup(df).collect()}
    assert got == {1: (20_000, 0, first), 2: (20_000, 20_000, ""), 3: (20_001, 20_000, "its own line of words that no other has")}


def test_phrases_of_many_lines_bring_no_pairs(spark, monkeypatch):
    """50 phrases, in 50 lines each that have nothing else in common: no token of a phrase is among a line's rarest ones."""
    lines = [" ".join([*(f"w{i}k{k}" for k in range(24)), *(f"p{i % 50}k{k}" for k in range(9))]) for i in range(2500)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "other " + lines[7].partition(" ")[2])], "doc_id long, text string")
    seen, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda scratch, pairs, *rest: seen.append(pairs.count()) or verified(scratch, pairs, *rest))
    assert sorted((r.doc_id, r.n_removed) for r in line_dedup.dedup(df).collect()) == [(1, 0), (2, 1)]
    assert 1 <= sum(seen) < 50


def test_halves_of_many_lines_bring_no_pairs(spark, monkeypatch):
    """Every token but four of a line is in ten lines, none of which is similar to it: places fit, sketches don't."""
    half = lambda name, k: [f"{name}{k}k{j}" for j in range(20)]
    lines = [" ".join(half("a", i // 10) + half("b", i % 10)) for i in range(100)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "other " + lines[7].partition(" ")[2])], "doc_id long, text string")
    seen, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda scratch, pairs, *rest: seen.append(pairs.count()) or verified(scratch, pairs, *rest))
    assert sorted((r.doc_id, r.n_removed) for r in line_dedup.dedup(df).collect()) == [(1, 0), (2, 1)]
    assert 1 <= sum(seen) < 10


def test_sketches_differ_by_less_than_sets(spark):
    rng = random.Random(9)
    rows = []
    for n in (1, 2, 7, 45, 300):
        for _ in range(40):
            a = [rng.getrandbits(62) for _ in range(n)]
            b = a[: n - rng.randint(0, n // 8)] + [rng.getrandbits(62) for _ in range(rng.randint(0, n // 8))]
            rows.append((a, b))
    df = spark.createDataFrame(rows, "s array<long>, t array<long>")
    both = df.select("s", "t", *(F.struct(F.size(k).alias("n"), line_dedup.sketch(k).alias("sketch")).alias(o) for k, o in (("s", "own"), ("t", "other"))))
    for r in both.select("s", "t", line_dedup._sketches_fit("own", "other").alias("fit")).collect():
        s, t = set(r.s), set(r.t)
        assert r.fit or 100 * len(s & t) < 75 * len(s | t)
