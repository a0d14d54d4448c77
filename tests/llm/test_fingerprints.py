import base64
import hashlib
import statistics

import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.llm import fingerprints

SF = "/root/testdata/sf0.001"


def got(spark, docs, parts=3):
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, own string, next_id int")
    return fingerprints.fingerprint(d.repartition(parts) if parts else d.coalesce(1)).collect()


def next_texts(docs):
    least = {}
    for d, t in docs:
        if d is not None:
            least[d] = min(least.get(d, t or ""), t or "")
    ids = sorted(least)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    return {d: least[after[d]] for d in ids} | {None: least[ids[0]] if ids else ""}


def check(rows, docs):
    after = next_texts(docs)
    fingers = lambda texts: list(fingerprints.fingerprints(pa.array(texts)))
    want = []
    for d, t in docs:
        t = t or ""
        edited = fingerprints.edit(t, after[d])
        own, changed, following = fingers([t, edited, after[d]])
        near = lambda b, own=own: float(fingerprints.alike([own], [b])[0])
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), base64.b64encode(own).decode(), base64.b64encode(changed).decode(), near(changed), near(following)))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


@pytest.mark.parametrize("parts", [0, 3])
def test_every_case_equals_brute_force(spark, parts):
    docs = [(k * 5, " ".join(f"w{(k * k + j) % 50}" for j in range(k % 40))) for k in range(60)]
    docs += [(400, None), (401, "日本語 テキスト für alle " * 5), (402, ""), (9999, "a b c"), (9999, "a b"), (9999, None), (9000, "x y z w v u"), (None, "no id at all here"), (12, docs[4][1]), (-7, "below zero is first of all")]
    docs = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)) if not parts else docs
    check(got(spark, docs, parts), docs)


def test_ids_far_apart_and_single_rows(spark):
    docs = [(k, f"text number {k} of a few with some words") for k in (-(2**62), -5, 0, 3, 2**40, 2**62)]
    check(got(spark, docs), docs)
    check(got(spark, [(7, "only one text with seven words")]), [(7, "only one text with seven words")])
    check(got(spark, [(None, "nothing has an id"), (None, None)]), [(None, "nothing has an id"), (None, None)])
    assert got(spark, []) == []


def test_order_on_disk_does_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    as_stored = sorted(map(tuple, fingerprints.fingerprint(docs).collect()))
    dealt = sorted(map(tuple, fingerprints.fingerprint(docs.repartition(4, F.xxhash64("doc_id"))).collect()))
    assert as_stored == dealt and len(as_stored) == 200


def test_estimates_are_near_and_without_bias():
    rng = __import__("random").Random(2)
    errors = []
    for n in (30, 200, 1500):
        for share in (0.1, 0.4, 0.7, 0.95):
            for _ in range(12):
                a = [str(rng.random()) for _ in range(n)]
                k = int(n * share)
                b = a[:k] + [str(rng.random()) for _ in range(n - k)]
                x, y = " ".join(a), " ".join(b)
                sx, sy = brute.shingle_set(x), brute.shingle_set(y)
                errors.append(float(fingerprints.alike(*[list(fingerprints.fingerprints(pa.array([t]))) for t in (x, y)])[0]) - len(sx & sy) / len(sx | sy))
    assert abs(statistics.mean(errors)) < 0.01 and statistics.mean(map(abs, errors)) < 0.03


def test_far_texts_agree_by_chance_only():
    a, b = fingerprints.fingerprints(pa.array(["one two three four five six " * 3, " ".join(f"q{k}" for k in range(900))]))
    assert fingerprints.alike([a], [b])[0] < 0.06 and fingerprints.alike([a], [a])[0] == 1.0 and fingerprints.alike([b""], [a])[0] == 0.0
    assert len(a) == fingerprints.BINS * fingerprints.BITS // 8


def test_likeness_of_stored_fingerprints(spark):
    rows = spark.createDataFrame([("one two three four five six seven", "one two three four five six seven"), ("a b c", ""), (None, None)], "a string, b string")
    keys = [[list(fingerprints.fingerprints(pa.array([x], pa.string())))[0] for x in r] for r in rows.collect()]
    packed = spark.createDataFrame(keys, "a binary, b binary")
    assert [r[0] for r in packed.select(fingerprints.likeness("a", "b")).collect()] == [1.0, 0.0, 1.0]


def test_patterned_words_have_their_own_codes():
    from sluice.llm import textcodes

    word = "a"
    for _ in range(12):  # a word and its complement share every polynomial in one base modulo 2**64
        word += word.translate(str.maketrans("ab", "ba"))
    pair = pa.array([word, word.translate(str.maketrans("ab", "ba"))])
    (_, _, data, offsets), = textcodes.chunks(pair)
    codes = textcodes.words(data, offsets)[0]
    assert codes[0] != codes[1]
    a, b = fingerprints.fingerprints(pair)
    assert a != b
