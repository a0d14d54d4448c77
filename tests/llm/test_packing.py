import random
import zlib
from array import array
from collections import defaultdict

import pytest

from sluice.llm import packing


def check(rows, texts, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer_path())
    want = []
    for d, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            want.append((d, p, s, len(part), zlib.crc32(array("I", part).tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins), sum(x[3] for x in want)


@pytest.fixture
def plain_words():
    return ["The", "ünïted", "HASHWH!!", "don't", "x-y.z,", "İstanbul", "ΣΑΣ", "3.14", "a b", "\x1c", "é", "日本語", "thonouble"]


def test_ids_equal_the_tokenizer(spark, plain_words):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice(plain_words) for _ in range(rng.choice([1, 5, 60, 900])))) for i in range(120)]
    texts += [(150, None), (151, ""), (152, "\n \t"), (153, "word " * 3000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = packing.pack_pieces(packing.cut_pieces(df, packing.default_tokenizer_path(), 512), 512, 40).collect()
    bins, total = check(rows, texts, 512)
    assert bins <= -(-total // 512) + 3


def test_added_tokens_in_texts(spark):
    texts = [(1, "<|endoftext|> x"), (2, "a<|startoftext|>b <|endoftext|>"), (3, "<|endoftext|><|endoftext|>"), (4, "x <| endoftext |>"), (5, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    check(packing.pack_documents(df).collect(), texts, packing.CAPACITY)


def test_empty_table(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string").filter("false")
    assert packing.pack_documents(df).count() == 0
    lost = spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "doc_id long, text string")
    assert sorted(r.length for r in packing.pack_documents(lost).collect()) == [1, 2, 2]


def test_crossover_keeps_every_piece_once():
    rng = random.Random(1)
    sizes = [rng.randint(1, 60) for _ in range(200)]
    one, two = (packing.pack(sizes, rng.sample(range(200), 200), 100) for _ in range(2))
    child = packing.cross(sizes, one, two, rng, 100)
    assert sorted(i for b in child for i in b) == list(range(200))
    assert max(sum(sizes[i] for i in b) for b in child) <= 100
    found = packing.evolve(sizes, 3, None, None, 100)
    assert max(found) + 1 <= -(-sum(sizes) // 100) + 1
